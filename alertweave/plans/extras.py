"""Queries of the small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as X
from ..operators import windows
from ..sources.views import alerts, containers, table, with_views
from .registry import query


@query("""SELECT * FROM (SELECT o_orderkey, o_totalprice, 'head' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 8)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'tail' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 4)""")
def head_tail(spark, d):
    return X.head_and_tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 8, 4)


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT s_suppkey * 3 + c.m AS k FROM supplier, (SELECT max(c_custkey) - 100 AS m FROM customer) c)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def key_difference(spark, d):
    """Two key ranges that overlap in part, so both sides have keys of their own."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    shifted = s.join(F.broadcast(c.agg((F.max("c_custkey") - 100).alias("m")))).select((F.col("s_suppkey") * 3 + F.col("m")).alias("k"))
    return X.differences(c.select(F.col("c_custkey").alias("k")), shifted)


@query("""SELECT o_custkey, count(*) AS checks, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS outcome FROM orders GROUP BY o_custkey""")
def batch_rollup(spark, d):
    s = F.col("o_orderstatus")
    return X.worst_outcome(table(spark, d, "orders").withColumn("o", F.when(s == "F", "PASS").when(s == "O", "WARN").otherwise("FAIL")), "o_custkey", "o")


@query("""SELECT CASE WHEN s = 0 THEN '0' WHEN s <= 0.25 THEN '(0, .25]' WHEN s <= 0.5 THEN '(.25, .5]' WHEN s <= 0.75 THEN '(.5, .75]' WHEN s < 1 THEN '(.75, 1)' ELSE '1' END AS bin, count(*) AS n FROM (SELECT (user_id % 9) / 8 AS s FROM events) GROUP BY 1""")
def similarity_histogram(spark, d):
    return X.similarity_histogram(table(spark, d, "events").select((F.col("user_id") % 9 / 8).alias("s")), "s")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'True Positive' WHEN 'O' THEN 'Benign Positive' END AS label, CASE o_orderstatus WHEN 'F' THEN 'True Positive' WHEN 'O' THEN 'Benign Positive' ELSE o_orderstatus END AS kept FROM orders")
def label_remap(spark, d):
    known = {"F": "True Positive", "O": "Benign Positive"}
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", X.remapped(s, known, False).alias("label"), X.remapped(s, known, True).alias("kept"))


@query(with_views("containers", "SELECT container_id, status = 'duplicate' AS is_dup, status = 'closed' AS is_closed, is_esc FROM containers"))
def status_flags(spark, d):
    return containers(spark, d).select("container_id", (F.col("status") == "duplicate").alias("is_dup"), (F.col("status") == "closed").alias("is_closed"), "is_esc")


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<TITLE|href')")
def regex_filter(spark, d):
    return table(spark, d, "pages").filter(F.col("html").rlike("(?i)<TITLE|href")).select("page_id")


@query("""SELECT doc_id, CAST(f AS INTEGER) AS first, substr(text, f + 1, 600) AS window FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS f FROM documents) WHERE f = 0 OR f + 100 < length(text)""")
def text_windows(spark, d):
    return X.text_windows(table(spark, d, "documents"), "doc_id", "text", 600, 500)


@query("""WITH l AS (SELECT doc_id, doc_id % 64 AS b, CAST(doc_id AS VARCHAR) || ':' || format('{:,.9f}', n_chars / 7) AS l FROM documents), h AS (SELECT b, sha256(string_agg(l, chr(10) ORDER BY doc_id)) AS h FROM l GROUP BY b)
SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS fingerprint FROM h""")
def score_fingerprint(spark, d):
    return X.score_fingerprint(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 7).alias("score")), "doc_id", "score")


@query("""WITH x AS (SELECT l_orderkey AS k, 'items' AS s FROM lineitem UNION ALL SELECT o_orderkey, 'orders' FROM orders) SELECT k, count(*) FILTER (s = 'items') AS items, count(*) FILTER (s = 'orders') AS orders, count(*) AS total FROM x GROUP BY k""")
def container_sections(spark, d):
    return X.sections({"items": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))}, "k")


@query(with_views("alerts", ", v AS (SELECT alert_name AS verdict, max(k) AS gap FROM alerts GROUP BY alert_name) SELECT verdict, gap, CAST(CASE verdict WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS priority FROM v"))
def audit_order(spark, d):
    v = alerts(spark, d).groupBy(F.col("alert_name").alias("verdict")).agg(F.max("k").alias("gap"))
    return X.audit_order(v, "verdict", "gap", ["purchase", "click"])


@query(with_views("containers", """, r AS (SELECT verdict, row_number() OVER (PARTITION BY tenant, rule ORDER BY t, container_id) - 1 AS seen FROM containers), b AS (SELECT verdict, CASE WHEN seen = 0 THEN 'first' WHEN seen <= 3 THEN '1-3' ELSE '4+' END AS bin FROM r), c AS (SELECT bin, verdict, count(*) AS n FROM b GROUP BY ALL)
SELECT bin, verdict, n, n / sum(n) OVER (PARTITION BY bin) AS share FROM c"""))
def mix_bars(spark, d):
    s = F.col("seen")
    return X.mix_by_bin(windows.seen_before(containers(spark, d)).withColumn("bin", F.when(s == 0, "first").when(s <= 3, "1-3").otherwise("4+")), "bin")


@query(with_views("alerts", "SELECT customer, alert_name, count(*) AS n FROM alerts GROUP BY ROLLUP (customer, alert_name)"))
def rollup_counts(spark, d):
    return alerts(spark, d).rollup("customer", "alert_name").agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role")
def turn_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def turn_order(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "n", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))
