"""Disposition analytics over the containers view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters, joins
from ..sources.views import alerts, containers, table, with_views
from .registry import query

TP = "CASE WHEN verdict = 'True Positive' THEN 1 ELSE 0 END"


def on(body: str) -> str:
    return with_views("containers", body)


def standing(spark, d):
    return filters.standing_verdicts(containers(spark, d))


STANDING = ", s AS (SELECT * FROM containers WHERE status = 'closed')"


@query(on("SELECT container_id, tenant, rule FROM containers WHERE t >= TIMESTAMP '1995-01-01' AND t < TIMESTAMP '1996-01-01' AND instance IN ('ASIA', 'EUROPE')"))
def slice_filter(spark, d):
    return filters.slice_filter(containers(spark, d), "1995-01-01", "1995-12-31", instances=["ASIA", "EUROPE"]).select("container_id", "tenant", "rule")


@query(on("SELECT container_id, verdict FROM containers WHERE status = 'closed' AND verdict IN ('True Positive','False Positive','Benign Positive')"))
def verdict_population(spark, d):
    return standing(spark, d).select("container_id", "verdict")


@query("""WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Benign - Expected' WHEN 1 THEN 'FALSE positive' WHEN 2 THEN 'true Positive' WHEN 3 THEN 'Undetermined' WHEN 4 THEN '  ' ELSE 'closed' END AS raw FROM orders)
SELECT id, CASE WHEN trim(raw) = '' THEN '' WHEN lower(raw) LIKE '%benign%' THEN 'Benign Positive' WHEN lower(raw) LIKE '%false%' THEN 'False Positive' WHEN lower(raw) LIKE '%true%' OR lower(raw) LIKE '%undetermined%' THEN 'True Positive' ELSE 'Other' END AS class FROM x""")
def disposition_rollup(spark, d):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "Benign - Expected").when(k == 1, "FALSE positive").when(k == 2, "true Positive").when(k == 3, "Undetermined").when(k == 4, "  ").otherwise("closed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), filters.rolled_up(raw).alias("class"))


@query("SELECT m AS marker, count(*) AS n, max(ts) AS last_at FROM events, (VALUES ('click'), ('view'), ('purchase'), ('e')) v(m) WHERE contains(event_type, m) GROUP BY m")
def marker_summary(spark, d):
    return filters.marker_summary(table(spark, d, "events"), "event_type", "ts", ["click", "view", "purchase", "e"])


@query("SELECT c_custkey, c_name FROM customer")
def drop_null_columns(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.lit(None).cast("string").alias("empty"), "c_name")
    return filters.drop_null_columns(df)


# joins


@query("""WITH r AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, c_name, coalesce(o_orderstatus, '') AS o_orderstatus FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON c_custkey = o_custkey""")
def label_left_join(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderdate", "o_orderkey", F.lit("ignored").alias("c_name"))
    out = joins.label_left_join(table(spark, d, "customer").select("c_custkey", "c_name"), right, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.select("c_custkey", "c_name", "o_orderstatus")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def join_one_to_one(spark, d):
    return joins.join_one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("""SELECT o_orderkey AS container_id, count(l_orderkey) AS found, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def artifact_regroup(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("container_id"), "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    out = joins.regroup_artifacts(table(spark, d, "orders").select(F.col("o_orderkey").alias("container_id")), a, "container_id", "l_linenumber", "part")
    return out.select("container_id", "found", F.array_join("artifacts", ",").alias("parts"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size % 5 = l_linenumber % 5 THEN true ELSE false END AS valid FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def validated_join(spark, d):
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 5).alias("c"))
    right = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 5).alias("c"))
    return joins.validated_join(left, right, "l_partkey", "c").select("l_orderkey", "l_linenumber", "l_partkey", "valid")


PARENT_SQL = """, a AS (SELECT alert_id AS id, customer, ts, CASE WHEN k % 3 = 0 THEN 'NEW' ELSE 'DUPLICATE' END AS verdict FROM alerts),
p AS (SELECT c.id, c.customer, coalesce(
  (SELECT arg_min(n.id, (n.ts, n.id)) FROM a n WHERE n.verdict = 'NEW' AND n.customer = c.customer AND CAST(n.ts AS DATE) = CAST(c.ts AS DATE)),
  (SELECT arg_min(n.id, (n.ts, n.id)) FROM a n WHERE n.verdict = 'NEW' AND n.customer = c.customer)) AS parent_id FROM a c WHERE c.verdict <> 'NEW')
"""


def _parents(spark, d):
    a = alerts(spark, d).select(F.col("alert_id").alias("id"), "customer", "ts", F.when(F.col("k") % 3 == 0, "NEW").otherwise("DUPLICATE").alias("verdict"))
    return joins.assign_parents(a)


@query(with_views("alerts", PARENT_SQL + "SELECT id, customer, parent_id FROM p"))
def assign_parent(spark, d):
    return _parents(spark, d)


@query(with_views("alerts", PARENT_SQL + "SELECT parent_id, count(*) AS children FROM p WHERE parent_id IS NOT NULL GROUP BY parent_id"))
def child_counts(spark, d):
    return joins.child_counts(_parents(spark, d))


@query(on(""", top AS (SELECT rule FROM containers GROUP BY rule ORDER BY count(*) DESC, rule LIMIT 12), tt AS (SELECT tenant FROM containers GROUP BY tenant ORDER BY count(*) DESC, tenant LIMIT 12)
SELECT rule, tenant, count(*) AS n, avg(CASE WHEN verdict = 'True Positive' THEN 1 ELSE 0 END) AS tp_share FROM containers WHERE rule IN (SELECT rule FROM top) AND tenant IN (SELECT tenant FROM tt) GROUP BY rule, tenant"""))
def heat_top_matrix(spark, d):
    c = containers(spark, d)
    tenants = A.count_by(c, "tenant").orderBy(F.desc("n"), "tenant").limit(12).select("tenant")
    c = joins.top_semi(c, "rule", 12).join(F.broadcast(tenants), "tenant", "left_semi")
    return c.groupBy("rule", "tenant").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "True Positive").cast("int")).alias("tp_share"))


@query(on(""", x AS (SELECT DISTINCT rule, tenant FROM containers WHERE is_esc), n AS (SELECT rule, count(*) AS c FROM x GROUP BY rule)
SELECT p.rule AS a, q.rule AS b, count(*) AS both_n, count(*) / (max(na.c) + max(nb.c) - count(*)) AS jaccard FROM x p JOIN x q ON p.tenant = q.tenant AND p.rule < q.rule JOIN n na ON na.rule = p.rule JOIN n nb ON nb.rule = q.rule GROUP BY p.rule, q.rule"""))
def rule_overlap(spark, d):
    x = containers(spark, d).filter("is_esc").select("rule", "tenant").distinct()
    n = A.count_by(x, "rule")
    both = x.toDF("a", "tenant").join(x.toDF("b", "tenant"), "tenant").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both_n"))
    out = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return out.select("a", "b", "both_n", (F.col("both_n") / (F.col("na") + F.col("nb") - F.col("both_n"))).alias("jaccard"))


# aggregates


@query(on("SELECT verdict, count(*) AS n FROM containers GROUP BY verdict"))
def count_by(spark, d):
    return A.count_by(containers(spark, d), "verdict")


@query(on("SELECT verdict, instance, count(*) AS n FROM containers GROUP BY verdict, instance"))
def count_by_pair(spark, d):
    return A.count_by(containers(spark, d), "verdict", "instance")


@query("SELECT quality, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_all(spark, d):
    return A.value_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query(on("SELECT rule, count(*) AS n, CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS dups, avg(CASE WHEN is_esc THEN 1 ELSE 0 END) AS esc_rate, CAST(count(*) - sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS worked, sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) / count(*) AS dup_share FROM containers GROUP BY rule ORDER BY n DESC, rule LIMIT 15"))
def rule_volume(spark, d):
    return A.rule_volume(containers(spark, d)).orderBy(F.desc("n"), "rule").limit(15)


@query(on("SELECT tenant, instance, count(*) AS n, avg(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS dup_rate, avg(CASE WHEN is_esc THEN 1 ELSE 0 END) AS esc_rate FROM containers GROUP BY tenant, instance"))
def tenant_rates(spark, d):
    return A.tenant_rates(containers(spark, d))


@query(on("SELECT count(*) AS n, count(DISTINCT rule) AS rules, count(DISTINCT tenant) AS tenants, count(*) FILTER (status = 'duplicate') AS dups, avg(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS dup_share, avg(CASE WHEN is_esc THEN 1 ELSE 0 END) AS esc_share, avg(" + TP + ") AS tp_share FROM containers"))
def kpi_tiles(spark, d):
    return A.kpi_tiles(containers(spark, d))


PIVOT = "count(*) FILTER (verdict = 'True Positive') AS tp, count(*) FILTER (verdict = 'False Positive') AS fp, count(*) FILTER (verdict = 'Benign Positive') AS bp, count(*) AS total"
SHARES = ", tp / total AS tp_share, fp / total AS fp_share, bp / total AS bp_share"


@query(on(STANDING + f", p AS (SELECT rule, {PIVOT} FROM s GROUP BY rule) SELECT *{SHARES} FROM p"))
def verdict_by_rule(spark, d):
    return A.verdict_by(standing(spark, d), "rule")


@query(on(STANDING + f", p AS (SELECT tenant, {PIVOT} FROM s GROUP BY tenant) SELECT *{SHARES} FROM p"))
def verdict_by_tenant(spark, d):
    return A.verdict_by(standing(spark, d), "tenant")


@query(on(", s AS (SELECT *, CASE WHEN is_esc THEN 'Escalated' ELSE verdict END AS disp FROM containers) SELECT rule, count(*) FILTER (disp = 'Escalated') AS esc, count(*) FILTER (disp = 'True Positive') AS tp, count(*) FILTER (disp = 'False Positive') AS fp, count(*) FILTER (disp = 'Benign Positive') AS bp, count(*) AS total FROM s GROUP BY rule"))
def disposition_by_rule(spark, d):
    c = containers(spark, d).withColumn("disp", F.when(F.col("is_esc"), "Escalated").otherwise(F.col("verdict")))
    return A.pivot_counts(c, "rule", "disp", ("Escalated", *filters.CLASSES), ("esc", "tp", "fp", "bp"))


@query(on(f", top AS (SELECT rule FROM containers GROUP BY rule ORDER BY count(*) DESC, rule LIMIT 8), f AS (SELECT CASE WHEN rule IN (SELECT rule FROM top) THEN rule ELSE 'Other' END AS rule, verdict FROM containers) SELECT rule, {PIVOT} FROM f GROUP BY rule"))
def rulemix_other(spark, d):
    return A.pivot_counts(A.folded(containers(spark, d), "rule", 8), "rule", "verdict", filters.CLASSES, ("tp", "fp", "bp"))


@query(on("SELECT rule, count(*) AS n, CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS dups, count(DISTINCT tenant) AS tenants, avg(" + TP + ") AS tp_share, min(t) AS first_at, max(t) AS last_at FROM containers GROUP BY rule"))
def rule_table(spark, d):
    dup = (F.col("status") == "duplicate").cast("int")
    return containers(spark, d).groupBy("rule").agg(F.count("*").alias("n"), F.sum(dup).alias("dups"), F.count_distinct("tenant").alias("tenants"), F.avg((F.col("verdict") == "True Positive").cast("int")).alias("tp_share"), F.min("t").alias("first_at"), F.max("t").alias("last_at"))


@query("""SELECT CAST(g.w AS INTEGER) AS weekday, CAST(h.h AS INTEGER) AS hour, count(e.ts) AS n FROM range(7) g(w) CROSS JOIN range(24) h(h) LEFT JOIN events e ON isodow(e.ts) - 1 = g.w AND hour(e.ts) = h.h GROUP BY g.w, h.h""")
def clock_matrix(spark, d):
    return A.clock_matrix(table(spark, d, "events"), "ts")


@query(on(", c AS (SELECT tenant, verdict, count(*) AS n FROM containers GROUP BY tenant, verdict) SELECT tenant, verdict, n FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY n DESC, verdict) AS rn FROM c) WHERE rn = 1"))
def dominant_severity(spark, d):
    return A.dominant(containers(spark, d), "tenant", "verdict")


@query("SELECT event_type, CAST(sum(v) AS BIGINT) AS total, count(v) AS numeric, count(*) AS n FROM (SELECT event_type, TRY_CAST(CASE WHEN user_id % 4 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS v FROM events) GROUP BY event_type")
def coerced_sums(spark, d):
    e = table(spark, d, "events").withColumn("raw", F.when(F.col("user_id") % 4 == 0, "n/a").otherwise(F.col("user_id").cast("string")))
    return A.coerced_sums(e, "event_type", "raw")


@query(with_views("alerts", "SELECT value, count(*) AS n FROM (SELECT ip AS value FROM alerts UNION ALL SELECT domain FROM alerts) GROUP BY value"))
def unpivot_count(spark, d):
    return A.unpivot_count(alerts(spark, d), "ip", "domain")


@query(with_views("alerts", "SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(user_name || '; ' || ip || ';;' || domain, ';'))) AS value FROM alerts) WHERE value <> '' GROUP BY value"))
def explode_count(spark, d):
    return A.explode_count(alerts(spark, d).withColumn("x", F.concat("user_name", F.lit("; "), "ip", F.lit(";;"), "domain")), "x", ";")


@query(on(f", a AS (SELECT rule, count(*) AS n, count(*) FILTER (verdict = 'True Positive') AS found FROM containers GROUP BY rule) SELECT rule, n, found, found / n AS yield_, max(found / n) OVER (ORDER BY n DESC, rule ROWS UNBOUNDED PRECEDING) AS best FROM a"))
def rule_pareto(spark, d):
    return A.rule_pareto(containers(spark, d))


@query(on(", a AS (SELECT rule, count(*) AS n, count(*) FILTER (verdict = 'True Positive') AS found FROM containers GROUP BY rule) SELECT rule, sum(n) OVER w / sum(n) OVER () AS work_share, sum(found) OVER w / sum(found) OVER () AS find_share FROM a WINDOW w AS (ORDER BY found / n DESC, rule ROWS UNBOUNDED PRECEDING)"))
def concentration_curve(spark, d):
    return A.concentration_curve(containers(spark, d))


@query(on(", g AS (SELECT tenant, rule, count(*) AS n, count(DISTINCT verdict) AS kinds FROM containers GROUP BY tenant, rule HAVING count(*) >= 3) SELECT rule, count(*) AS groups, count(*) FILTER (kinds > 1) AS split, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (kinds > 1) / count(*) AS split_share FROM g GROUP BY rule"))
def verdict_noise(spark, d):
    return A.verdict_noise(containers(spark, d), 3)


@query(on("SELECT lower(string_split(rule, ' - ')[-1]) AS tail, count(*) AS n, avg(" + TP + ") AS tp_share, min(rule) AS first_title FROM containers GROUP BY 1 HAVING count(*) >= 10"))
def title_stats(spark, d):
    return A.title_stats(containers(spark, d), "rule", 10)


@query(on(f", b AS (SELECT rule, tenant, role, count(*) AS n, CAST(sum({TP}) AS BIGINT) AS tp FROM containers GROUP BY ALL), c AS (SELECT *, count(*) OVER w AS roles FROM b WINDOW w AS (PARTITION BY rule, tenant)) SELECT role, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM c WHERE roles >= 2 GROUP BY role"))
def rater_lift(spark, d):
    return A.rater_lift(containers(spark, d)).drop("lift")


@query(on(", c AS (SELECT rule, verdict, count(*) AS n FROM containers GROUP BY ALL), m AS (SELECT rule, max(n) AS top, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY rule HAVING sum(n) >= 20) SELECT rule, top, n, round((top / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(top / n * (1 - top / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 9) AS low FROM m"))
def wilson_consistency(spark, d):
    return A.wilson_consistency(containers(spark, d), 20).select("rule", "top", "n", F.round("low", 9).alias("low"))


@query(on(""", s AS (SELECT count(*) AS n, count(*) FILTER (is_esc) AS a, count(*) FILTER (status = 'duplicate') AS b, count(*) FILTER (is_esc AND status = 'duplicate') AS ab FROM containers)
SELECT 'is_esc' AS a, 'dup' AS b, round((n * ab - a * b) / sqrt((n * a - a * a) * (n * b - b * b)), 9) AS phi FROM s"""))
def phi_matrix(spark, d):
    c = containers(spark, d).withColumn("dup", F.col("status") == "duplicate")
    return A.phi_matrix(c, ["is_esc", "dup"]).withColumn("phi", F.round("phi", 9))


@query(on(""", top AS (SELECT rule FROM containers GROUP BY rule ORDER BY count(*) DESC, rule LIMIT 5), days AS (SELECT DISTINCT CAST(t AS DATE) AS day FROM containers),
g AS (SELECT rule, day FROM top, days), c AS (SELECT g.rule, g.day, count(x.rule) AS c FROM g LEFT JOIN containers x ON x.rule = g.rule AND CAST(x.t AS DATE) = g.day GROUP BY g.rule, g.day)
SELECT p.rule AS a, q.rule AS b, round(corr(p.c, q.c), 9) AS r FROM c p JOIN c q ON p.day = q.day AND p.rule < q.rule GROUP BY p.rule, q.rule"""))
def rule_corr(spark, d):
    return A.rule_corr(containers(spark, d), 5).withColumn("r", F.round("r", 9))


@query(on(""", top AS (SELECT rule FROM containers GROUP BY rule ORDER BY count(*) DESC, rule LIMIT 12), days AS (SELECT DISTINCT CAST(t AS DATE) AS day FROM containers),
g AS (SELECT rule, day FROM top, days), c AS (SELECT g.rule, g.day, count(x.rule) AS c FROM g LEFT JOIN containers x ON x.rule = g.rule AND CAST(x.t AS DATE) = g.day GROUP BY g.rule, g.day)
SELECT p.rule AS a, q.rule AS b, round(corr(p.c, q.c), 9) AS r FROM c p JOIN c q ON p.day = q.day AND p.rule < q.rule GROUP BY p.rule, q.rule"""))
def rule_corr_12(spark, d):
    return A.rule_corr(containers(spark, d), 12).withColumn("r", F.round("r", 9))


@query(on(""", c AS (SELECT verdict, instance, count(*) AS n FROM containers GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY verdict) AS ra, sum(n) OVER (PARTITION BY instance) AS rb, sum(n) OVER () AS total FROM c),
s AS (SELECT sum(n * n / (ra * rb)) - 1 AS phi2, CAST(max(total) AS BIGINT) AS n, count(DISTINCT verdict) AS r, count(DISTINCT instance) AS k FROM x)
SELECT n, r, k, round(sqrt(greatest(0, phi2 - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)), 9) AS v FROM s"""))
def cramers_v(spark, d):
    return A.cramers_v(containers(spark, d), "verdict", "instance").withColumn("v", F.round("v", 9))


@query(on(""", c AS (SELECT rule, verdict, count(*) AS n FROM containers GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY rule) AS ra, sum(n) OVER (PARTITION BY verdict) AS rb, sum(n) OVER () AS total FROM c),
p AS (SELECT verdict, count(*) / sum(count(*)) OVER () AS p FROM containers GROUP BY verdict)
SELECT round((SELECT sum(n / total * ln(n * total / (ra * rb))) FROM x), 9) AS mi, round((SELECT -sum(p * ln(p)) FROM p), 9) AS entropy"""))
def mutual_info(spark, d):
    return A.mutual_info(containers(spark, d), "rule", "verdict").select(F.round("mi", 9).alias("mi"), F.round("entropy", 9).alias("entropy"))


@query(""", x AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT "column", value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c)
SELECT "column", CAST(sum(n) AS BIGINT) AS present, count(*) AS distinct_n, max(CASE WHEN rn = 1 THEN value END) AS top, max(CASE WHEN rn = 1 THEN n END) AS top_n FROM r GROUP BY "column" """.replace(", x AS", "WITH x AS", 1))
def column_profile(spark, d):
    return A.column_profile(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["lang", "source", "quality"])


@query(on(f"SELECT count(*) FILTER (is_esc) AS present, avg({TP}) FILTER (is_esc) AS with_, avg({TP}) FILTER (NOT is_esc) AS without, avg({TP}) FILTER (is_esc) - avg({TP}) FILTER (NOT is_esc) AS lift FROM containers"))
def presence_lift(spark, d):
    return A.presence_lift(containers(spark, d), F.col("is_esc"), F.col("verdict") == "True Positive")


@query(on(f"SELECT instance, date_trunc('month', t) AS month, count(*) AS n, avg({TP}) AS tp_share FROM containers GROUP BY 1, 2".replace("date_trunc('month', t)", "CAST(date_trunc('month', t) AS TIMESTAMP)")))
def monthly_rate(spark, d):
    return containers(spark, d).groupBy("instance", F.date_trunc("month", "t").alias("month")).agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "True Positive").cast("int")).alias("tp_share"))


@query("SELECT key, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS share, CASE WHEN count(DISTINCT doc_id) / (SELECT count(*) FROM documents) < 0.01 THEN 'rare' WHEN count(DISTINCT doc_id) / (SELECT count(*) FROM documents) < 0.5 THEN 'some' ELSE 'common' END AS band FROM (SELECT doc_id, lang AS key FROM documents UNION ALL SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'text' FROM documents) GROUP BY key")
def key_coverage(spark, d):
    return A.key_coverage(table(spark, d, "documents"), "doc_id", F.array("lang", "source", F.lit("text")), 0)


@query("SELECT event_type, count(*) AS n, CAST(count(*) FILTER (user_id % 5 = 0) AS BIGINT) AS with_feedback, min(ts) AS first_at, max(ts) AS last_at, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY event_type ORDER BY n DESC")
def feedback_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 5 == 0).alias("with_feedback"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), *[F.round(f("value"), 6).alias(n) for f, n in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))]).orderBy(F.desc("n"))


@query("""WITH p AS (SELECT user_id % 4 AS run, avg(user_id) AS s, list(DISTINCT event_type) AS v FROM events GROUP BY 1), n AS (SELECT v, count(*) AS c FROM (SELECT unnest(v) AS v FROM p) GROUP BY v)
SELECT count(*) AS runs, min(s) AS least, max(s) AS most, max(s) - min(s) AS spread, (SELECT count(*) FROM n WHERE c = (SELECT count(*) FROM p)) AS in_all, (SELECT count(*) FROM n) AS in_any FROM p""")
def run_consistency(spark, d):
    return A.run_consistency(table(spark, d, "events").withColumn("run", F.col("user_id") % 4), "run", "event_type", "user_id")


@query("SELECT (SELECT user_id FROM events ORDER BY user_id OFFSET (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM events) LIMIT 1) AS p50, (SELECT user_id FROM events ORDER BY user_id OFFSET (SELECT CAST(floor(count(*) * 0.95) AS BIGINT) FROM events) LIMIT 1) AS p95")
def latency_nearest_rank(spark, d):
    e = table(spark, d, "events")
    return A.nearest_rank(e, "user_id", 0.5).toDF("p50").join(A.nearest_rank(e, "user_id", 0.95).toDF("p95"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def dedupe_keep_last(spark, d):
    return joins.dedupe(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(on(", a AS (SELECT rule, count(*) AS n, count(*) FILTER (verdict = 'True Positive') AS found FROM containers GROUP BY rule), u AS (SELECT * FROM (SELECT * FROM a ORDER BY n DESC, rule LIMIT 4) UNION SELECT * FROM (SELECT * FROM a ORDER BY found DESC, rule LIMIT 4)) SELECT * FROM u"))
def extremes(spark, d):
    a = containers(spark, d).groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "True Positive").alias("found"))
    return A.extremes(a, ["n", "found"], 4, "rule")


@query(on(", a AS (SELECT rule, count(*) AS n FROM containers GROUP BY rule), r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, rule) AS INTEGER) AS rank FROM a) SELECT rule, n, rank FROM r WHERE rank > 20 AND rank <= 30"))
def page(spark, d):
    return A.page(A.count_by(containers(spark, d), "rule"), [F.desc("n"), F.col("rule")], 99, 10)


@query(on(f", x AS (SELECT 'instance' AS indicator, instance AS bin, {TP} AS tp FROM containers UNION ALL SELECT 'role', CAST(role AS VARCHAR), {TP} FROM containers), c AS (SELECT indicator, bin, count(*) AS n, avg(tp) AS tp_share FROM x GROUP BY ALL HAVING count(*) >= 10), w AS (SELECT *, count(*) OVER p AS bins, max(tp_share) OVER p - min(tp_share) OVER p AS spread FROM c WINDOW p AS (PARTITION BY indicator)) SELECT * FROM w WHERE bins >= 2"))
def scorecard(spark, d):
    return A.scorecard(containers(spark, d), ["instance", "role"], 10)


@query("SELECT l_returnflag AS key FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'O'")
def key_intersection(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_linestatus = 'F'").select(F.col("l_returnflag").alias("key")).intersect(li.filter("l_linestatus = 'O'").select("l_returnflag"))
