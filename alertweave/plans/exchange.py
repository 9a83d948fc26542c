"""Sources and sinks: tables written in an export's form and read back by its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..operators import joins
from ..sources import files
from ..sources.views import alerts, containers, scores, table, with_views
from .registry import query
from .streams import scratch


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, 'say \"' || o_orderstatus || '\", twice' AS note, '' AS blank FROM orders")
def csv_scan(spark, d):
    """Every column text, quotes and blanks kept."""
    path = scratch(spark, "csv")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit('say "'), "o_orderstatus", F.lit('", twice')).alias("note"), F.lit("").alias("blank"))
    files.write(o, path, "csv")
    return files.text_csv(spark, path)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def csv_pruned(spark, d):
    """Two of many columns, from files that are split among tasks."""
    path = scratch(spark, "csv")
    files.write(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), path, "csv")
    return files.text_csv(spark, path, ["o_orderkey", "o_orderpriority"], multi_line=False).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_bom(spark, d):
    """A byte-order mark in front of the header."""
    path = scratch(spark, "csv")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name"))), "\n")  # of the 25 nations
    table(spark, d, "nation").agg(F.concat(F.lit("﻿n_nationkey,n_name\n"), lines).alias("t")).write.text(path)
    return files.text_csv(spark, path)


@query("SELECT doc_id, source, length(text) AS n FROM documents WHERE lang = 'en'")
def jsonl_scan(spark, d):
    """Compressed JSON lines with a predicate on the fly."""
    path = scratch(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    files.write(docs, path, "json")
    return files.json_lines(spark, path, docs.schema).filter("lang = 'en'").select("doc_id", "source", F.char_length("text").cast("bigint").alias("n"))


@query("""SELECT 'records' AS key, count(*) AS n FROM orders UNION ALL SELECT 'label:' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'key:id', count(*) FROM orders UNION ALL SELECT 'key:status', count(*) FROM orders WHERE o_orderstatus <> 'P' HAVING count(*) > 0""")
def jsonl_census(spark, d):
    """Records, labels and top-level keys of all lines, without a predicate."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    return files.census(table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), status)).alias("j"), "o_orderstatus"), "j", "o_orderstatus")


KEPT = ("True Positive", "Benign Positive")


@query(with_views("containers", """, x AS (SELECT instance, verdict, container_id % 13 <> 0 AS closed, container_id % 5 AS parts, container_id % 17 = 0 AS bare FROM containers),
f AS (SELECT instance, CASE WHEN NOT bare THEN verdict END AS verdict, closed, parts FROM x)
SELECT 'records' AS key, count(*) AS n FROM f UNION ALL SELECT CASE WHEN verdict IN ('True Positive', 'Benign Positive') THEN 'labelled' ELSE 'unlabelled' END, count(*) FROM f GROUP BY 1
UNION ALL SELECT 'no_close_time', count(*) FROM f WHERE verdict IN ('True Positive', 'Benign Positive') AND NOT closed HAVING count(*) > 0
UNION ALL SELECT 'disposition:' || coalesce(verdict, '(none)'), count(*) FROM f GROUP BY 1 UNION ALL SELECT 'server:' || instance, count(*) FROM f GROUP BY 1
UNION ALL SELECT 'artifacts:' || CAST(parts AS VARCHAR), count(*) FROM f GROUP BY 1 UNION ALL SELECT 'key:server', count(*) FROM f UNION ALL SELECT 'key:CEF', count(*) FROM f
UNION ALL SELECT 'key:disposition', count(*) FROM f WHERE verdict IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'key:close_time', count(*) FROM f WHERE closed HAVING count(*) > 0"""))
def jsonl_inventory(spark, d):
    """A compressed export of containers with their artifacts, written and counted whole."""
    i, path = F.col("container_id"), scratch(spark, "jsonl")
    parts = F.transform(F.slice(F.array(*map(F.lit, range(4))), F.lit(1), (i % 5).cast("int")), lambda k: F.struct(F.concat(F.lit("10.0.0."), k.cast("string")).alias("sourceAddress")))
    record = F.struct(F.when(i % 17 != 0, F.col("verdict")).alias("disposition"), F.col("instance").alias("server"), F.when(i % 13 != 0, F.col("t").cast("string")).alias("close_time"), parts.alias("CEF"))
    containers(spark, d).select(F.to_json(record).alias("j")).write.option("compression", "gzip").text(path)
    return files.inventory(spark.read.text(path), "value", KEPT)


@query(with_views("scores", "SELECT doc_id, score / 10.0::DOUBLE AS decision, y FROM scores"))
def csv_percents(spark, d):
    """Scores written as 41.7% behind a byte-order mark and read as numbers."""
    path = scratch(spark, "csv")
    s = scores(spark, d).select(F.col("doc_id").alias("\ufeffdoc_id"), F.concat((F.col("score") / 10).cast("string"), F.lit("%")).alias("Decision Score"), "y")
    files.write(s, path, "csv")
    read = files.text_csv(spark, path, multi_line=False)
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), files.percent(F.col("Decision Score")).alias("decision"), F.col("y").cast("int").alias("y"))


@query(with_views("containers", "SELECT instance AS server, container_id AS id, rule FROM containers WHERE container_id = (SELECT min(container_id) FROM containers)"))
def jsonl_lookup(spark, d):
    """One record by server and id."""
    path = scratch(spark, "jsonl")
    c = containers(spark, d).select(F.col("instance").alias("server"), F.col("container_id").alias("id"), "rule")
    files.write(c, path, "json")
    key = c.agg(F.min_by(F.struct("server", "id"), "id").alias("k")).first().k
    return files.lookup(files.json_lines(spark, path, c.schema), key.server, key.id)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_name")
def json_documents(spark, d):
    """A folder of JSON documents, a file each, in order of a column."""
    path = scratch(spark, "documents")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.option("maxRecordsPerFile", 1).json(path)
    return files.json_documents(spark, path, n.schema, "n_name")


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 > 0")
def audit_log(spark, d):
    """JSON lines of which every third is cut short."""
    path = scratch(spark, "audit")
    e = table(spark, d, "events").select("event_id", "event_type")
    line = F.to_json(F.struct("event_id", "event_type"))
    e.select(F.when(F.col("event_id") % 3 == 0, F.left(line, F.char_length(line) - 2)).otherwise(line)).write.text(path)
    return files.json_lines(spark, path, e.schema)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F'")
def latest_export(spark, d):
    """The newest of several exports that a pattern matches."""
    path = scratch(spark, "exports")
    for at, status in enumerate(("O", "F")):
        files.write(table(spark, d, "orders").filter(F.col("o_orderstatus") == status).coalesce(1), f"{path}/export-{at}", "parquet")
    return spark.read.parquet(files.latest_file(spark, f"{path}/export-*")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status, NULL AS segment FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def concat_frames(spark, d):
    """Frames of different columns, in first-seen order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("status"))
    return files.unioned([o, table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_mktsegment").alias("segment"))])


@query(with_views("alerts", "SELECT alert_id, '[\"' || ip || '\",\"' || domain || '\"]' AS slots, '{\"user\":\"' || user_name || '\"}' AS who FROM alerts"))
def scalar_columns(spark, d):
    """Nested columns as text before they are stored."""
    path = scratch(spark, "scalar")
    a = alerts(spark, d).select("alert_id", F.array("ip", "domain").alias("slots"), F.struct(F.col("user_name").alias("user")).alias("who"))
    files.write(files.scalar_columns(a), path, "parquet")
    return spark.read.parquet(path)


@query(with_views("containers", "SELECT container_id, t, verdict FROM containers WHERE status = 'closed' AND verdict IN ('True Positive', 'False Positive', 'Benign Positive') AND container_id % 13 > 0 ORDER BY t, container_id"))
def training_population(spark, d):
    """Standing verdicts with a time, in order of time."""
    c = containers(spark, d).withColumn("t", F.when(F.col("container_id") % 13 > 0, F.col("t")))
    return filters.training_population(c).select("container_id", "t", "verdict")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def semi_join(spark, d):
    keys = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return joins.of_keys(table(spark, d, "orders"), keys, "o_custkey").select("o_orderkey")


@query(with_views("alerts", ", s AS (SELECT customer, unnest([ip, domain, user_name]) AS v FROM alerts) SELECT customer, count(DISTINCT v) AS n, array_to_string(list_sort(list(DISTINCT v)), ',') AS slots FROM s GROUP BY customer"))
def slot_union(spark, d):
    """The union of the slots of a customer's alerts; values are made distinct before they meet."""
    s = alerts(spark, d).select("customer", F.explode(F.array("ip", "domain", "user_name")).alias("v")).distinct()
    return s.groupBy("customer").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("slots"))


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_outer_counts(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return c.join(s, "nation", "full").select("nation", zero("customers"), zero("suppliers"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def rotating_log(spark, d):
    """Orders through the rotating log, files of 64 KB."""
    from ..sources.connectors import write_rotating

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = scratch(spark, "rotating")
    write_rotating(o, path, 1 << 16)
    return spark.read.schema(o.schema).json(path)


@query("SELECT vec_id AS id, i - 1 AS dim, CAST(x AS FLOAT)::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def array_files(spark, d):
    """Vectors through array files."""
    from ..sources.connectors import read_arrays, write_arrays

    path = scratch(spark, "arrays")
    write_arrays(table(spark, d, "embeddings").select("vec_id", "embedding"), path, 1 << 16)
    return read_arrays(spark, path).select("id", F.posexplode("vector").alias("dim", "x")).select("id", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS created FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def jdbc_selection(spark, d):
    """The newest 500 orders of two states, picked by a database that the orders were written
    to: Spark's own embedded one, so local mode only; elsewhere a server's URL takes its place."""
    from ..sources.connectors import jdbc_selection as picked
    from ..sources.files import jdbc

    url = database(spark, d)
    return jdbc(spark, url, picked("orders", ["id", "status", "created"], {"status": ["F", "P"]}, "created DESC, id", 500)).select(*[F.col(c).alias(c.lower()) for c in ("ID", "STATUS", "CREATED")])


def database(spark, d) -> str:
    """The URL of a database in memory that holds the orders."""
    import uuid

    url = f"jdbc:derby:memory:orders{uuid.uuid4().hex};create=true"
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("STATUS"), F.col("o_orderdate").cast("date").alias("CREATED"))
    o.write.format("jdbc").option("url", url).option("dbtable", "orders").option("createTableColumnTypes", "STATUS VARCHAR(8)").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    return url
