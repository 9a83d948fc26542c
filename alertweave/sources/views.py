"""Alert-shaped views of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each event: who, where and what kind, with three observables."""
    return of_events(table(spark, sf_dir, "events"))


def of_events(e: DataFrame) -> DataFrame:
    """Events, from a table or a stream, as alerts."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    u = F.floor(F.col("user_id") / 3)
    return e.select(
        F.col("event_id").alias("alert_id"), "ts", (F.col("user_id") % 3).alias("customer"), F.col("event_type").alias("alert_name"),
        F.concat(F.lit("u"), (u % 4).cast("string")).alias("user_name"),
        F.concat(F.lit("10.0."), (k % 2).cast("string"), F.lit("."), (u % 2).cast("string")).alias("ip"),
        F.concat(F.lit("h"), (F.floor(k / 2) % 2).cast("string"), F.lit(".example")).alias("domain"),
        k.alias("k"), "user_id", "value",
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with lists of users, addresses and domains: of several, one or no values."""
    a = alerts(spark, sf_dir)
    k, none = F.col("k"), F.array().cast("array<string>")
    named = lambda c, tail: F.concat(c, F.lit("-"), (k % 13).cast("string"), F.lit(tail))
    users = F.when(k % 5 == 0, none).when(k % 3 == 1, F.array(F.concat(F.lit("admin "), "user_name"), "user_name")).when(k % 3 == 2, F.array(F.lit(None), "user_name")).otherwise(F.array("user_name"))
    ips = F.when(k % 7 < 2, none).when(k % 2 == 1, F.array("ip", F.concat("ip", F.lit("4")))).otherwise(F.array("ip"))
    domains = F.when(k % 4 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(named("domain", ".example")))
    return a.select("alert_id", "ts", "customer", "alert_name", users.alias("users"), ips.alias("ips"), domains.alias("domains"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed or duplicate container for each order, with tenant, rule and verdict."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    verdict = F.when(F.col("o_orderstatus") == "F", "True Positive").when(F.col("o_orderstatus") == "O", "Benign Positive").otherwise("False Positive")
    return j.select(
        F.col("o_orderkey").alias("container_id"), F.col("o_orderdate").alias("t"), F.col("n_name").alias("tenant"),
        F.concat("o_orderpriority", F.lit(" - "), "c_mktsegment").alias("rule"), F.col("r_name").alias("instance"), verdict.alias("verdict"),
        F.when(F.col("o_orderkey") % 7 == 0, "duplicate").otherwise("closed").alias("status"),
        (F.col("o_custkey") % 3).alias("role"), (F.col("o_orderkey") % 11 == 0).alias("is_esc"), F.col("o_totalprice").alias("cost"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a pseudo-score in thousandths: y is 1 for low quality."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = ((F.col("doc_id") * 7919 + F.col("n_chars") * 31) % 700 + (1 - F.col("quality")) * 300).cast("bigint")
    return d.join(lab, "doc_id").select("doc_id", (1 - F.col("quality")).cast("int").alias("y"), s.alias("score"), "lang", "source", (F.col("doc_id") % 12).alias("month"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON bundles of typed objects."""
    a = alerts(spark, sf_dir)
    obj = lambda kind, **f: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in f.items()])
    objects = [
        F.to_json(obj("indicator", name=F.col("alert_name"), created=F.col("ts").cast("string"))),
        F.to_json(obj("ipv4-addr", value=F.col("ip"))),
        F.to_json(obj("domain-name", value=F.col("domain"))),
        F.to_json(obj("user-account", user_id=F.col("user_name"), account_login=F.col("user_name"))),
        F.to_json(obj("file", hashes=F.struct(F.sha2(F.col("k").cast("string"), 256).alias("SHA-256")))),
    ]
    return a.select("alert_id", "ts", "customer", F.concat(F.lit('{"type":"bundle","objects":['), F.concat_ws(",", *objects), F.lit("]}")).alias("bundle"))


#: SQL of the half hour since 1970 that holds ``ts``, and of its millisecond, both rounded down
#: (epoch_ms rounds to the nearest).
HALF_HOUR = "CAST(floor(epoch_us(ts) / 1800000000) AS BIGINT)"
MILLISECOND = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"

VIEW_SQL = {
    "alerts": """alerts AS (SELECT event_id AS alert_id, ts, user_id % 3 AS customer, event_type AS alert_name,
      'u' || CAST((user_id // 3) % 4 AS VARCHAR) AS user_name,
      '10.0.' || CAST(k % 2 AS VARCHAR) || '.' || CAST((user_id // 3) % 2 AS VARCHAR) AS ip,
      'h' || CAST((k // 2) % 2 AS VARCHAR) || '.example' AS domain, k, user_id, value
      FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
    "sightings": """sightings AS (SELECT alert_id, ts, customer, alert_name,
      CASE WHEN k % 5 = 0 THEN [] WHEN k % 3 = 1 THEN ['admin ' || user_name, user_name] ELSE [user_name] END AS users,
      CASE WHEN k % 7 < 2 THEN [] WHEN k % 2 = 1 THEN [ip, ip || '4'] ELSE [ip] END AS ips,
      CASE WHEN k % 4 = 0 THEN [] ELSE [domain || '-' || CAST(k % 13 AS VARCHAR) || '.example'] END AS domains FROM alerts)""",
    "containers": """containers AS (SELECT o_orderkey AS container_id, o_orderdate AS t, n_name AS tenant,
      o_orderpriority || ' - ' || c_mktsegment AS rule, r_name AS instance,
      CASE o_orderstatus WHEN 'F' THEN 'True Positive' WHEN 'O' THEN 'Benign Positive' ELSE 'False Positive' END AS verdict,
      CASE WHEN o_orderkey % 7 = 0 THEN 'duplicate' ELSE 'closed' END AS status,
      o_custkey % 3 AS role, o_orderkey % 11 = 0 AS is_esc, o_totalprice AS cost
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "scores": """scores AS (SELECT doc_id, CAST(1 - quality AS INTEGER) AS y,
      CAST((doc_id * 7919 + n_chars * 31) % 700 + (1 - quality) * 300 AS BIGINT) AS score, lang, source, doc_id % 12 AS month
      FROM documents JOIN labels USING (doc_id))""",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in names.split()) + (",\n" if body.lstrip().startswith(",") else "\n") + body.lstrip().lstrip(",")
