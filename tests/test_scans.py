"""Prior-only features over hot keys against plain windows, and ranges of an outlier."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from alertweave.operators import ordered, scans, windows

PAIR = ("tenant", "rule")
SCHEMA = "container_id bigint, t timestamp_ntz, tenant string, rule string, verdict string"


def order(*keys):
    return W.partitionBy(*keys).orderBy("t", "container_id")


def before(*keys):
    return order(*keys).rowsBetween(W.unboundedPreceding, -1)


def plain(df):
    """All features by plain windows."""
    hit = (F.col("verdict") == "True Positive").cast("int")
    benign = F.coalesce(F.col("verdict") == "Benign Positive", F.lit(False)).cast("int")
    df = df.withColumn("pair_n", F.count("*").over(before(*PAIR))).withColumn("hits", F.coalesce(F.sum(hit).over(before(*PAIR)), F.lit(0)))
    df = df.withColumn("seen", F.row_number().over(order(*PAIR)) - 1).withColumn("prev", F.lag("verdict", 1, "none").over(order(*PAIR)))
    df = df.withColumn("island", F.coalesce(F.sum(1 - benign).over(before(*PAIR)), F.lit(0)))
    df = df.withColumn("benign_run", F.coalesce(F.sum(benign).over(before(*PAIR, "island")), F.lit(0)))
    p = F.lag("verdict").over(order(*PAIR))
    df = df.withColumn("had", p.isNotNull().cast("int")).withColumn("flip", F.coalesce((p != F.col("verdict")).cast("int"), F.lit(0)))
    df = df.withColumn("flip_rate", F.when(F.sum("had").over(before("rule")) > 0, F.sum("flip").over(before("rule")) / F.sum("had").over(before("rule"))))
    df = df.withColumn("first", (F.row_number().over(order("rule", "tenant")) == 1).cast("int")).withColumn("distinct_before", F.coalesce(F.sum("first").over(before("rule")), F.lit(0)))
    s = F.coalesce(F.sum(F.when(F.col("verdict") == "True Positive", 1).otherwise(-1)).over(before("rule")), F.lit(0))
    df = df.withColumn("s", s).withColumn("below_high", F.max("s").over(order("rule").rowsBetween(W.unboundedPreceding, 0)) - F.col("s"))
    return df


def features(df):
    out = windows.prior_rate(df, PAIR, F.col("verdict") == "True Positive", "pair", 20.0, 0.25)
    out = windows.flip_rate(windows.benign_run(windows.previous(windows.seen_before(out))))
    return windows.score_drawdown(windows.distinct_before(out))


NAMES = ["pair_n", "seen", "prev", "benign_run", "flip_rate", "distinct_before", "below_high"]


def rows(df, names=NAMES):
    return sorted((r.container_id, *[r[n] for n in names]) for r in df.select("container_id", *names).collect())


def table(spark, n, rng):
    """Nine of ten rows are of one rule, most of them of one tenant; ties and nulls."""
    def one(i):
        hot = rng.random() < 0.9
        rule = "hot" if hot else rng.choice(["r1", "r2", None])
        tenant = "main" if hot and rng.random() < 0.8 else rng.choice(["a", "b", None])
        long = (i // 400) % 2  # long benign runs that cross segments
        verdict = "Benign Positive" if long and rng.random() < 0.995 else rng.choice(["True Positive", "Benign Positive", "False Positive", None])
        return i, None if i % 97 == 0 else f"2024-01-01 {i // 3 % 86400 // 3600:02d}:{i // 3 % 3600 // 60:02d}:{i // 3 % 60:02d}", tenant, rule, verdict

    data = [one(i) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA.replace("t timestamp_ntz", "t string")).withColumn("t", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_features_of_hot_keys_equal_windows(spark, monkeypatch, tmp_path, parts):
    table(spark, 3000, random.Random(parts)).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    want = rows(plain(df))
    assert rows(features(df)) == want  # no key is hot: plain windows
    monkeypatch.setattr(scans, "HOT", 50)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert rows(features(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_task_gets_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(scans, "HOT", 100)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        df = spark.range(40_000).select(F.col("id").alias("container_id"), F.col("id").cast("timestamp").alias("t"), F.lit("x").alias("tenant"), F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("rule"), F.lit("False Positive").alias("verdict"))
        s = scans.Scan(df, ["rule"])
        assert s.segmented
        sizes = [r.n for r in s.df.groupBy("rule", "__part").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 3 * 40_000 / 20 and len(sizes) >= 20
        assert {r.below_high for r in s.below_high("below_high", F.lit(1)).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert features(df).collect() == []


def test_ranges_hold_equal_shares_with_an_outlier(spark):
    """One score of 1e12 among 100,000 small ones leaves no range with twice the mean."""
    df = spark.range(100_001).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 7).alias("score"))
    ranges = 64
    edge = df.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("e"))
    sizes = [r.n for r in df.join(F.broadcast(edge)).groupBy(ordered.split_at(F.col("score"), F.col("e"), ranges).alias("r")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100_001 and max(sizes) < 2 * 100_001 / ranges and len(sizes) == ranges
    out = ordered.running(df, F.col("score"), {"n": F.lit(1)}).orderBy("score").limit(3).collect()
    assert [r.n for r in out] == [1, 2, 3] and out[0].n_all == 100_001


def test_ranges_of_few_and_equal_values(spark):
    rng = random.Random(8)
    values = [rng.choice([None, 0.0, 1.0, 1.0, 5.0, float("inf")]) for _ in range(500)] + [rng.random() for _ in range(200)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    got = {r.i: r.n for r in ordered.running(df, F.col("x"), {"n": F.lit(1)}, ties=[F.col("i")]).collect()}
    ranked = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert got == {i: k + 1 for k, i in enumerate(ranked)}
    assert ordered.running(df.limit(0), F.col("x"), {"n": F.lit(1)}).collect() == []
