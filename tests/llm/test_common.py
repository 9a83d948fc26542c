import os

from alertweave.llm import common, suffix_dedup

from . import util


def test_clear_removes_what_was_written(spark):
    suffix_dedup.repeated(util.docs(spark)).collect()
    common.written(util.docs(spark), "x")
    folder = common.shared_dir(spark).removeprefix("file://") + "/llm"
    assert os.listdir(folder) and not spark.catalog.listTables(pattern="suffix_*")
    common.clear(spark)
    assert not os.path.exists(folder)


def test_bitmap_and_among(spark):
    """A bitmap has the bits of its hashes, whatever the parts; what it names is kept whole."""
    from pyspark.sql import functions as F

    from alertweave.llm import common

    hashes = spark.range(3000).select(F.xxhash64("id").alias("x"))
    bits = 1 << 17
    got = common.bitmap(hashes.repartition(7), bits)
    want = {r.x % bits for r in hashes.collect()}
    assert {8 * i + k for i in range(len(got)) for k in range(8) if got[i] >> k & 1} == want
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("g"))
    kept = {r.id for r in common.among(df, "g", hashes.limit(100)).collect()}
    assert {r.id for r in common.among(df.filter("id < 3000"), "g", hashes).collect()} == set(range(3000)) and len(kept) < 1000
    assert common.among(df, "g", hashes.limit(0)).count() == 0
