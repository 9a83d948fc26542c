"""Small operators: roll-ups of checks, two-sided heads, set differences, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Check outcomes, the worst last.
OUTCOMES = ("PASS", "WARN", "FAIL")


def head_and_tail(df: DataFrame, order: str, tie: str, head: int, tail: int) -> DataFrame:
    """The first and the last rows of an order, by two top-k selections."""
    first = df.orderBy(order, tie).limit(head).withColumn("side", F.lit("head"))
    last = df.orderBy(F.desc(order), F.desc(tie)).limit(tail).withColumn("side", F.lit("tail"))
    return first.unionByName(last)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values that only one side has, and which."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def worst_outcome(df: DataFrame, key: str, outcome: str) -> DataFrame:
    """The worst outcome of each key."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col(outcome))
    return df.groupBy(key).agg(F.count("*").alias("checks"), F.max(rank).alias("r")).select(key, "checks", F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("r").cast("int")).alias("outcome"))


def similarity_histogram(df: DataFrame, similarity: str) -> DataFrame:
    """0 by itself, then right-closed quarters."""
    s = F.col(similarity)
    return df.groupBy(F.when(s == 0, "0").when(s <= 0.25, "(0, .25]").when(s <= 0.5, "(.25, .5]").when(s <= 0.75, "(.5, .75]").when(s < 1, "(.75, 1)").otherwise("1").alias("bin")).agg(F.count("*").alias("n"))


def remapped(column: Column, known: dict[str, str], keep_unknown: bool) -> Column:
    """Values through a dictionary; the unknown stay as they are, or become null."""
    m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    found = F.try_element_at(m, column)
    return F.coalesce(found, column) if keep_unknown else found


def text_windows(df: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """Overlapping windows of a long text with their offsets; an empty text has none."""
    n = F.char_length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step)))
    w = df.select(key, text, F.explode(F.filter(starts, lambda a: (a == 0) | (a + (size - step) < n))).alias("first"))
    return w.select(key, "first", F.substring(text, F.col("first") + 1, F.lit(size)).alias("window"))


def score_fingerprint(df: DataFrame, key: str, score: str, digits: int = 9, buckets: int = 64) -> DataFrame:
    """SHA-256 over rows in key order, each bucket of keys hashed by itself and the buckets'
    hashes then together, so that no task holds all rows."""
    line = F.concat_ws(":", F.col(key).cast("string"), F.format_number(F.col(score).cast("double"), digits))
    per = df.groupBy(F.pmod(F.col(key), F.lit(buckets)).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def sections(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several sections by container: a count for each section and in total."""
    out = None
    for name, df in frames.items():
        part = df.select(key, F.lit(name).alias("section"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(*[F.count_if(F.col("section") == n).alias(n) for n in frames], F.count("*").alias("total"))


def audit_order(df: DataFrame, verdict: str, gap: str, priority: Sequence[str]) -> DataFrame:
    """Rank by the verdict's priority, then the widest gap."""
    p = F.array_position(F.array(*map(F.lit, priority)), F.col(verdict))
    return df.withColumn("priority", F.when(p == 0, F.lit(len(priority) + 1)).otherwise(p)).orderBy("priority", F.desc(gap))


def mix_by_bin(df: DataFrame, bin_: str) -> DataFrame:
    """Shares of verdicts within each bin."""
    c = df.groupBy(bin_, "verdict").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(bin_)))
