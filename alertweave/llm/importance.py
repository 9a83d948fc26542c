"""Target-distribution importance resampling over hashed word runs.

Identical texts are collapsed first, by grouping on the full text, so that features are made
once for each distinct text and its counts are multiplied by the number of its rows. A text's
features are all runs of one to ``order`` words; a feature's bucket is its CRC-32 modulo
``buckets``. The corpus's and the target's counts of each bucket give the bucket a gain, and a
text's weight is the floored mean gain of its features. Weights are joined back to rows by
the text's SHA-256; then each row draws Gumbel noise from its own doc_id, and the highest
sums of weight and noise are the resample, without replacement.

Only ``buckets`` pairs of counts meet on the driver. The text of a third of all rows is one
row a task before the exchange, and a skewed join after it, which AQE splits. Ranks come from
ranges of the order (``common.running``), so no task holds all rows.

Defined results: null and empty texts and texts without words have no features and weight 0;
fewer than ``least_words`` words: scored, never drawn; equal scores go to the smaller doc_id,
then a null one, then by the text's hash; a null doc_id draws the noise of an empty string;
repeated rows are rows each, with the same score; an empty table gives an empty table, an
empty target a gain from the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets_of(words: list[bytes], order: int, buckets: int) -> np.ndarray:
    """The bucket of each run of one to ``order`` words, from their running CRC-32."""
    runs = [crc32(w) for w in words]
    out = [np.array(runs, np.uint32)]
    for k in range(1, order):
        runs = [crc32(b" " + w, c) for c, w in zip(runs, words[k:])]
        out.append(np.array(runs, np.uint32))
    return np.concatenate(out) % np.uint32(buckets)


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def collapsed(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """key, copies, n_words and the buckets of the features (32 bits each) of each distinct
    text of the column ``text``."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            words = [WORD.findall(t.lower()) for t in p["text"]]
            yield {"key": p["key"], "copies": p["copies"], "n_words": [len(w) for w in words], "features": [buckets_of(w, order, buckets).tobytes() for w in words]}

    each = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return common.map_rows(each.select(digest().alias("key"), "copies", common.text_bytes()), rows, "key binary, copies bigint, n_words bigint, features binary", batch=500)


def bucket_counts(each: DataFrame, buckets: int) -> list[int]:
    """How many features of all rows are in each bucket."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros(buckets, np.int64)
        for p in parts:
            for copies, raw in zip(p["copies"], p["features"]):
                at, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                total[at] += n * copies
        at = np.flatnonzero(total)
        yield {"bucket": at.tolist(), "n": total[at].tolist()}

    sums = common.map_rows(each.select("copies", "features"), rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one added to
    each count."""
    b, s_all, t_all = len(corpus), sum(corpus), sum(target)
    ratio = lambda s, t: float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus, target)], np.int64)


def weighted(each: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features and weight of each distinct text."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            found = [np.frombuffer(raw, np.uint32) for raw in p["features"]]
            yield {"key": p["key"], "n_words": p["n_words"], "n_features": [len(f) for f in found], "weight": [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]}

    return common.map_rows(each.select("key", "n_words", "features"), rows, "key binary, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int, id_col: str) -> Column:
    """1,000 times a Gumbel draw, floored, from the row's identifier."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier, n_words, n_features, weight, score and the text's key of each row."""
    rows = docs.select(common.column(id_col).alias("doc_id"), common.column(text_col).alias("text"))
    each = common.written(collapsed(rows, order, buckets), "importance-texts")
    aim = collapsed(target.select(common.column(text_col).alias("text")), order, buckets)
    gain = gains(bucket_counts(each, buckets), bucket_counts(aim, buckets))
    own = rows.select("doc_id", digest().alias("key")).join(weighted(each, gain), "key")
    out = own.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, "doc_id")).alias("score"), "key")
    return out.withColumnRenamed("doc_id", id_col)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, order: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's identifier, n_words, n_features, weight, score and rank: 1, 2, 3... among
    the highest ``percent`` of rows with ``least_words`` words, else null."""
    found = common.written(scores(docs, target, order, buckets, seed, id_col, text_col), "importance-scores")
    fit = F.col("n_words") >= least_words
    draw = percent * found.filter(fit).count() // 100
    by = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("key")]
    placed = common.running(found, by, {"before": F.when(fit, 1).otherwise(0)}, "importance-order")
    rank = F.when(fit & (F.col("before") < draw), F.col("before") + 1).cast("long")
    return placed.select(id_col, "n_words", "n_features", "weight", "score", rank.alias("rank"))
