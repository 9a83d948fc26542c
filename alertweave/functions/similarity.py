"""Similarity of texts, value sets and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a machine word of the longer text at a time (bit-parallel)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.lower().split()))


def token_sort_score(a: str | None, b: str | None) -> float | None:
    """100 * (1 - insertions and deletions / both lengths) of the sorted lower-case tokens."""
    if a is None or b is None:
        return None
    a, b = sorted_tokens(a), sorted_tokens(b)
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_score(x, y) for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _packed(rows: DataFrame, block: int, at: str) -> DataFrame:
    """Blocks of up to ``block`` unit vectors of one width, with their ids, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_width: dict[int, list] = {}
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if v and None not in v:
                    by_width.setdefault(len(v), []).append((k, v))
            for width, own in by_width.items():
                for i in range(0, len(own), block):
                    part = own[i : i + block]
                    m = np.array([v for _, v in part], np.float64)
                    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
                    m = m / np.where(length > 0, length, np.nan)
                    ids = np.array([k or 0 for k, _ in part], np.int64)
                    known = np.array([k is not None for k, _ in part])
                    yield pa.RecordBatch.from_pydict({f"{at}w": pa.array([width], pa.int32()), f"{at}i": [ids.tobytes()], f"{at}k": [known.tobytes()], f"{at}v": [m.tobytes()]})

    return rows.mapInArrow(run, f"{at}w int, {at}i binary, {at}k binary, {at}v binary")


#: Vectors of a side of the grid that ``cosine_counts`` deals pairs of vectors to.
SIDE = 1 << 18


def cosine_counts(queries: DataFrame, vectors: DataFrame, least: float, block: int = 1024, deals: int | None = None, query_deals: int | None = None) -> DataFrame:
    """a, n for each id of ``queries``: how many rows of ``vectors`` with another id have a
    cosine of at least ``least``, 0 where none has. Both have id and vector columns, in this
    order. All pairs are compared, a block of queries with a block of vectors at a time, on a
    grid: blocks of vectors are dealt to ``deals`` columns and blocks of queries to
    ``query_deals`` rows, and a cell compares its own. Both follow the numbers of vectors, so
    a cell's work is bounded whatever they are.

    Null vectors, vectors of other widths and vectors of length 0 match nothing; a null id
    differs from each id and is never a query; rows that repeat count each."""
    q, v = queries.toDF("a", "v").filter("a is not null"), vectors.toDF("b", "v")
    deals = deals or max(32, -(-v.count() // SIDE))
    query_deals = query_deals or max(1, -(-q.count() // SIDE))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qs = _packed(q, block, "q").withColumn("row", dealt(query_deals, "qi", "qv")).withColumn("deal", each(deals))
    vs = _packed(v, block, "v").withColumn("deal", dealt(deals, "vi", "vv")).withColumn("row", each(query_deals))
    met = qs.join(vs.hint("merge"), (qs["deal"] == vs["deal"]) & (qs["row"] == vs["row"]) & (qs["qw"] == vs["vw"])).select("qw", "qi", "qv", "vi", "vk", "vv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, qi, qv, vi, vk, vv = (batch.column(c)[i].as_py() for c in range(6))
                a, b, known = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64), np.frombuffer(vk, bool)
                near = np.frombuffer(qv).reshape(-1, width) @ np.frombuffer(vv).reshape(-1, width).T >= least
                near &= (a[:, None] != b[None, :]) | ~known[None, :]
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "n": pa.array(near.sum(axis=1).astype(np.int64))})

    found = met.mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    ids = q.select(F.col("a").cast("bigint").alias("a")).distinct()
    return ids.join(found, "a", "left").select("a", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
