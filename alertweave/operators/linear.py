"""A linear log-loss classifier by averaged stochastic gradient, in distributed passes.

Rows are dealt to ``workers`` streams by a hash of their identifier and ordered by another,
so the same rows give the same model however they are stored. In a pass every stream starts
from the common weights and takes a step a row (L2 penalty, step 1 / (alpha (t0 + t))); then
the streams' weights are averaged by their rows, and so are all weights that any step has
left behind, which are the model. Rows are dealt and sorted once and kept on the executors'
disks for all passes. With one stream this is the plain algorithm. Streams meet
in a grouped sum by feature, so the driver gets ``size`` rows a pass, whatever the input.

Features are lists of indices (below ``size``) and values. Defined results: null lists have
no features; a null label is left out of fitting; without rows the weights are 0 and every
score is 0.5."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.storagelevel import StorageLevel

#: The most features: weights go to every task.
MOST = 1 << 24


def first_step(alpha: float) -> float:
    """t0: the first step is of the size that weights typically have."""
    typical = math.sqrt(1.0 / math.sqrt(alpha))
    return 1.0 / (typical * alpha)


class Stream:
    """Stochastic gradient from given weights. Weights are scale * v; the sum of all weights
    so far is passed * v - owed, so that a step touches a row's own features only."""

    def __init__(self, weights: np.ndarray, bias: float, alpha: float, t: int):
        self.v, self.scale, self.bias, self.alpha, self.t = weights.copy(), 1.0, bias, alpha, t
        self.owed, self.passed, self.bias_sum, self.rows = np.zeros_like(self.v), 0.0, 0.0, 0
        self.t0 = first_step(alpha)

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        eta = 1.0 / (self.alpha * (self.t0 + self.t))
        z = self.scale * float(self.v[at] @ x) + self.bias
        g = 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z)))) - y
        self.scale *= 1.0 - eta * self.alpha
        if self.scale < 1e-6:
            self.owed -= self.passed * self.v
            self.v *= self.scale
            self.scale, self.passed = 1.0, 0.0
        d = -eta * g * x / self.scale
        np.add.at(self.v, at, d)
        np.add.at(self.owed, at, self.passed * d)
        self.passed += self.scale
        self.bias -= eta * g
        self.bias_sum += self.bias
        self.t += 1
        self.rows += 1

    def sums(self) -> np.ndarray:
        return self.passed * self.v - self.owed


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's list, as a view of the batch's values; of a null list an empty one."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield values[ends[i] : ends[i + 1] if valid[i] else ends[i]]


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float

    def scored(self, df: DataFrame, name: str = "score", indices: str = "indices", values: str = "values") -> DataFrame:
        """``df`` with the chance of label 1."""
        sent = df.sparkSession.sparkContext.broadcast((self.weights, self.bias))
        schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
        where = (df.columns.index(indices), df.columns.index(values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = sent.value
            for batch in batches:
                out = []
                for at, x in zip(*(lists(batch.column(c)) for c in where)):
                    z = (float(w[at] @ x) if len(at) else 0.0) + b
                    out.append(1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z)))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

        return df.mapInArrow(run, schema)


def averaged_sgd(df: DataFrame, id_col: str, size: int, label: str = "label", indices: str = "indices", values: str = "values", alpha: float = 1e-5, passes: int = 5, workers: int = 32, seed: int = 42) -> LinearModel:
    """Fits a model on the rows of ``df``."""
    if size > MOST:
        raise ValueError(f"at most {MOST} features: weights go to every task")
    key = F.col(id_col).cast("string")
    hash_ = lambda k: F.xxhash64(F.lit(seed), F.lit(k), key)
    rows = df.filter(F.col(label).isNotNull()).select(F.pmod(hash_(0), F.lit(workers)).cast("int").alias("w"), hash_(1).alias("o"), key.alias("k"), F.col(label).cast("double").alias("y"), F.col(indices).alias("at"), F.col(values).alias("x"))
    rows = rows.repartition(workers, "w").sortWithinPartitions("w", "o", "k").select("w", "y", F.col("at").cast("array<int>").alias("at"), F.col("x").cast("array<double>").alias("x"))
    dealt = rows.persist(StorageLevel.DISK_ONLY)
    weights, bias = np.zeros(size), 0.0
    total, bias_total, steps = np.zeros(size), 0.0, 0
    spark = df.sparkSession
    for turn in range(passes):
        sent = spark.sparkContext.broadcast((weights, bias, steps // max(1, workers) if workers > 1 else steps))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            w0, b0, t = sent.value
            stream, at_worker = None, None

            def out() -> pa.RecordBatch:
                w, s = stream.scale * stream.v, stream.sums()
                at = np.flatnonzero((w != 0) | (s != 0))
                return pa.RecordBatch.from_pydict({
                    "i": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.full(len(at) + 1, stream.rows), pa.int64()),
                    "w": pa.array(np.append(w[at], stream.bias) * stream.rows), "s": pa.array(np.append(s[at], stream.bias_sum)),
                })

            for batch in batches:
                for worker, y, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2)), lists(batch.column(3))):
                    if worker != at_worker:
                        if stream is not None:
                            yield out()
                        stream, at_worker = Stream(w0, b0, alpha, t), worker
                    stream.step(at, x, y)
            if stream is not None:
                yield out()

        each = dealt.mapInArrow(run, "i int, n bigint, w double, s double")
        # in order of the stream, as sums of doubles depend on it
        found = each.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("w", "s", "n"))).alias("x"))
        add = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + v[f])
        summed = found.select("i", add("w").alias("w"), add("s").alias("s"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v["n"]).alias("n")).collect()
        n = next((r.n for r in summed if r.i == -1), 0)
        if not n:
            break
        weights = np.zeros(size)
        for r in summed:
            if r.i == -1:
                bias, bias_total = r.w / n, bias_total + r.s
            else:
                weights[r.i] = r.w / n
                total[r.i] += r.s
        steps += n
    dealt.unpersist()
    return LinearModel(total / max(1, steps), bias_total / max(1, steps))


def hashed_features(df: DataFrame, id_col: str, words: Column, size: int) -> DataFrame:
    """``df`` with indices and values of each row's bag of words: the square root of each
    hashed word's share. Words are counted by (row, index), so a long text is no long
    expression. ``id_col`` tells rows apart; a row without words has null lists."""
    each = df.select(id_col, F.explode(words).alias("__w"))
    counts = each.groupBy(id_col, F.pmod(F.xxhash64("__w"), F.lit(size)).cast("int").alias("__i")).agg(F.count("*").alias("__n"))
    found = counts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__i", "__n"))).alias("__x"), F.sum("__n").alias("__all"))
    values = F.transform("__x", lambda x: F.sqrt(x["__n"] / F.col("__all")))
    return df.join(found.select(id_col, F.transform("__x", lambda x: x["__i"]).alias("indices"), values.alias("values")), id_col, "left")
