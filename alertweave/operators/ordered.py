"""Running totals and exact quantiles over an order of all rows, without one task for all.

Rows are dealt to ranges of a numeric order; a row's total is that of the ranges before its
own plus that within it, so the only window over everything sees a row for each range. The
ranges are split at quantiles of a sketch, so they hold about as many rows each, however the
values lie; only rows of one value are never split, and callers sum those first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import written

RANGES = 1024


def split_at(x: Column, edges: Column, ranges: int) -> Column:
    """How many of the sorted ``edges`` (``ranges`` - 1 of them) are less than ``x``, by
    halving; 0 without edges."""

    def halved(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less = F.get(edges, mid) < x
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_ & less, mid + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~less, mid).otherwise(a["high"]).alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.coalesce(F.size(edges), F.lit(0)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ranges.bit_length() + 1)), whole, halved)["low"]


def running(df: DataFrame, order: Column, sums: dict[str, Column], descending: bool = False, before: bool = False, ties: Sequence[Column] = (), ranges: int = RANGES) -> DataFrame:
    """``df`` with, for each of ``sums``, its total up to the row in ``order`` (``before``:
    without the row), and over all rows as ``<name>_all``. Rows that ``order`` and ``ties``
    don't tell apart get an arbitrary order among each other. A null order comes first."""
    x = order.cast("double")
    x = -x if descending else x
    own = df.withColumn("__x", x).withColumns({f"__s_{n}": c for n, c in sums.items()})
    edge = own.agg(F.percentile_approx("__x", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("__edges"))
    own = own.join(F.broadcast(edge)).withColumn("__range", F.when(F.col("__x").isNull(), -1).otherwise(split_at(F.col("__x"), F.col("__edges"), ranges))).drop("__edges")
    each = own.groupBy("__range").agg(*[F.sum(f"__s_{n}").alias(f"__r_{n}") for n in sums])
    earlier, every = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = each.select("__range", *[zero(F.sum(f"__r_{n}").over(earlier)).alias(f"__o_{n}") for n in sums], *[zero(F.sum(f"__r_{n}").over(every)).alias(f"{n}_all") for n in sums])
    inside = W.partitionBy("__range").orderBy("__x", *ties).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = own.withColumns({n: zero(F.sum(f"__s_{n}").over(inside)) for n in sums}).join(F.broadcast(each), "__range")
    out = out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums})
    return out.drop("__x", "__range", *[f"__{k}_{n}" for n in sums for k in "so"])


def quantiles(df: DataFrame, value: str, shares: Sequence[float], times: Column | None = None) -> DataFrame:
    """One row, q: the exact quantiles of a number at ``shares``, between neighbours by
    position. Equal values are counted first and the counts stored; each value then picks the
    ranks that are its. A row stands for ``times`` rows, one where that isn't given."""
    each = F.count("*") if times is None else F.sum(times)
    c = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(each.alias("c"))
    c = running(written(c, "values"), F.col("v"), {"upto": F.col("c")})
    at = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s, i: F.struct(i.alias("i"), (s * (F.col("upto_all") - 1)).alias("at")))
    ranks = F.flatten(F.transform(at, lambda a: F.array(F.struct(a["i"].alias("i"), a["at"].alias("at"), F.floor(a["at"]).alias("rank"), F.lit(0).alias("up")), F.struct(a["i"].alias("i"), a["at"].alias("at"), F.ceil(a["at"]).alias("rank"), F.lit(1).alias("up")))))
    mine = F.filter(ranks, lambda r: (r["rank"] >= F.col("upto") - F.col("c")) & (r["rank"] < F.col("upto")))
    hit = c.select("v", F.explode(mine).alias("r")).groupBy("r.i", "r.at").agg(F.max(F.when(F.col("r.up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("r.up") == 1, F.col("v"))).alias("b"))
    between = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    return hit.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"]).alias("q"))
