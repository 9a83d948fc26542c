"""Array expressions in time linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. An expression named inside a lambda is
    computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column, block: int = 256) -> Column:
    """For each of an array of whole numbers the sum of those before it. Appending copies the
    array, so that is done within blocks, and once more for the blocks' own sums."""
    none = F.array().cast("array<bigint>")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def inside(xs: Column, start: Column) -> Column:
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("sum"), none.alias("out")), step)["out"]

    def blocks(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda i: F.slice(xs, i * block + 1, F.lit(block)))
        return let(cut, lambda bs: F.flatten(F.zip_with(bs, inside(F.transform(bs, total), F.lit(0).cast("bigint")), inside)))

    longs = F.transform(values, lambda x: x.cast("bigint"))
    return F.when(F.size(values) > 0, let(longs, blocks)).otherwise(none)
