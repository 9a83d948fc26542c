"""What stands before a row among those of its key, where a key may hold most of all rows.

A window gives a key to one task. Here rows are dealt to segments by ranges of (key, t,
container_id), whose splitters Spark draws from a sample, so a hot key spans as many segments
as it needs and all hold about as many rows. A segment's rows of a key are reduced to a state
that can be joined to the next one's: sums, the last value, the length of the run at its end,
the highest sum. States are carried over the segments of a key, a row for each, and a row's
result is what is carried to its segment together with what stands before it inside.

A plain window is taken where no key has over ``HOT`` rows; a count by key tells. Nulls in
keys are a key of their own; a null t comes first, as in a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import written

HOT = 1_000_000
ORDER = ("t", "container_id")


class Scan:
    """Rows of ``df`` by ``keys`` in order of ``ORDER``."""

    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.keys = list(keys)
        most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        self.segmented = (most or 0) > HOT
        if self.segmented:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            df = written(df.repartitionByRange(parts, *keys, *ORDER).withColumn("__part", F.spark_partition_id()), "scan")
        self.df = df
        own = [*self.keys, "__part"] if self.segmented else self.keys
        self.inside = W.partitionBy(*own).orderBy(*ORDER)
        self.before = self.inside.rowsBetween(W.unboundedPreceding, -1)
        self.segments = W.partitionBy(*self.keys).orderBy("__part")
        self.earlier = self.segments.rowsBetween(W.unboundedPreceding, -1)

    def states(self, **columns: Column) -> DataFrame:
        """A row for each key and segment."""
        return self.df.groupBy(*self.keys, "__part").agg(*[c.alias(n) for n, c in columns.items()])

    def carried(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """``df`` with the further columns of ``carry`` (keys, __part, ...), by segment."""
        names = {c: f"__of_{c}" for c in [*self.keys, "__part"]}
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        return df.join(carry.withColumnsRenamed(names), same).drop("__part", *names.values())

    def sums_before(self, sums: dict[str, Column]) -> DataFrame:
        """``df`` with, for each of ``sums``, its total over the key's earlier rows."""
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        out = self.df.withColumns({f"__v_{n}": c for n, c in sums.items()})
        out = out.withColumns({n: zero(F.sum(f"__v_{n}").over(self.before)) for n in sums})
        if self.segmented:
            each = self.states(**{f"__s_{n}": F.sum(c) for n, c in sums.items()})
            carry = each.select(*self.keys, "__part", *[zero(F.sum(f"__s_{n}").over(self.earlier)).alias(f"__c_{n}") for n in sums])
            out = self.carried(out, carry).withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in sums})
        return out.drop(*[f"__{k}_{n}" for n in sums for k in "vc"])

    def last_before(self, name: str, column: str, default: str | None) -> DataFrame:
        """``df`` with the value of ``column`` in the key's row before; ``default`` for the
        first."""
        if not self.segmented:
            return self.df.withColumn(name, F.lag(column, 1, default).over(self.inside))
        at = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in ORDER])
        last = self.states(__last=F.max_by(F.struct(column), at))
        carry = last.select(*self.keys, "__part", F.lag("__last").over(self.segments).alias("__carry"))
        out = self.df.withColumn("__own", F.lag(F.struct(column)).over(self.inside))
        value = F.coalesce("__own", "__carry", F.struct(F.lit(default).cast(self.df.schema[column].dataType).alias(column)))
        return self.carried(out, carry).withColumn(name, value[column]).drop("__own", "__carry")

    def run_before(self, name: str, hit: Column) -> DataFrame:
        """``df`` with how many rows right before it ``hit``, up to the last that didn't."""
        out = self.df.withColumn("__hit", F.coalesce(hit, F.lit(False)).cast("int"))
        out = out.withColumn("__island", F.coalesce(F.sum(1 - F.col("__hit")).over(self.before), F.lit(0)))
        own = [*self.keys, "__part"] if self.segmented else self.keys
        inside = W.partitionBy(*own, "__island").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(name, F.coalesce(F.sum("__hit").over(inside), F.lit(0)).cast("long"))
        if self.segmented:
            # the run at a segment's end: the hits of its last island
            ends = out.groupBy(*self.keys, "__part", "__island").agg(F.sum("__hit").alias("hits"), F.min("__hit").alias("least"))
            last = ends.groupBy(*self.keys, "__part").agg(F.max(F.struct("__island", "hits", "least")).alias("x"))
            # a miss ends its island, so a last island with one leaves no run
            state = last.select(*self.keys, "__part", (F.col("x.least") == 1).alias("open"), F.when(F.col("x.least") == 1, F.col("x.hits")).otherwise(0).alias("tail"), (F.col("x.__island") > 0).alias("broken"))
            state = state.withColumn("breaks", F.sum((F.col("broken") | ~F.col("open")).cast("int")).over(self.segments.rowsBetween(W.unboundedPreceding, 0)))
            upto = F.sum("tail").over(W.partitionBy(*self.keys, "breaks").orderBy("__part").rowsBetween(W.unboundedPreceding, 0))
            state = state.withColumn("upto", upto)
            carry = state.select(*self.keys, "__part", F.coalesce(F.lag("upto").over(self.segments), F.lit(0)).alias("__carry"))
            out = self.carried(out, carry).withColumn(name, F.col(name) + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(0)).drop("__carry")
        return out.drop("__hit", "__island")

    def below_high(self, name: str, step: Column) -> DataFrame:
        """``df`` with how far the sum of ``step`` over the key's earlier rows stands below
        the highest such sum of a row up to this one."""
        out = self.df.withColumn("__step", step)
        out = out.withColumn("__s", F.coalesce(F.sum("__step").over(self.before), F.lit(0)))
        out = out.withColumn("__high", F.max("__s").over(self.inside.rowsBetween(W.unboundedPreceding, 0)))
        if self.segmented:
            each = out.groupBy(*self.keys, "__part").agg(F.sum("__step").alias("sum"), F.max("__s").alias("high"))
            each = each.withColumn("__start", F.coalesce(F.sum("sum").over(self.earlier), F.lit(0)))
            each = each.withColumn("__top", F.max(F.col("__start") + F.col("high")).over(self.earlier))
            out = self.carried(out, each.select(*self.keys, "__part", "__start", "__top"))
            out = out.withColumn("__s", F.col("__start") + F.col("__s")).withColumn("__high", F.greatest(F.col("__start") + F.col("__high"), "__top")).drop("__start", "__top")
        return out.withColumn(name, (F.col("__high") - F.col("__s")).cast("long")).drop("__step", "__s", "__high")
