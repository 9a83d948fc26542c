"""Joins between alerts, their artifacts and their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; ``dropDuplicates`` promises no order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def label_left_join(left: DataFrame, right: DataFrame, key: str, right_order: Sequence[Column]) -> DataFrame:
    """Left join with the last row of each right key; only columns that the left side lacks
    are added, blank where there is no match."""
    extra = [c for c in right.columns if c not in left.columns]
    one = dedupe(right, [key], right_order).select(key, *extra)
    return left.join(one, key, "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in extra})


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Fails if a key is repeated on either side; the check runs with the join."""
    def single(df: DataFrame) -> DataFrame:
        n = F.count("*").over(W.partitionBy(key))
        checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(df.schema[key].dataType)).otherwise(F.col(key))
        return df.withColumn(key, checked)

    return single(left).join(single(right), key, how)


def regroup_artifacts(containers: DataFrame, artifacts: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Each container with the array of its artifacts in order; an empty array without any."""
    grouped = artifacts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, payload))), lambda s: s[payload]).alias("artifacts"))
    return containers.join(grouped, key, "left").withColumn("artifacts", F.coalesce("artifacts", F.array().cast("array<string>"))).withColumn("found", F.size("artifacts").cast("bigint"))


def validated_join(left: DataFrame, right: DataFrame, key: str, check: str) -> DataFrame:
    """Left join that holds only where ``check`` agrees on both sides; ``valid`` tells."""
    r = right.withColumnRenamed(check, "__check")
    return left.join(r, key, "left").withColumn("valid", F.coalesce(F.col("__check") == F.col(check), F.lit(False))).drop("__check")


def assign_parents(df: DataFrame) -> DataFrame:
    """For rows that aren't new: the earliest new row of the same customer and day, else of
    the same customer. df: id, customer, ts, verdict."""
    new = df.filter(F.col("verdict") == "NEW").select("customer", F.to_date("ts").alias("day"), F.struct("ts", "id").alias("x"))
    by_day = new.groupBy("customer", "day").agg(F.min("x").alias("d"))
    by_customer = by_day.groupBy("customer").agg(F.min("d").alias("c"))
    out = df.filter(F.col("verdict") != "NEW").withColumn("day", F.to_date("ts")).join(by_day, ["customer", "day"], "left").join(by_customer, "customer", "left")
    return out.select("id", "customer", F.coalesce("d.id", "c.id").alias("parent_id"))


def child_counts(parents: DataFrame) -> DataFrame:
    return parents.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))


def top_semi(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of the ``k`` most frequent keys, ties by key."""
    top = df.groupBy(key).count().orderBy(F.desc("count"), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def fp_pairs(df: DataFrame, key: str = "id", parent: str = "parent_id", among: DataFrame | None = None) -> DataFrame:
    """(duplicate, canonical) pairs with both sides' columns prefixed. Canonical rows are
    those of ``among``, if it is given, else of ``df``."""
    dup = df.filter(F.col(parent).isNotNull()).select(*[F.col(c).alias(f"dup_{c}") for c in df.columns])
    among = df if among is None else among
    can = among.select(*[F.col(c).alias(f"can_{c}") for c in among.columns])
    return dup.join(can, F.col(f"dup_{parent}") == F.col(f"can_{key}"))


def report_mismatch(regrouped: DataFrame, reported: str = "reported") -> DataFrame:
    """Containers that report artifacts of which none was found."""
    return regrouped.filter((F.col(reported) > 0) & (F.col("found") == 0))


def of_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_semi")
