"""Projections and predicates over alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verdict classes that count as standing.
CLASSES = ("True Positive", "False Positive", "Benign Positive")


def slice_filter(df: DataFrame, start: str, end: str, instances: Sequence[str] = (), tenants: Sequence[str] = (), rules: Sequence[str] = (), time: str = "t") -> DataFrame:
    """Rows of the days from ``start`` to ``end``, both included; an empty list asks nothing."""
    out = df.filter((F.col(time) >= F.lit(start).cast("timestamp")) & (F.col(time) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    for column, wanted in (("instance", instances), ("tenant", tenants), ("rule", rules)):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    return out


def standing_verdicts(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "closed") & F.col("verdict").isin(*CLASSES))


def training_population(df: DataFrame, time: str = "t", tie: str = "container_id") -> DataFrame:
    """Standing verdicts that have a time, in order of it."""
    return standing_verdicts(df).filter(F.col(time).isNotNull()).orderBy(time, tie)


def rolled_up(text: Column) -> Column:
    """Free-text disposition to one of four classes; blank stays blank. Tests are ordered."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.trim(low) == "", "").when(low.contains("benign"), "Benign Positive").when(low.contains("false"), "False Positive")
        .when(low.contains("true") | low.contains("undetermined"), "True Positive").otherwise("Other")
    )


def artifact_family(json: Column) -> Column:
    """By the keys that an artifact has: notable, settings, soar_event, or notification."""
    keys = F.json_object_keys(json)
    has = lambda k: F.array_contains(keys, k)
    return F.when(has("SA_DISPOSITION"), "settings").when(has("soar_event"), "soar_event").when(has("rule_id"), "notable").otherwise("notification")


def first_notable(artifacts: Column) -> Column:
    """The first artifact with a rule_id that is neither settings nor an event, or null."""
    return F.get(F.filter(artifacts, lambda a: artifact_family(a) == "notable"), F.lit(0))


def non_null_columns(df: DataFrame) -> list[str]:
    """Columns with any value, from one pass of counts."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.select(*non_null_columns(df))


def marker_summary(df: DataFrame, text: str, time: str, markers: Sequence[str]) -> DataFrame:
    """marker, n, last_at of the rows whose text contains each marker. One pass: a row is
    exploded only to the markers that it holds."""
    held = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.col(text).contains(m))
    return df.select(F.explode(held).alias("marker"), time).groupBy("marker").agg(F.count("*").alias("n"), F.max(time).alias("last_at"))
