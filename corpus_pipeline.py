"""The corpus pipeline: quality, near duplicates, contamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows that it is given, and returns a
DataFrame; all but the last return the columns of documents. Further columns of docs,
whatever their names and types, are kept by all stages but the last.

Defined results: a null or empty text is scored like any other, is no near duplicate, is not
contaminated, and gives the mix nothing, so it ends there; a null doc_id is kept as it is;
repeated rows are rows each, but one of a group of near duplicates stays; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm import common, decontamination, mixing, near_dedup, quality_model, sharding


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and text, and all columns under names of our own."""
    names = [f"__k{i}" for i in range(len(docs.columns))]
    return docs.select("doc_id", "text", *[common.column(c).alias(n) for c, n in zip(docs.columns, names)]), names


def _back(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores under 0.7."""
    model = quality_model.fitted(docs, common.table(spark, sf_dir, "labels"))
    aside, names = _aside(docs)
    return _back(quality_model.scored(aside, model, carry=names).filter("score >= 0.7"), names, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (similarity 0.8 or more), that of
    the least doc_id."""
    return near_dedup.deduplicated(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth is benchmark text."""
    aside, names = _aside(docs)
    found = decontamination.contamination(aside, common.table(spark, sf_dir, "benchmark"), carry=names)
    return _back(decontamination.judged(found).filter(~F.col("contaminated")), names, docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold the words that the mix takes: a row for what one of its output shards takes
    of a document in a pass over the source, so what is taken twice comes in two rows."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return sharding.shards(docs, leaves=8).withColumnRenamed("crc", "text_crc32")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The trained model, the signatures and the hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
