"""Entity spans from tagged tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

SPAN = StructType().add("label", StringType()).add("start", LongType()).add("end", LongType()).add("score", DoubleType()).add("value", StringType())
LISTED = 50_000  # spans of a batch from which on it is handed over


def merged_spans(tokens: DataFrame, texts: DataFrame, key: str, least: float, trusted: Sequence[str]) -> DataFrame:
    """key, label, start, end, score, value of each entity.

    tokens: key, pos, start, end, tag (O, B-X, I-X), score; texts: key, text. An entity begins
    at a B, at another label, or after an O, and goes on through its I tokens; its score is
    the least of theirs. Tokens of no width are no tokens. Entities of untrusted labels, under
    the least score, or blank are left out. ``start`` and ``end`` are characters of the text
    as tagged; the value is trimmed. A text meets the list of its spans, once, after merging."""
    t = tokens.filter("start <> end").withColumn("kind", F.nullif(F.regexp_extract("tag", r"^[^-]*-(.+)$", 1), F.lit("")))
    t = t.withColumn("kind", F.when(F.regexp_extract("tag", "^([^-]*)", 1) != "O", F.col("kind")))
    w = W.partitionBy(key).orderBy("pos")
    opens = F.col("kind").isNotNull() & (F.col("tag").startswith("B-") | ~F.lag("kind").over(w).eqNullSafe(F.col("kind")))
    t = t.withColumn("opens", opens.cast("int")).withColumn("no", F.sum("opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = t.filter("kind is not null").groupBy(key, "no", F.col("kind").alias("label")).agg(F.min("start").alias("start"), F.max_by("end", "pos").alias("end"), F.min("score").alias("score"))
    spans = spans.filter((F.col("score") >= least) & F.col("label").isin(*trusted))
    return cut(spans.select(key, "label", "start", "end", "score"), texts.select(key, "text"), key)


def cut(spans: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``spans`` with the trimmed stretch of the key's text, blank ones left out. A text is
    decoded once and cut by place: to cut it in a column would walk from its beginning for
    each span, which is quadratic in a text's length."""
    own = [f for f in spans.schema.fields if f.name != key]
    listed = spans.groupBy(key).agg(F.collect_list(F.struct(*[f.name for f in own])).alias("spans"))
    met = listed.join(texts, key).select(key, "text", "spans")
    schema = StructType([spans.schema[key], *own, StructField("value", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, every = batch.column(2), batch.column(2).flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            columns = dict(zip([f.name for f in own], every.flatten()))
            texts = batch.column(1).to_pylist()
            values = [None if texts[i] is None else texts[i][s:e].strip(" ") for i, s, e in zip(row.tolist(), columns["start"].to_pylist(), columns["end"].to_pylist())]
            kept = pa.array(np.flatnonzero([bool(v) for v in values]), pa.int64())
            out = [batch.column(0).take(pa.array(row)), *columns.values(), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in out], names=[f.name for f in schema.fields])

    return met.mapInArrow(run, schema)


def listed_spans(docs: DataFrame, key: str, tag: Callable[[str], tuple], labels: Sequence[str], least: float, trusted: Sequence[str]) -> DataFrame:
    """key, spans: the entities of ``merged_spans`` by place, one row for each row of ``docs``
    (key, text) that has any. A text is tagged, merged and cut where it is read, so neither
    texts nor tokens move.

    ``tag`` takes a text and returns arrays with an entry for each token, in order: start, end,
    kind (the place of its label in ``labels``, -1: O), begins (B), score."""
    wanted = np.array([x in trusted for x in labels], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, found, values = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                if (text := text.as_py()) is not None:
                    kind, start, end, score = _merged(*tag(text))
                    kept = wanted[kind] & (score >= least)
                    cuts = [text[s:e].strip(" ") for s, e in zip(start[kept].tolist(), end[kept].tolist())]
                    filled = np.array([bool(v) for v in cuts], bool)
                    if filled.any():
                        rows.append(i)
                        sizes.append(int(filled.sum()))
                        found.append([x[kept][filled] for x in (kind, start, end, score)])
                        values += filter(None, cuts)
                if len(values) >= LISTED or rows and i + 1 == batch.num_rows:
                    kind, start, end, score = map(np.concatenate, zip(*found))
                    columns = [pa.array(labels, pa.string()).take(pa.array(kind)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64()), pa.array(values, pa.string())]
                    spans = pa.StructArray.from_arrays(columns, names=SPAN.names)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), spans)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=[key, "spans"])
                    rows, sizes, found, values = [], [], [], []

    return docs.select(key, "text").mapInArrow(run, StructType([docs.schema[key], StructField("spans", ArrayType(SPAN))]))


def _merged(start: np.ndarray, end: np.ndarray, kind: np.ndarray, begins: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, start, end and score of each entity of a text's tokens."""
    wide = start != end
    start, end, kind, begins, score = (x[wide] for x in (start, end, kind, begins, score))
    inside = kind >= 0
    opens = (inside & (begins | (np.concatenate([[-1], kind[:-1]]) != kind)))[inside]
    start, end, kind, score = (x[inside] for x in (start, end, kind, score))
    first = np.flatnonzero(opens)
    if not len(first):
        return kind, start, end, score
    return kind[first], np.minimum.reduceat(start, first), end[np.append(first[1:], len(end)) - 1], np.minimum.reduceat(score, first)


def listed_values(listed: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """``value_lists`` of the lists of ``listed_spans``, each from its own row."""
    each = listed.select(key, "spans", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    of_label = lambda s: s["label"] == F.col("label")
    own = F.transform(F.filter("spans", of_label), lambda s: s["value"])
    return each.filter(F.exists("spans", of_label)).select(key, "label", F.array_sort(F.array_distinct(own)).alias("entries"))


def value_lists(spans: DataFrame, key: str) -> DataFrame:
    """The distinct values of each label, sorted."""
    return spans.groupBy(key, "label").agg(F.array_sort(F.collect_set("value")).alias("entries"))
