"""Term weights as lists in their document's row, and as an inverted table: (document, term, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..storage import written

COMMON, SALTS = 1000, 64
PART = 1 << 18  # terms of a batch that are taken at once
LEFT = StructType().add("term", StringType()).add("tf", IntegerType())
WEIGHED = StructType().add("term", StringType()).add("weight", DoubleType())


@dataclass
class Matched:
    """``known``: key, ids, tfs, squares (of the weights, summed up), a row for each document;
    an id is a place in ``terms``, which has the most frequent ones, and in ``idf``. ``rest``: key, term, tf, weight of the others, if there are any."""

    known: DataFrame
    rest: DataFrame | None
    terms: pa.Array
    idf: np.ndarray


def words(text: Column) -> Column:
    """Lower-case words of two characters or more, accents removed where they combine."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def weights(docs: DataFrame, key: str, tokens: Column, grams: int = 2, min_df: int = 2, few: int = 200_000) -> DataFrame:
    """(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length for each document; terms in
    fewer than ``min_df`` documents are left out."""
    m = matched(docs, key, tokens, grams, min_df, few)
    return flat(listed(m, key), m, key)


def term_numbers(docs: DataFrame, key: str, tokens: Column, grams: int = 2) -> DataFrame:
    """How many of a document's terms another one has too, by document that has any. Terms are
    dealt out once, with a document of theirs; those of one document alone are taken off."""
    t, own = _terms(docs, key, tokens, grams)[0], F.array_distinct("terms")
    alone = t.select(key, F.explode(own).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.min(key).alias("of")).filter("df = 1").groupBy("of").agg(F.count("*").alias("alone"))
    numbers = t.select(key, F.size(own).cast("long").alias("terms")).join(alone, F.col(key).eqNullSafe(F.col("of")), "left")
    return numbers.select(key, (F.col("terms") - F.coalesce("alone", F.lit(0))).alias("terms")).filter("terms > 0")


def _terms(docs: DataFrame, key: str, tokens: Column, grams: int) -> tuple[DataFrame, int]:
    """Key and terms, a row for each document, and the number of keys. Rows that share a key
    are one document and have to meet first."""
    t = docs.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("w"))
    terms = F.col("w")
    for n in range(2, grams + 1):
        pairs = F.when(F.size("w") >= n, _grams(n)).otherwise(F.array().cast("array<string>"))
        terms = F.concat(terms, pairs)
    t = t.select(key, terms.alias("terms"))
    rows, n = docs.select(F.count("*"), F.count_distinct(key)).first()
    if rows > n:
        t = written(t.groupBy(key).agg(F.flatten(F.collect_list("terms")).alias("terms")), "documents")
    return t, n


def matched(docs: DataFrame, key: str, tokens: Column, grams: int, min_df: int, few: int) -> Matched:
    """The terms of documents, with what their weights need. The most frequent go with the
    tasks: those from the least power of two on that no more than ``few`` reach. They meet the
    documents in their rows. Only what is left moves, to join the rest as an ordinary table;
    should it have terms of at least a ``COMMON``-th of all documents, these are joined in
    ``SALTS`` parts each."""
    t, n = _terms(docs, key, tokens, grams)
    df = written(t.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df), "terms")
    least = _least(df, few)
    often = df.filter(F.col("df") >= least).orderBy(F.desc("df"), "term").toArrow().combine_chunks()
    idf = np.log((1 + n) / (1 + often["df"].to_numpy())) + 1
    m = Matched(t, None, pa.array(often["term"].to_pylist(), pa.string()), idf)
    m.known = t.mapInArrow(_met(key, m.terms, idf, least > 0), StructType([t.schema[key], StructField("ids", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType())), StructField("squares", DoubleType()), StructField("left", ArrayType(LEFT))]))
    if least == 0:
        return m
    m.known = written(m.known, "known-terms")
    left = m.known.select(key, F.inline("left"))
    hot = F.col("df") * COMMON >= n
    met = None
    if least * COMMON > n:
        parts = df.filter(hot & (F.col("df") < least)).select("term", F.col("df").alias("often"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met, left = _split(left.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(parts, ["term", "salt"], "left"), key)
    cold = left.join(df.filter(~hot & (F.col("df") < least)), "term").select(key, "term", "tf", "df")
    met = cold if met is None else met.unionByName(cold)
    m.rest = met.select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("weight"))
    return m


def _met(key: str, known: pa.Array, idf: np.ndarray, more: bool):
    """From key, terms to key, ids, tfs, squares and left: the terms that aren't known, if these count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                lists = part.column(1)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy().astype(np.int64))
                coded = lists.flatten().dictionary_encode()
                words = coded.dictionary
                place = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                # known terms by place, the others behind them by their own code
                code = np.where(place >= 0, place, len(known) + np.arange(len(words)))[coded.indices.to_numpy()]
                wide = len(known) + len(words)
                pairs, tf = np.unique(row * wide + code, return_counts=True)
                row, code = pairs // wide if wide else pairs, pairs % wide if wide else pairs
                own = code < len(known)
                weight = (1 + np.log(tf[own])) * idf[code[own]]
                columns = [part.column(0), _lists(row[own], code[own], len(lists)), _lists(row[own], tf[own], len(lists)), pa.array(np.bincount(row[own], weight * weight, len(lists)).astype(np.float64))]
                other = ~own & more
                strings = words.take(pa.array(code[other] - len(known)))
                columns.append(pa.ListArray.from_arrays(_offsets(row[other], len(lists)), pa.StructArray.from_arrays([strings, pa.array(tf[other], pa.int32())], names=LEFT.names)))
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "tfs", "squares", "left"])

    return run


def _offsets(row: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(_offsets(row, rows), pa.array(values, pa.int32()))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of about ``PART`` list entries."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    starts = np.flatnonzero(np.diff(ends, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def listed(m: Matched, key: str) -> DataFrame:
    """key, ids, tfs, rare, length: a document's known terms, its others with their weights, and
    the length that makes all its weights a unit."""
    if m.rest is None:
        return m.known.select(key, "ids", "tfs", F.lit(None).cast(ArrayType(WEIGHED)).alias("rare"), F.sqrt("squares").alias("length"))
    rare = m.rest.groupBy(F.col(key).alias("of")).agg(F.collect_list(F.struct("term", "weight")).alias("rare"))
    both = m.known.select(key, "ids", "tfs", "squares").join(rare, F.col(key).eqNullSafe(F.col("of")), "left")
    more = F.coalesce(F.aggregate("rare", F.lit(0.0), lambda total, x: total + x["weight"] * x["weight"]), F.lit(0.0))
    return both.select(key, "ids", "tfs", "rare", F.sqrt(F.col("squares") + more).alias("length"))


def flat(lists: DataFrame, m: Matched, key: str) -> DataFrame:
    """key, term, weight of ``listed`` documents."""
    known, idf = m.terms, m.idf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                row, ids, weight = _weighed(part, idf)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), known.take(pa.array(ids)), pa.array(weight)], names=[key, *WEIGHED.names])

    rows = lists.select(key, "ids", "tfs", "length").mapInArrow(run, StructType([lists.schema[key], *WEIGHED]))
    return rows if m.rest is None else rows.unionByName(_rare(lists, key))


def _rare(lists: DataFrame, key: str) -> DataFrame:
    return lists.select(key, "length", F.inline("rare")).select(key, "term", (F.col("weight") / F.col("length")).alias("weight"))


def _weighed(part: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and weight of the known terms of key, ids, tfs, length."""
    row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy().astype(np.int64))
    ids, tf = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
    return row, ids, (1 + np.log(tf)) * idf[ids] / part.column(3).to_numpy()[row]


def _least(df: DataFrame, few: int) -> int:
    """The least power of two that at most ``few`` terms reach, 0 if these are all terms."""
    counts = {r.bits: r.n for r in df.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= few:
        return 0
    bits, seen = 63, 0
    while seen + counts.get(bits, 0) <= few:
        seen += counts.get(bits, 0)
        bits -= 1
    return 1 << bits


def _split(marked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose term is known by now, with its df, and the others."""
    known = marked.filter("often is not null").select(key, "term", "tf", F.col("often").alias("df"))
    return known, marked.filter("often is null").select(key, "term", "tf")


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))


def top_terms(weights: DataFrame, coefficients: DataFrame, key: str, k: int = 12, few: int = 200_000) -> DataFrame:
    """The ``k`` terms of each document that move its score most, with their share. Up to
    ``few`` coefficients are broadcast, so that only each task's best of a document move."""
    own = written(coefficients.select("term", "coef"), "coefficients")
    c = weights.join(F.broadcast(own) if own.count() <= few else own, "term").withColumn("contribution", F.round(F.col("weight") * F.col("coef"), 9))
    return _first(c, key, k)


def top_listed(lists: DataFrame, m: Matched, coefficients: DataFrame, key: str, k: int = 12) -> DataFrame:
    """``top_terms`` of ``listed`` documents: a document's known terms meet their coefficients
    in its row, and only its best move, besides its rare ones."""
    own = written(coefficients.select("term", "coef"), "coefficients")
    ids = lists.sparkSession.createDataFrame(pa.table({"term": m.terms, "id": pa.array(np.arange(len(m.terms)), pa.int32())}))
    known = own.join(F.broadcast(ids), "term").select("id", "coef").toArrow()
    coef = np.full(len(m.terms), np.nan)
    coef[known["id"].to_numpy()] = known["coef"].to_numpy()
    idf, terms = m.idf, m.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                row, ids, weight = _weighed(part, idf)
                has = ~np.isnan(coef[ids])
                row, ids, c = row[has], ids[has], (weight * coef[ids])[has]
                order = np.lexsort((-np.abs(c), row))
                row, ids, c = row[order], ids[order], c[order]
                # none whose rounded contribution can be among the first k is left out
                last = np.minimum(np.searchsorted(row, row) + k, np.searchsorted(row, row, "right")) - 1
                kept = np.abs(c) >= np.abs(c[last]) - 1e-8
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[kept])), terms.take(pa.array(ids[kept])), pa.array(c[kept])], names=[key, "term", "contribution"])

    c = lists.select(key, "ids", "tfs", "length").mapInArrow(run, StructType([lists.schema[key], StructField("term", StringType()), StructField("contribution", DoubleType())]))
    if m.rest is not None:
        rare = _rare(lists, key).join(own.join(F.broadcast(ids), "term", "anti"), "term")
        c = c.unionByName(rare.select(key, "term", (F.col("weight") * F.col("coef")).alias("contribution")))
    return _first(c.withColumn("contribution", F.round("contribution", 9)), key, k)


def _first(contributions: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "term"))
    return contributions.withColumn("rank", rank).filter(F.col("rank") <= k).select(key, "term", "contribution", "rank")
