"""Shared plumbing: reading tables, cutting lineage, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DataType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode
    may a session have none; then it is a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark, "_llm_shared_dir", None) or f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        spark._llm_shared_dir = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that a lost executor costs
    a re-read instead of the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[F.Column], sums: dict[str, F.Column], name: str) -> DataFrame:
    """``df`` with, for each of ``sums``, its total over the rows before in ``order``, which
    must be a total order. Rows are range partitioned; a range's offset is the sum of the
    ranges before it, so only a row for each range meets in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    each = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = each.select(F.col("__part"), *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(offsets, "__part")
    total = lambda n, c: F.coalesce(F.col(n), F.lit(0).cast(out.schema[n].dataType)) + F.coalesce(F.col(f"__{n}"), F.lit(0).cast(out.schema[n].dataType))
    return out.withColumns({n: total(n, c) for n, c in sums.items()}).drop("__part", *[f"__{n}" for n in sums])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rid and rn, the place of each row among those of its ``key``, from 0. ``rows`` are
    stored rows of key, part and rid; a key is numbered in the parts in which it was stored,
    plus the counts of the parts before, so no task gets all rows of a key."""
    inside = rows.withColumn("rn", F.row_number().over(W.partitionBy(key, "part").orderBy("rid")) - 1)
    sums = rows.groupBy(key, "part").agg(F.count("*").alias("m"))
    before = (F.sum("m").over(W.partitionBy(key).orderBy("part")) - F.col("m")).alias("before")
    return inside.join(sums.select(key, "part", before), [key, "part"]).select("rid", (F.col("before") + F.col("rn")).alias("rn"))


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df``, to be broadcast if its known number of rows is bounded."""
    return F.broadcast(df) if rows <= most else df


#: Bytes of a row of a bitmap that is being gathered, and its least and most bits.
STRETCH, LEAST_BITS, MOST_BITS = 1 << 13, 1 << 17, 1 << 28


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits (a power of two), of which those are set that the low bits of a column
    of 64-bit hashes name. Tasks set their own and then join stretches of them; the driver
    gets the bits, whose number doesn't grow with the rows."""

    def own(parts: Iterator[dict]) -> Iterator[dict]:
        out = np.zeros(bits // 8, np.uint8)
        for p in parts:
            at = np.array(p["h"], np.int64).astype(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = out.reshape(-1, STRETCH)
        at = np.flatnonzero(rows.any(axis=1))
        yield {"at": at.tolist(), "bits": [rows[i].tobytes() for i in at]}

    def joined(parts: Iterator[dict]) -> Iterator[dict]:
        held: dict[int, np.ndarray] = {}
        for p in parts:
            for at, raw in zip(p["at"], p["bits"]):
                held[at] = held.get(at, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        yield {"at": list(held), "bits": [h.tobytes() for h in held.values()]}

    schema = "at int, bits binary"
    some = map_rows(hashes.toDF("h").filter("h is not null"), own, schema, batch=10_000)
    out = np.zeros(bits // 8, np.uint8)
    for r in map_rows(some.repartition("at"), joined, schema, batch=500).collect():
        out[r["at"] * STRETCH : (r["at"] + 1) * STRETCH] = np.frombuffer(r.bits, np.uint8)
    return out


def among(df: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose hash in ``column`` is one of ``hashes``, and some others: a
    broadcast bitmap of at most ``MOST_BITS`` tells, 16 bits for each hash if it can."""
    n = 16 * max(1, hashes.count())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n - 1).bit_length()))
    sent = df.sparkSession.sparkContext.broadcast(bitmap(hashes, bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            at = b.column(b.schema.get_field_index(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64) & np.uint64(bits - 1)
            yield b.filter(pa.array((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1))

    return df.mapInArrow(run, df.schema)


def hashable(df: DataFrame) -> list[F.Column]:
    """The columns in a form that hashes take: maps as sorted entries, other kinds as text."""
    from pyspark.sql.types import AtomicType, VariantType

    plain = lambda t: isinstance(t, AtomicType) and not isinstance(t, VariantType)
    return [column(f.name) if plain(f.dataType) else F.to_json(F.struct(column(f.name).alias("x"))) for f in df.schema]


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables, once the results that need them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(col: str = "text") -> F.Column:
    """The text's UTF-8 bytes; Python gets them without decoding."""
    return F.col(col).cast("binary")


def column(name: str) -> F.Column:
    """The top-level column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema_of(*parts: str | tuple[str, DataType]) -> StructType:
    """A schema from DDL strings and (name, type) pairs; types are never written as DDL,
    which can't say every field name."""
    from pyspark.sql.types import StructField, _parse_datatype_string

    out = StructType()
    for part in parts:
        for f in _parse_datatype_string(part).fields if isinstance(part, str) else [StructField(*part)]:
            out.add(f)
    return out


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[dict]], schema: str | StructType, batch: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over column lists. ``rows`` takes and yields dicts of lists. The columns
    ``keep`` go by it, untouched, to the end of the result; then it must yield one dict for
    each that it takes, with as many rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema_of(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    whole = schema_of(*[(f.name, f.dataType) for f in struct], *[(c, df.schema[c].dataType) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: deque[list[pa.Array]] = deque()

        def columns() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, batch):
                    part = b.slice(at, batch)
                    if keep:
                        aside.append([part.column(c) for c in keep])
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if n not in keep}

        for out in rows(columns()):
            own = [pa.array(out[f.name], f.type) for f in arrow]
            kept = aside.popleft() if keep else []
            yield pa.RecordBatch.from_arrays([*own, *kept], names=[*arrow.names, *keep])

    return df.mapInArrow(run, whole)
