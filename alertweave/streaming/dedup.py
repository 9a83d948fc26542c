"""Structured Streaming forms of the deduplication operators.

State is kept entry by entry in the RocksDB store: a batch reads and writes the entries that
its rows name, whatever else the group holds. Late data: rows older than the watermark (one
window behind the newest) are dropped. State of a group ends when the watermark passes the
end of its bucket, as no key leaves it; entries of the slot index end by their time to live,
which every addition renews."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.dedup import KeyStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Held:
    """A map state of key to (alert_id, ms), as the dictionary that a key store takes. Only
    keys that are asked for are read, and each is written by itself."""

    def __init__(self, state):
        self.state, self.added = state, 0

    def get(self, key: str) -> tuple[int, int] | None:
        return tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None

    def __setitem__(self, key: str, value: tuple[int, int]) -> None:
        self.added += not self.state.containsKey((key,))
        self.state.updateValue((key,), value)


class KeyVerdicts(StatefulProcessor):
    """Verdicts of a (destination, category, bucket) group's alerts: map state of its keys,
    which a timer at the end of the bucket clears."""

    def __init__(self, window_ms: int):
        self.window = window_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "alert_id bigint, ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        store = KeyStore(self.window, Held(self.entries))
        pdf = pd.concat(list(rows)).sort_values(["ms", "alert_id"])
        found, added = [], []
        for i, ms, keys in zip(pdf["alert_id"], pdf["ms"], pdf["keys"]):
            was = store.entries.added
            found.append(store.judge(int(i), int(ms), list(keys)))
            added.append(store.entries.added - was)
        end = (int(pdf["bucket"].iloc[0]) + 1) * self.window
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"alert_id": pdf["alert_id"].to_numpy(), "duplicate_of": pd.array(found, "Int64"), "registered": pd.array(added, "Int64"), "ts": pdf["ts"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass


VERDICT = "alert_id long, duplicate_of long, registered long, ts timestamp"


def key_verdict_stream(df: DataFrame, window_ms: int, group: Sequence[str], time: str = "ts") -> DataFrame:
    """alert_id, duplicate_of, registered (keys that the alert added) and ts of a stream of
    (alert_id, ts, ms, keys, group columns, bucket), as the batch operator gives them where
    rows arrive in order. The result keeps the watermark."""
    with_rocksdb(df.sparkSession)
    marked = df.withColumn("ts", F.col(time).cast("timestamp")).withWatermark("ts", f"{window_ms} milliseconds")
    rows = marked.select("alert_id", "ts", "ms", "keys", *group).groupBy(*group)
    return rows.transformWithStateInPandas(KeyVerdicts(window_ms), VERDICT, "Append", "EventTime", eventTimeColumnName="ts")


def hash_dedup_stream(df: DataFrame, window_ms: int, group: list[str], time: str = "ts") -> DataFrame:
    """alert_id, duplicate_of, as ``key_verdict_stream`` has them."""
    return key_verdict_stream(df, window_ms, group, time).select("alert_id", "duplicate_of")


class Totals(StatefulProcessor):
    """Running totals over buckets, which close in order of time."""

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", "total bigint, duplicates bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, dup = self.sums.get() if self.sums.exists() else (0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("start").itertuples():
            total, dup = total + int(r.n), dup + int(r.d)
            out.append((r.bucket, total, dup, int(r.active)))
        self.sums.update((total, dup))
        yield pd.DataFrame(out, columns=["bucket", "total", "duplicates", "active_entries"])

    def close(self) -> None:
        pass


def key_statistics_stream(df: DataFrame, window_ms: int, group: Sequence[str], time: str = "ts") -> DataFrame:
    """The key engine's running totals, once each bucket closes: bucket, total, new,
    duplicates, active_entries, dedup_rate. Verdicts are one stateful operator, counts by
    bucket the next, partly summed where the verdicts are made, and running totals the third,
    which gets a row for each bucket."""
    judged = key_verdict_stream(df, window_ms, group, time)
    dup = F.col("duplicate_of").isNotNull()
    per = judged.groupBy(F.window("ts", f"{window_ms} milliseconds").alias("w")).agg(F.count("*").alias("n"), F.count_if(dup).alias("d"), F.sum("registered").alias("active"))
    start = F.unix_millis(F.col("w.start"))
    per = per.select(F.window_time("w").alias("at"), start.alias("start"), (start / window_ms).cast("long").alias("bucket"), "n", "d", "active", F.lit(0).alias("one"))
    out = per.groupBy("one").transformWithStateInPandas(Totals(), "bucket long, total long, duplicates long, active_entries long", "Append", "EventTime")
    rate = F.round(F.col("duplicates") / F.col("total") * 100, 1).alias("dedup_rate")
    return out.select("bucket", "total", (F.col("total") - F.col("duplicates")).alias("new"), "duplicates", "active_entries", rate)


class SlotIndex(StatefulProcessor):
    """The alerts that hold a slot's hash: a map entry for each, written by itself. The whole
    of a hash lives as long as additions renew it: a value with a time to live stands for
    that, and a timer clears the entries of a hash that nobody renews."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "until bigint", self.ttl)
        self.members = handle.getMapState("members", "alert_id bigint", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.alive.exists():
            self.members.clear()
        held = sorted(k[0] for k in self.members.keys())
        pdf = pd.concat(list(rows)).sort_values(["ts", "alert_id"])
        out = []
        for i, ts in zip(pdf["alert_id"], pdf["ts"]):
            i = int(i)
            out.append((i, [h for h in held if h != i]))
            if i not in held:
                self.members.updateValue((i,), (ts,))
                held = sorted([*held, i])
        now = timerValues.getCurrentProcessingTimeInMs()
        self.alive.update((now + self.ttl,))
        self.handle.registerTimer(now + self.ttl)
        yield pd.DataFrame({"alert_id": [i for i, _ in out], "slot_hash": [key[-1]] * len(out), "candidates": [c for _, c in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.alive.exists():
            self.members.clear()
        return iter(())

    def close(self) -> None:
        pass


def slot_index_stream(df: DataFrame, ttl_ms: int) -> DataFrame:
    """alert_id, slot_hash, candidates: the alerts of the same customer that held the hash
    when the row came, of a stream of (customer, alert_id, ts, slot_hash). A hash is forgotten
    ``ttl_ms`` after its last addition, by the clock; each addition renews all of it."""
    with_rocksdb(df.sparkSession)
    return df.select("customer", "alert_id", F.col("ts").cast("timestamp").alias("ts"), "slot_hash").groupBy("customer", "slot_hash").transformWithStateInPandas(SlotIndex(ttl_ms), "alert_id long, slot_hash string, candidates array<long>", "Append", "ProcessingTime")


def verdict_counts(df: DataFrame, time: str, minutes: int, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys, final once the watermark has passed."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, f"{minutes} minutes").groupBy(F.window(time, f"{minutes} minutes").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> Any:
    """Takes what the source has, writes Parquet files, and stops. ``once``: in one batch, as
    state that lives by the clock never stops asking for another."""
    trigger = {"once": True} if once else {"availableNow": True}
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**trigger).start()
    q.awaitTermination()
    return q


def run_updates(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Takes what the source has in update mode and returns each key's last row, so windows
    that the watermark hasn't closed are in it too. A batch writes a folder of its own, which
    a repeated batch overwrites."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, *[F.col(f"x.{c}") for c in rest])
