"""Entry-wise streaming state: renewal and expiry, restarts, and running totals."""

import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from alertweave.operators import dedup
from alertweave.plans import streams as registered  # noqa: F401
from alertweave.plans.dedups import keyed
from alertweave.plans.registry import QUERIES
from alertweave.sources.views import alerts
from alertweave.streaming import dedup as streams

T0 = datetime(2024, 3, 1)
SLOTS = "customer string, alert_id bigint, ts timestamp, slot_hash string"
GROUP = ["domain", "alert_name", "bucket"]


class Feed:
    """A folder that gets a file a batch, a stream over it, and its result so far."""

    def __init__(self, spark, path, schema, make, once=False):
        self.spark, self.path, self.schema, self.make, self.n, self.once = spark, str(path), schema, make, 0, once
        os.makedirs(f"{path}/in")

    def give(self, rows):
        """Takes rows as one batch, in a query that starts anew from its checkpoint."""
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/new{self.n}")
        part = next(f for f in os.listdir(f"{self.path}/new{self.n}") if f.endswith(".parquet"))
        os.rename(f"{self.path}/new{self.n}/{part}", f"{self.path}/in/{self.n}.parquet")
        live = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        out = self.make(live)
        streams.run_available(out, f"{self.path}/out", f"{self.path}/state", once=self.once)
        return self.spark.read.schema(out.schema).parquet(f"{self.path}/out")


def slot(i, h="h", customer="c"):
    return (customer, i, T0 + timedelta(seconds=i), h)


def test_slot_index_is_renewed_by_additions_and_expires(spark, tmp_path):
    """Each batch is a query restarted from its checkpoint; gaps are by the clock."""
    ttl = 30.0
    feed = Feed(spark, tmp_path, SLOTS, lambda live: streams.slot_index_stream(live, int(ttl * 1000)), once=True)
    held = lambda out, i: {r.slot_hash: sorted(r.candidates) for r in out.filter(F.col("alert_id") == i).collect()}
    until = lambda t: time.sleep(max(0.0, t - time.time()))
    out = feed.give([slot(1), slot(2), slot(3, customer="d"), slot(4, "k")])
    first = time.time()
    assert held(out, 1) == {"h": []} and held(out, 2) == {"h": [1]} and held(out, 3) == {"h": []} and held(out, 4) == {"k": []}
    until(first + ttl / 2)
    out = feed.give([slot(5)])
    assert held(out, 5) == {"h": [1, 2]}
    until(first + ttl + 0.5)  # the first addition has run out, but the second has renewed all of the hash
    out = feed.give([slot(6), slot(6)])
    last = time.time()
    assert held(out, 6) == {"h": [1, 2, 5]}
    until(last + ttl + 1)
    out = feed.give([slot(7), slot(8, "k")])
    assert held(out, 7) == {"h": []} and held(out, 8) == {"k": []}


def test_a_batch_reads_and_writes_its_own_keys_only():
    """Of a thousand entries two are asked for and one is written."""

    class State:
        def __init__(self):
            self.rows, self.reads, self.writes = {f"k{i}": (i, 0) for i in range(1000)}, [], []

        def containsKey(self, key):
            self.reads.append(key[0])
            return key[0] in self.rows

        def getValue(self, key):
            return self.rows[key[0]]

        def updateValue(self, key, value):
            self.writes.append(key[0])
            self.rows[key[0]] = value

    state = State()
    store = dedup.KeyStore(100, streams.Held(state))
    assert store.judge(5000, 50, ["new", "k7"]) == 7
    assert set(state.reads) == {"new", "k7"} and state.writes == ["new"] and store.entries.added == 1


def test_key_engine_restarts_from_its_checkpoint(spark, sf_dir, tmp_path):
    """A query for each part of the rows, all on one checkpoint, gives what one batch gives."""
    df = keyed(alerts(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sorted(df.collect(), key=lambda r: (r.ms, r.alert_id))
    feed = Feed(spark, tmp_path, df.schema, lambda live: streams.hash_dedup_stream(live, 1_800_000, GROUP))
    for i in range(3):
        out = feed.give(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3])
    want = {r.alert_id: r.duplicate_of for r in dedup.hash_dedup(df, 1_800_000, GROUP).collect()}
    assert {r.alert_id: r.duplicate_of for r in out.collect()} == want


def test_running_totals_are_those_of_the_batch(spark, sf_dir, tmp_path):
    """After each bucket closes, over several restarts."""
    df = keyed(alerts(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sorted(df.collect(), key=lambda r: (r.ms, r.alert_id))
    judged = dedup.key_verdicts(df, 1_800_000, GROUP).join(df.select("alert_id", "bucket"), "alert_id")
    want = {r.bucket: r for r in dedup.key_statistics(judged).collect()}
    feed = Feed(spark, tmp_path, df.schema, lambda live: streams.key_statistics_stream(live, 1_800_000, GROUP))
    for i in range(2):
        out = feed.give(rows[i * len(rows) // 2 : (i + 1) * len(rows) // 2])
    got = {r.bucket: r for r in out.collect()}
    closed = {b for b in want if (b + 2) * 1_800_000 <= rows[-1].ms}
    assert closed and set(got) == closed
    names = ["total", "new", "duplicates", "active_entries", "dedup_rate"]
    assert all([got[b][n] for n in names] == [want[b][n] for n in names] for b in closed)
    assert QUERIES["stream_key_statistics"](spark, sf_dir).count() == len(closed)
