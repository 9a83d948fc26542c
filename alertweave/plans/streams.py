"""Streaming operators, run over what a table has."""

from __future__ import annotations

from ..sources.views import MILLISECOND, of_events, table, with_views
from ..storage import scratch
from ..streaming import dedup as S
from .dedups import KEYS, keyed, recursive, tenths
from .registry import query


def _ran(spark, df, name: str, mode: str = "append"):
    path = scratch(spark, name)
    S.run_available(df, f"{path}/out", f"{path}/state", mode)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _events(spark, sf_dir: str):
    """The events table landed in a folder, as a stream of its files."""
    e = table(spark, sf_dir, "events")
    landing = scratch(spark, "landing")
    e.write.parquet(landing)
    return spark.readStream.schema(e.schema).parquet(landing)


@query(recursive(with_views("alerts", KEYS + " SELECT alert_id, dup AS duplicate_of FROM st WHERE rn > 0")))
def stream_hash_dedup(spark, d):
    return _ran(spark, S.hash_dedup_stream(keyed(of_events(_events(spark, d))), 1_800_000, ["domain", "alert_name", "bucket"]), "dedup")


@query("SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_verdict_counts(spark, d):
    """All windows: closed ones, and open ones as they stand when the source is used up."""
    path = scratch(spark, "counts")
    counts = S.verdict_counts(_events(spark, d), "ts", 30, "event_type")
    return S.run_updates(counts, f"{path}/out", f"{path}/state", ["start", "event_type"])


@query(recursive(with_views("alerts", KEYS + """, p AS (SELECT bucket, count(*) AS n, count(dup) AS d, CAST(sum(added) AS BIGINT) AS active_entries FROM st WHERE rn > 0 GROUP BY bucket),
c AS (SELECT bucket, active_entries, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS total, CAST(sum(d) OVER (ORDER BY bucket) AS BIGINT) AS duplicates FROM p)
SELECT bucket, total, total - duplicates AS new, duplicates, active_entries, """ + tenths("duplicates / total * 100") + " AS dedup_rate FROM c WHERE (bucket + 2) * 1800000 <= (SELECT max(" + MILLISECOND + ") FROM alerts)")))
def stream_key_statistics(spark, d):
    """Running totals of the buckets that the watermark, a bucket behind, has closed."""
    return _ran(spark, S.key_statistics_stream(keyed(of_events(_events(spark, d))), 1_800_000, ["domain", "alert_name", "bucket"]), "statistics")
