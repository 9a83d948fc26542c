"""Queries against their SQL on rows that the given tables hardly have: times a fraction of a
millisecond before a half hour's end, times before 1970, users whose number looks like a year,
rates a trifle below a half, alerts that lack a user, a time, their values or a name."""

import duckdb
import pytest
from pyspark.sql import functions as F

from alertweave.operators import aggregates
from alertweave.plans import dedups, indicators, sequences, streams  # noqa: F401
from alertweave.plans.registry import QUERIES, SQL
from tests.test_oracles import plain

BY_HALF_HOUR = [
    "composite_keys", "context_similarity", "dedup", "dedup_dashboard", "dedup_dashboard_full", "dedup_l1", "dedup_l2", "dedup_l2_lists", "dedup_verdicts", "fp_audit", "fp_pairs", "fp_summary", "fp_verdict",
    "hash_dedup", "ioc_diff", "key_statistics", "l1_candidate_counts", "l1_confidence", "l1_counts_lists", "observable_similarity", "time_buckets", "weighted_similarity",
]

LACKING = [
    "dedup_l1",
    "fp_audit",
    "fp_pairs",
    "fp_summary",
    "fp_verdict",
    "hash_dedup",
    "key_statistics",
    "ioc_diff",
    "dedup_l2",
    "dedup_dashboard_full",
]


@pytest.fixture(scope="module")
def edges(sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    con = duckdb.connect()
    half_hour = "CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2024-01-01' END + to_minutes(30 * (event_id // 2 % 6 - 3))"
    past = "CASE event_id % 5 WHEN 0 THEN 600 WHEN 1 THEN 400 WHEN 2 THEN 1799999700 ELSE 900000000 + event_id * 1000 END"
    con.sql(f"copy (select * replace ({half_hour} + to_microseconds({past}) as ts, 2010 + user_id as user_id) from '{sf_dir}/events.parquet') to '{path}/events.parquet'")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    return path, con


@pytest.fixture(scope="module")
def gaps(sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gaps"))
    con = duckdb.connect()
    con.sql(f"""copy (select event_id,
      case when event_id % 23 = 7 then null else timestamp '2024-01-01' + to_minutes(30 * (event_id % 4)) + to_microseconds(event_id // 3 * 1000) end as ts,
      case when event_id % 29 = 3 then null else user_id end as user_id,
      case when event_id % 17 = 5 then null when event_id % 19 = 2 then '' when event_id % 7 = 1 then ' ' || upper(event_type) else event_type end as event_type,
      value, case when event_id % 5 = 2 then null else props end as props from '{sf_dir}/events.parquet') to '{path}/events.parquet'""")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    return path, con


def same(spark, edges, name):
    path, con = edges
    df = QUERIES[name](spark, path)
    columns = sorted(df.columns)
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", BY_HALF_HOUR)
def test_half_hours(spark, edges, name):
    same(spark, edges, name)


@pytest.mark.parametrize("name", LACKING)
def test_alerts_that_lack_something(spark, gaps, name):
    same(spark, gaps, name)


def test_users_like_years(spark, edges):
    same(spark, edges, "scrub_time")


@pytest.mark.parametrize("name", ["key_statistics", "stream_key_statistics"])
def test_rates_close_to_a_half(spark, tmp_path, name):
    """9 duplicates of 2,000 alerts are 0.44999999999999996 percent, and 4.5 when taken times ten."""
    con = duckdb.connect()
    kind = "'t' || CASE WHEN i < 18 THEN i // 2 ELSE i END"
    half_hour = "CASE WHEN i < 2000 THEN 0 ELSE 300 END"
    con.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_minutes({half_hour}) + to_microseconds(i * 1000) as ts, 5::bigint as user_id, {kind} as event_type, 1.0::double as value, '{{\"k\": 1}}' as props from range(2001) t(i)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    rates = {r.total: (r.duplicates, r.dedup_rate) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert rates[2000] == (9, 0.4)
    same(spark, (str(tmp_path), con), name)


def test_phi_beyond_64_bits(spark):
    n = 2_000_000
    df = spark.range(n).select((F.col("id") % 2 == 0).alias("a"), (F.col("id") % 4 == 0).alias("b"))
    a, b = n // 2, n // 4
    want = (n * b - a * b) / ((n * a - a * a) * (n * b - b * b)) ** 0.5
    assert aggregates.phi_matrix(df, ["a", "b"]).first().phi == pytest.approx(want, rel=1e-12)
