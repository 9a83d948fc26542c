"""Composite-key scenarios, vendor by vendor, from raw payloads to verdicts."""

import json

from pyspark.sql import functions as F

from alertweave.functions import text as T
from alertweave.operators import bundles, dedup

HOUR = 3_600_000


def verdicts(spark, payloads, window=HOUR, step=1000, start=1_700_000_000_000 // HOUR * HOUR):
    rows = [(i, start + i * step, json.dumps(p)) for i, p in enumerate(payloads)]
    df = bundles.vendor_extracted(spark.createDataFrame(rows, "alert_id long, ms long, payload string"))
    bucket = F.floor(F.col("ms") / window)
    keyed = df.select("alert_id", "ms", T.composite_keys(F.col("sources"), F.col("dests"), F.col("category"), bucket).alias("keys"), F.array_join(F.array_sort("dests"), ",").alias("to"), "category", bucket.alias("bucket"))
    out = {r.alert_id: r.duplicate_of for r in dedup.hash_dedup(keyed, window, ["to", "category", "bucket"]).collect()}
    return [out[i] for i in range(len(payloads))]


def pre(sources, dests=("9.9.9.9",), category="scan", **more):
    return {"sourceIps": list(sources), "destIps": list(dests), "alertCategory": category, **more}


def test_exact_repeat(spark):
    assert verdicts(spark, [pre(["1.1.1.1"]), pre(["1.1.1.1"])]) == [None, 0]


def test_subset_of_sources(spark):
    assert verdicts(spark, [pre(["1.1.1.1", "2.2.2.2"]), pre(["2.2.2.2"])]) == [None, 0]


def test_superset_hits_and_leaves_later_sources_unregistered(spark):
    """The second alert stops at its first hit, so its other source stays unknown."""
    got = verdicts(spark, [pre(["1.1.1.1"]), pre(["1.1.1.1", "2.2.2.2"]), pre(["2.2.2.2"])])
    assert got == [None, 0, None]


def test_other_category(spark):
    assert verdicts(spark, [pre(["1.1.1.1"]), pre(["1.1.1.1"], category="login")]) == [None, None]


def test_order_is_irrelevant(spark):
    assert verdicts(spark, [pre(["1.1.1.1"], ["8.8.8.8", "9.9.9.9"]), pre(["1.1.1.1"], ["9.9.9.9", "8.8.8.8"])]) == [None, 0]


def test_missing_addresses_collide(spark):
    assert verdicts(spark, [pre([], []), pre([], [])]) == [None, 0]


def test_next_bucket_is_new(spark):
    assert verdicts(spark, [pre(["1.1.1.1"]), pre(["1.1.1.1"])], step=HOUR) == [None, None]


def test_vendors(spark):
    endpoint = {"DetectName": "x", "CompositeId": "c", "LocalIP": "1.1.1.1", "Name": "scan", "NetworkAccesses": [{"RemoteAddress": "9.9.9.9"}, {"RemoteAddress": ""}]}
    siem = {"search_name": "scan", "src_ip": "1.1.1.1", "dest_ip": "9.9.9.9"}
    cloud = {"AlertName": "scan", "Entities": json.dumps([{"Type": "ip", "Address": "1.1.1.1"}, {"Type": "host", "HostName": "h"}])}
    generic = {"source_ip": "1.1.1.1", "destination_ip": "9.9.9.9", "title": "scan"}
    got = verdicts(spark, [pre(["1.1.1.1"]), endpoint, siem, cloud, generic, cloud, {"domains": [], "title": "t"}])
    assert got == [None, 0, 0, None, 0, 3, None]


def test_domains_count_as_destinations(spark):
    assert verdicts(spark, [pre(["1.1.1.1"], ["9.9.9.9"], domains=["a.example"]), pre(["1.1.1.1"], ["9.9.9.9"])]) == [None, None]


def test_unreadable_payload(spark):
    df = bundles.vendor_extracted(spark.createDataFrame([("nope",), (None,), ("{}",)], "payload string"))
    assert {(r.vendor, tuple(r.sources), r.category) for r in df.collect()} == {("generic", (), "unknown")}
