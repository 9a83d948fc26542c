"""Operators without SQL, and stateful ones, against small independent versions."""

import math
import random
from collections import defaultdict
from urllib.parse import urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertweave.functions import similarity, stats
from alertweave.functions import text as T
from alertweave.operators import bundles, dedup, evaluation, joins, windows
from alertweave.plans.dedups import VALUES, fingerprints, keyed
from alertweave.plans.registry import QUERIES
from alertweave.plans.streams import _ran
from alertweave.sources import files
from alertweave.sources.views import alerts, containers
from alertweave.streaming import dedup as streams


# similarity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        was = 0
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], was + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc d", max_size=80), st.text(alphabet="abc d", max_size=80))
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)


def test_token_sort_ratio():
    assert similarity.token_sort_score("b A", "a b") == 100.0
    assert similarity.token_sort_score("", "") == 100.0
    assert similarity.token_sort_score("10.0.0.1", "10.0.0.2") == pytest.approx(87.5)


# bounds


def test_clopper_pearson():
    assert stats.clopper_pearson_upper(0, 100, 0.95) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert stats.clopper_pearson_upper(0, 0, 0.95) == 1.0 and stats.clopper_pearson_upper(5, 5, 0.95) == 1.0

    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for m, n in ((1, 20), (3, 50), (10, 200)):
        assert tail(m, n, stats.clopper_pearson_upper(m, n, 0.95)) == pytest.approx(0.05, abs=1e-9)
        assert 1 - tail(m - 1, n, stats.clopper_pearson_lower(m, n, 0.95)) == pytest.approx(0.05, abs=1e-9)


def test_certified_cut(spark):
    rows = [(i, int(i > 400 and i % 3 == 0)) for i in range(600)]
    got = evaluation.certified_cut(spark.createDataFrame(rows, "score int, y int"), 0.02).first()
    best = 0
    for n in range(1, 601):
        m = sum(y for _, y in rows[:n])
        if stats.clopper_pearson_upper(m, n, 0.95) <= 0.02:
            best = n
    assert got.lane == best > 400


# indicators


def python_url(value):
    p = urlparse(value.strip())
    scheme, host, port = (p.scheme or "http").lower(), (p.hostname or "").lower(), p.port
    if (scheme, port) in (("http", 80), ("https", 443)):
        port = None
    net = f"{host}:{port}" if port else host
    if p.username:
        net = f"{p.username}{':' + p.password if p.password else ''}@{net}"
    return urlunparse((scheme, net, p.path, p.params, p.query, ""))


def test_urls(spark):
    urls = ["HTTP://User:pw@Example.COM:80/a;p?q=1#f", "https://x.example:443", "https://x.example:8443/", "//h.example/p", "example.com/path", "ftp://A.example/?x", "http://h.example?q", " https://h.example/%20#"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "x string").select(T.norm_url(F.col("x")).alias("u")).collect()]
    assert got == [python_url(u) for u in urls]


def test_addresses(spark):
    cases = {"010.001.0.255/24": "10.1.0.255", "1.2.3": "1.2.3", "A.b.3.4": "a.b.3.4", "::1": "0000:" * 7 + "0001", "fe80::A:b/64": "fe80:0000:0000:0000:0000:0000:000a:000b", "1:2:3:4:5:6:7:8": "0001:0002:0003:0004:0005:0006:0007:0008", "::ffff:1.2.3.4": "::ffff:1.2.3.4", "000.0.0.0": "0.0.0.0"}
    got = {r.x: r.y for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", T.norm_ip(F.col("x")).alias("y")).collect()}
    assert got == cases


def test_bundle_rules(spark):
    rows = [
        (1, '{"objects":[{"type":"indicator","name":"a"},{"type":"indicator","name":"b"},{"type":"email-addr","value":"x@y.z"},{"type":"file","hashes":{"MD5":"M","SHA-256":"S"}},{"type":"user-account","user_id":"u","account_login":"u"}]}'),
        (2, '{"objects":[{"type":"indicator","name":"n","extensions":{"e":{"vendor_specific":{"notable_fields":{"src_ip":"1.2.3.4:99","dest_ip":"nohost","user":"[\\"p\\",\\"q\\"]","domain":"1.2.3.4"}}}}}]}'),
        (3, "not json"),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "alert_id int, bundle string")
    got = {r.alert_id: r for r in bundles.parsed(df).collect()}
    assert got[1].alert_name == "b" and got[1].emails == [] and got[1].file_hashs == ["M", "S"] and got[1].users == ["u"]
    assert got[2].ips == ["1.2.3.4"] and got[2].users == ["p", "q"] and got[2].domains == []
    assert got[3].error and got[4].error and got[3].ips == [] and not got[1].error
    assert bundles.parsed(df, include_email_objects=True).filter("alert_id = 1").first().emails == ["x@y.z"]


def test_rendering(spark):
    m = F.create_map(*[F.lit(x) for kv in {"b": "V 2024-01-02 x", "a": "NULL", "c": " 12:30:10 ", "d": "é 1699999999 ok", "e": "-"}.items() for x in kv])
    assert spark.range(1).select(T.rendered(m).alias("t")).first().t == "b v   x d é   ok"


def test_key_values(spark):
    raw = 'a=1 b="two words" a=3 c="" d=x"y'
    got = spark.createDataFrame([(raw,)], "x string").select(T.parsed_kv(F.col("x")).alias("m")).first().m
    assert got == {"a": "3", "b": "two words", "c": "", "d": 'x"y'}


# sequences


def test_prior_features(spark, sf_dir):
    df = containers(spark, sf_dir)
    df = windows.distinct_before(windows.flip_rate(windows.benign_run(windows.previous(windows.seen_before(windows.prior_rate(df, ("rule",), F.col("verdict") == "True Positive", "rule", 20.0))))))
    rows = sorted(df.collect(), key=lambda r: (r.t, r.container_id))
    p = sum(r.verdict == "True Positive" for r in rows) / len(rows)
    seen, prev, run, hits, n, flips, had, tenants = (defaultdict(int) for _ in range(8))
    prev, tenants = {}, defaultdict(set)
    for r in rows:
        pair = (r.tenant, r.rule)
        assert (r.seen, r.prev, r.benign_run, r.distinct_before) == (seen[pair], prev.get(pair, "none"), run[pair], len(tenants[r.rule]))
        assert r.rule_rate == pytest.approx((hits[r.rule] + 20 * p) / (n[r.rule] + 20)) and r.rule_n == n[r.rule]
        assert r.flip_rate == (pytest.approx(flips[r.rule] / had[r.rule]) if had[r.rule] else None)
        if pair in prev:
            had[r.rule] += 1
            flips[r.rule] += prev[pair] != r.verdict
        seen[pair] += 1
        prev[pair] = r.verdict
        run[pair] = run[pair] + 1 if r.verdict == windows.BENIGN else 0
        hits[r.rule] += r.verdict == "True Positive"
        n[r.rule] += 1
        tenants[r.rule].add(r.tenant)


# deduplication


def twin(rows, minutes):
    """Both layers, one alert at a time."""
    out, seen = {}, []
    for r in sorted(rows, key=lambda r: (r.ts, r.alert_id)):
        bucket = int(r.ts.timestamp() * 1000) // (minutes * 60000)
        best = (0.0, None)
        for e, b in seen:
            if (e.customer, e.alert_name, b) == (r.customer, r.alert_name, bucket):
                c = round(sum(e[v] == r[v] for v in VALUES) / 3, 4)
                if c >= 0.8 and c > best[0]:
                    best = (c, e.alert_id)
        if best[1] is not None:
            out[r.alert_id] = ("DUPLICATE", 1, best[1])
        else:
            best = (0.0, None)
            for e, b in seen:
                if (e.customer, b) == (r.customer, bucket) and e.alert_name != r.alert_name:
                    s = round(sum(round(similarity.token_sort_score(r[v], e[v]), 2) for v in VALUES) / 3, 2)
                    if s >= 80 and s > best[0]:
                        best = (s, e.alert_id)
            out[r.alert_id] = ("SIMILAR", 2, best[1]) if best[1] is not None else ("NEW", 0, None)
        seen.append((r, bucket))
    return out


@pytest.mark.parametrize("minutes", [30, 240])
def test_both_layers(spark, sf_dir, minutes):
    rows = alerts(spark, sf_dir).collect()
    got = {r.alert_id: (r.verdict, r.layer, r.matched_alert_id) for r in dedup.dedup(fingerprints(spark, sf_dir, minutes), VALUES).collect()}
    want = twin(rows, minutes)
    assert got == want
    assert {v for v, *_ in want.values()} == {"NEW", "DUPLICATE", "SIMILAR"}


def test_planned_ledger(spark):
    """30 parents, 20 exact copies, 10 variants of another rule, as the plan intends."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows, plan = [], {}
    for i in range(30):
        rows.append((i, i, 1, f"rule {word(8)}", word(14), f"{rng.randint(11, 99)}.{rng.randint(11, 99)}.{rng.randint(100, 199)}.{rng.randint(100, 199)}", f"{word(12)}.example"))
        plan[i] = ("NEW", None)
    for k in range(20):
        rows.append((100 + k, 100 + k, *rows[k][2:]))
        plan[100 + k] = ("DUPLICATE", k)
    for k in range(20, 30):
        _, _, c, _, u, ip, dom = rows[k]
        rows.append((200 + k, 200 + k, c, f"other {word(8)}", u, ip[:-1] + "7", dom))
        plan[200 + k] = ("SIMILAR", k)
    df = spark.createDataFrame(rows, "alert_id long, s int, customer int, alert_name string, user_name string, ip string, domain string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_400))
    fp = dedup.fingerprints(df, {"user": F.array("user_name"), "ip": F.array("ip"), "domain": F.array("domain")})
    got = {r.alert_id: (r.verdict, r.matched_alert_id) for r in dedup.dedup(fp, VALUES).collect()}
    assert got == plan


def test_verdict_invariants(spark, sf_dir):
    v = QUERIES["dedup"](spark, sf_dir).collect()
    ids = {r.alert_id for r in v}
    for r in v:
        assert (r.matched_alert_id is None) == (r.verdict == "NEW") == (r.layer == 0)
        assert r.matched_alert_id != r.alert_id and (r.matched_alert_id is None or r.matched_alert_id in ids)


def key_twin(rows, window):
    entries, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ms, r.alert_id)):
        entries = {k: e for k, e in entries.items() if e[1] >= r.ms - window}
        out[r.alert_id] = None
        for k in r["keys"]:
            if k in entries:
                out[r.alert_id] = entries[k][0]
                break
            entries[k] = (r.alert_id, r.ms)
    return out


def test_key_engine_batch_and_stream(spark, sf_dir):
    df = keyed(alerts(spark, sf_dir))
    want = key_twin(df.collect(), 1_800_000)
    assert any(v is not None for v in want.values())
    assert {r.alert_id: r.duplicate_of for r in QUERIES["hash_dedup"](spark, sf_dir).collect()} == want
    assert {r.alert_id: r.duplicate_of for r in QUERIES["stream_hash_dedup"](spark, sf_dir).collect()} == want


def test_key_engine_in_several_batches(spark, sf_dir, tmp_path):
    """Rows arriving in order, a file at a time, give what one batch gives."""
    df = keyed(alerts(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sorted(df.collect(), key=lambda r: (r.ms, r.alert_id))
    import os
    import time

    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        for f in os.listdir(f"{tmp_path}/in/b={i}"):
            os.utime(f"{tmp_path}/in/b={i}/{f}", (time.time() + i, time.time() + i))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = _ran(spark, streams.hash_dedup_stream(live, 1_800_000, ["domain", "alert_name", "bucket"]), "test")
    assert {r.alert_id: r.duplicate_of for r in got.collect()} == key_twin(rows, 1_800_000)


def test_stream_counts_are_final(spark, sf_dir):
    got = {(r.start, r.event_type): r.n for r in QUERIES["stream_verdict_counts"](spark, sf_dir).collect()}
    whole = defaultdict(int)
    for r in alerts(spark, sf_dir).select(F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"].alias("s"), "alert_name").collect():
        whole[r.s, r.alert_name] += 1
    assert got and all(whole[k] == n for k, n in got.items()) and len(got) >= len(whole) - 10


# sources and joins


def test_csv_round_trip(spark, tmp_path):
    with open(f"{tmp_path}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write('id,share,text\n1,12%,"two\nlines"\n2,,None\n')
    df = files.text_csv(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["id", "share", "text"]
    assert [(r.id, r.share, r.text) for r in df.collect()] == [("1", "12%", "two\nlines"), ("2", "", "None")]
    assert [r.p for r in df.select(files.percent(F.col("share")).alias("p")).collect()] == [12.0, None]
    assert files.text_csv(spark, f"{tmp_path}/a.csv", ["id"]).columns == ["id"]
    assert files.latest_file(spark, f"{tmp_path}/*.csv").endswith("a.csv")


def test_json_sources(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, "A", [1, 2]), ("s2", 2, None, None)], "server string, id long, disposition string, xs array<int>")
    files.write(df, f"{tmp_path}/x", "json")
    back = files.json_lines(spark, f"{tmp_path}/x", df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert files.lookup(back, "s1", 1).first().disposition == "A"
    with pytest.raises(KeyError):
        files.lookup(back, "s1", 2)
    files.write(files.scalar_columns(df), f"{tmp_path}/p", "parquet")
    assert spark.read.parquet(f"{tmp_path}/p").filter("id = 1").first().xs == "[1,2]"
    census = {r.key: r.n for r in files.census(spark.createDataFrame([('{"a":1,"b":2}', "L"), ("bad", "L")], "j string, l string"), "j", "l").collect()}
    assert census == {"records": 2, "label:L": 2, "key:a": 1, "key:b": 1}
    assert files.unioned([df.select("id"), df.select("server")]).columns == ["id", "server"]


def test_paged_source(spark):
    source = files.paged_source("test_pages", lambda i: [(2 * i,), (2 * i + 1,)], 3, "n int")
    spark.dataSource.register(source)
    assert sorted(r.n for r in spark.read.format("test_pages").load().collect()) == list(range(6))


def test_one_to_one_refuses_repeats(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        joins.join_one_to_one(a, b, "k").collect()
    assert len(joins.join_one_to_one(a, a.withColumn("v", F.lit(1)), "k").collect()) == 2
