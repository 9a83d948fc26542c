"""Layer two: scores by type, lists and absent types, bounds, and a hot window."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from alertweave.functions.similarity import token_sort_score
from alertweave.operators import dedup, layer_two
from alertweave.plans.dedups import fingerprints
from alertweave.plans.registry import QUERIES
from alertweave.sources.views import alerts

T0 = datetime(2024, 5, 1, 10, 0)
SCHEMA = "alert_id bigint, ts timestamp, customer string, alert_name string, users array<string>, ips array<string>, domains array<string>"
TYPES = ["users", "ips", "domains"]


def row(i, rule, users=(), ips=(), domains=(), customer="c", seconds=None):
    return (i, T0 + timedelta(seconds=i if seconds is None else seconds), customer, rule, *[None if v is None else list(v) for v in (users, ips, domains)])


def run(spark, rows, threshold=80.0):
    df = spark.createDataFrame(rows, SCHEMA)
    fp = dedup.fingerprints(df, {"user": F.col("users"), "ip": F.col("ips"), "domain": F.col("domains")})
    new = fp.select("alert_id", F.lit("NEW").alias("verdict"))
    return {r.alert_id: (r.verdict, r.score, r.matched_alert_id) for r in dedup.dedup_l2(fp, TYPES, new, threshold).collect()}


def score(a, b):
    """Per type the mean of best ratios; 0 where one side has none; the mean over types."""
    out = []
    for x, y in sorted(zip(TYPES, zip(a, b))):
        mine, theirs = ([v for v in (vs or []) if v is not None] for vs in y)
        if mine and theirs:
            best = [max(token_sort_score(v, w) for w in theirs) for v in sorted(mine)]
            out.append(round(sum(best) / len(best), 2))
        elif mine or theirs:
            out.append(0.0)
    return round(sum(out) / len(out), 2) if out else None


def brute(rows, threshold=80.0):
    out = {}
    at = lambda r: (r[1], r[0])
    minute = lambda r: int((r[1] - datetime(1970, 1, 1)).total_seconds()) // 1800
    for r in rows:
        found = []
        for e in rows:
            if at(e) < at(r) and (e[2], minute(e)) == (r[2], minute(r)) and e[3].strip().lower() != r[3].strip().lower():
                s = score(r[4:], e[4:])
                if s is not None and s >= threshold:
                    found.append((-s, at(e)))
        best = min(found, default=None)
        out[r[0]] = ("SIMILAR", -best[0], best[1][1]) if best else ("NEW", 0.0, None)
    return out


def test_types_that_neither_has_do_not_count(spark):
    got = run(spark, [row(1, "a", ips=["10.0.0.1"]), row(2, "b", ips=["10.0.0.1"]), row(3, "c", users=["bob"]), row(4, "d"), row(5, "e")])
    assert got[2] == ("SIMILAR", 100.0, 1) and got[3][0] == got[4][0] == got[5][0] == "NEW"


def test_best_of_many_is_taken_from_the_later_alert(spark):
    got = run(spark, [row(1, "a", users=["alice", "bob"]), row(2, "b", users=["bob"]), row(3, "c", users=["bob", "zz"])], 0.0)
    assert got[2] == ("SIMILAR", 100.0, 1) and got[3][1:] == (50.0, 1)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    names = ["alice smith", "smith alice", "alise smith", "bob", "Bob ", "", "root", "admin01", "admin02", "é x", "x" * 70]
    some = lambda pool: rng.choice([None, [], [rng.choice(pool)], [rng.choice(pool), None], [rng.choice(pool) for _ in range(3)]])
    ips = [f"10.0.{i}.{j}" for i in range(3) for j in (1, 17, 171)]
    hosts = [f"{w}.example" for w in ("mail", "mail2", "web", "very-long-name-of-a-host")]
    rows = [row(i, rng.choice(["r1", " R1", "r2", "r3"]), some(names), some(ips), some(hosts), rng.choice("cd"), seconds=rng.randrange(3000)) for i in range(300)]
    for threshold in (80.0, 55.0):
        assert run(spark, rows, threshold) == brute(rows, threshold)


def test_small_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [row(i, f"r{i % 5}", [f"user{rng.randrange(30)}"], [f"10.0.0.{rng.randrange(40)}", f"10.1.{rng.randrange(9)}.1"][: rng.randint(0, 2)]) for i in range(200)]
    want = run(spark, rows)
    monkeypatch.setattr(layer_two, "BLOCK", 16)
    monkeypatch.setattr(layer_two, "CELLS", 50)
    assert run(spark, rows) == want == brute(rows)


def test_bounds_are_above_scores():
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcé01.-Z") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 3)))
    sets = lambda n: [[[text() for _ in range(rng.randint(0, 3))] for _ in range(2)] for _ in range(n)]
    a, b = sets(40), sets(50)
    p = layer_two.Pairing(a, b, 2)
    for i in range(40):
        for j in range(50):
            if any(a[i]) or any(b[j]):
                assert p.bound[i, j] + layer_two.SLACK >= p.score(i, j)
            else:
                assert p.bound[i, j] == -1


def test_a_very_long_value(spark):
    long = "".join(chr(97 + i % 26) for i in range(70_000))
    got = run(spark, [row(1, "a", users=[long]), row(2, "b", users=[long]), row(3, "c", users=["x"])])
    assert got[2] == ("SIMILAR", 100.0, 1) and got[3][0] == "NEW"


def test_a_hot_window_of_20_000_sets(spark, monkeypatch):
    """All share an address, and few are alike: nearly no ratio is computed, no pair leaves."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    word = lambda n: "".join(letters[rng.integers(0, 36, n)])
    rows = [row(i, f"r{i % 7}", [word(12)], ["10.0.0.1"], [word(10)], seconds=i % 1700) for i in range(20_000)]
    twins = {20_000 + i: rows[i * 50] for i in range(50)}
    rows += [row(n, "other", r[4], r[5], [r[6][0][:-1] + "_"], seconds=1750) for n, r in twins.items()]
    began = time.time()
    df = spark.createDataFrame(rows, SCHEMA)
    fp = dedup.fingerprints(df, {"user": F.col("users"), "ip": F.col("ips"), "domain": F.col("domains")})
    got = {r.alert_id: r for r in dedup.dedup_l2(fp, TYPES, fp.select("alert_id", F.lit("NEW").alias("verdict"))).collect()}
    print("hot window", time.time() - began)
    assert time.time() - began < 240 and len(got) == 20_050
    assert all(got[n].matched_alert_id == r[0] and got[n].score == round((90.0 + 100 + 100) / 3, 2) for n, r in twins.items())


def test_families_of_parents_copies_and_variants(spark):
    """Parents are new, exact copies duplicates, variants of another rule similar."""
    rng = random.Random(7)
    parents = [row(i, f"rule {i}", [f"user-{rng.randrange(10**9)}"], [f"{rng.randrange(1, 250)}.{rng.randrange(250)}.{rng.randrange(250)}.{rng.randrange(10, 99)}"], [f"{rng.randrange(10**12):x}.example"]) for i in range(30)]
    copies = [row(100 + i, p[3], *p[4:]) for i, p in enumerate(parents[:20])]
    variants = [row(200 + i, f"variant {i}", p[4], [p[5][0][:-1] + "1"], p[6]) for i, p in enumerate(parents[20:])]
    df = spark.createDataFrame(parents + copies + variants, SCHEMA)
    fp = dedup.fingerprints(df, {"user": F.col("users"), "ip": F.col("ips"), "domain": F.col("domains")})
    got = {r.alert_id: (r.verdict, r.layer, r.matched_alert_id) for r in dedup.dedup(fp, TYPES).collect()}
    assert all(got[i] == ("NEW", 0, None) for i in range(30))
    assert all(got[100 + i] == ("DUPLICATE", 1, i) for i in range(20)) and all(got[200 + i] == ("SIMILAR", 2, 20 + i) for i in range(10))


def test_texts_and_lists_agree(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    new = fp.select("alert_id", F.lit("NEW").alias("verdict"))
    a = dedup.dedup_l2(fp, ["user_name", "ip"], new)
    b = dedup.dedup_l2(fp.withColumn("user_name", F.array("user_name")), ["user_name", "ip"], new)
    assert sorted(a.collect()) == sorted(b.collect()) and alerts(spark, sf_dir).count() == a.count()


def test_few_exchanges(spark, sf_dir):
    counts = {n: QUERIES[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange ") for n in ("dedup_l2", "dedup", "dedup_dashboard_full")}
    assert counts["dedup_l2"] < 25 and counts["dedup"] < 25 and counts["dedup_dashboard_full"] < 40, counts


def test_empty(spark):
    assert run(spark, []) == {}


def test_sets_of_few_lists_are_looked_up():
    """The table of distinct lists has the pairs' own scores; early records are left out."""
    import json

    import pyarrow as pa

    rng = random.Random(8)
    pools = [[[], ["bob"], ["admin bob", "bob"], ["root", "bob", "Bob"]], [["10.0.0.1"], ["10.0.0.14"], []], [["h1.example"], ["h2.example"], ["h2"], []]]
    make = lambda n: [([rng.choice(p) for p in pools], f"r{rng.randrange(3)}", (rng.randrange(500), i)) for i in range(n)]
    a, b = make(90), make(120)
    when = lambda w: {"ts": datetime(1970, 1, 1) + timedelta(microseconds=w[0]), "alert_id": w[1]}
    lists = lambda v: {f"t{t}": json.dumps(x) for t, x in enumerate(v)}
    sa = pa.array([{"key": str(i), "name_hash": n, "early": when(w), "last": when((w[0] + 40, 0)), **lists(v)} for i, (v, n, w) in enumerate(a)])
    sb = pa.array([{"name_hash": n, "first": when(w), **lists(v)} for v, n, w in b])
    table = layer_two.score_table(layer_two.Side(sa, 3), layer_two.Side(sb, 3))
    pairing = layer_two.Pairing([v for v, *_ in a], [v for v, *_ in b], 3)
    for i in range(90):
        for j in range(120):
            assert table[i, j] / 100 == (pairing.score(i, j) if any(a[i][0]) or any(b[j][0]) else -0.01)
    rows, cols, scores = layer_two.paired(sa, sb, 3, 80.0)
    want = []
    for i, (_, n, w) in enumerate(a):
        best, mine = -1.0, []
        for j in sorted(range(120), key=lambda j: b[j][2]):
            if b[j][1] != n and b[j][2] < (w[0] + 40, 0) and table[i, j] >= 8000 and table[i, j] > best:
                best = table[i, j]
                mine.append((i, j, best / 100))
        before = [m for m in mine if b[m[1]][2] < w]
        want += before[-1:] + mine[len(before) :]
    assert list(zip(rows.tolist(), cols.tolist(), scores.tolist())) == want and want
