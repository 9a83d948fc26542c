"""Running totals and quantiles in ranges, sources by tokens, and small forms, by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.functions import text as T
from alertweave.operators import aggregates, entities, evaluation, ordered, windows
from alertweave.operators import dedup as D
from alertweave.sources import files


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_continuous_scores(spark, descending):
    rng = random.Random(3)
    rows = [(rng.choice([rng.gauss(0, 1), 1e9, -5.0, 0.25]), rng.randint(0, 9), i) for i in range(500)]
    rows = [r for r in rows] + [(7.5, 3, 1000)]
    rows = [(x + (i if x in (1e9, -5.0, 0.25) else 0) * 1e-3, n, i) for x, n, i in rows]  # distinct
    got = {r.i: (r.s, r.s_all) for r in ordered.running(spark.createDataFrame(rows, "x double, n long, i long"), F.col("x"), {"s": F.col("n")}, descending, ranges=16).collect()}
    total = 0
    for _, n, i in sorted(rows, reverse=descending):
        total += n
        assert got[i] == (total, sum(n for _, n, _ in rows))


def test_no_window_over_everything(spark):
    df = spark.createDataFrame([(i, random.Random(i).random(), i % 2) for i in range(300)], "id long, score double, y int")
    for out in (evaluation.gain_lift(df), evaluation.lane_purity(df), evaluation.roc_auc(df), evaluation.pr_auc(df), evaluation.ks(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows_ = [line for line in plan.splitlines() if "Window [" in line]
        assert windows_ and all("__r" in line for line in windows_), windows_  # within a range, or over ranges


def test_exact_quantiles(spark):
    rng = random.Random(5)
    for values in ([rng.random() for _ in range(777)], [rng.randint(0, 4) for _ in range(50)], [3.0], [2.0, 2.0, 9.0]):
        shares = [0.0, 0.0005, 0.1, 0.25, 0.5, 0.7, 0.9995, 1.0]
        q = ordered.quantiles(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", shares).first().q
        assert np.allclose(q, np.quantile(values, shares), rtol=0, atol=1e-12)
    assert not ordered.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q


def test_curves_of_continuous_scores(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    s, y = rng.normal(size=400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0])
    one = evaluation.losses(df.withColumn("p", 1 / (1 + F.exp(-F.col("score")))), F.col("p")).first()
    p = 1 / (1 + np.exp(-s))
    assert one.auc == pytest.approx(wins / (y.sum() * (1 - y).sum())) and one.gini == pytest.approx(2 * one.auc - 1)
    assert one.brier == pytest.approx(np.mean((p - y) ** 2)) and one.log_loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    order = np.argsort(s)
    assert evaluation.ks(df).first().ks == pytest.approx(max(abs(np.cumsum(y[order]) / y.sum() - np.cumsum(1 - y[order]) / (1 - y).sum())))
    split = {r.score: r.split for r in evaluation.time_split(df.withColumn("t", F.timestamp_seconds(F.col("score") * 1e6)), "t").collect()}
    assert abs(sum(v == "train" for v in split.values()) - 280) <= 1


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(53)], "i int, k int")
    want = sorted(((i % 7, i) for i in range(53)))
    for number in (-3, 0, 2, 5, 99):
        at = min(max(number, 0), 5) * 10
        got = aggregates.page(df, [F.col("k"), F.col("i")], number, 10).collect()
        assert [(r["rank"], r.k, r.i) for r in got] == [(at + n + 1, *x) for n, x in enumerate(want[at : at + 10])]
    assert aggregates.page(df.limit(0), [F.col("i")], 1, 10).collect() == []


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.slug(F.lit("  --10.1.2.3// "))) == "10_1_2_3" and one(T.slug(F.lit("..."))) == ""
    assert one(T.elided(F.lit("x" * 46))) == "x" * 46 and one(T.elided(F.lit("a" * 30 + "b" * 30))) == "a" * 26 + "…" + "b" * 18
    text = "user: bob\nip: 1.2.3.4\n\nlast"
    keys = [spark.range(1).select(T.key_at(F.lit(text), F.lit(i)).alias("x")).first().x for i in (0, 9, 10, 15, 21, 22, 24)]
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def plain(offset):
        at = max(s for s in starts if s <= offset)
        return text[at:].split("\n")[0].split(":", 1)[0]

    assert keys == [plain(i) for i in (0, 9, 10, 15, 21, 22, 24)]
    assert one(T.blocked_ioc(F.lit("domain"), F.lit("deep.sub.windowsupdate.com"))) and not one(T.blocked_ioc(F.lit("domain"), F.lit("notwindows.com")))
    assert not one(T.blocked_ioc(F.lit("url"), F.lit("google.com"))) and one(T.blocked_ioc(F.lit("ip"), F.lit("149.112.112.112")))
    for key, yes in {"src_user": True, "userName": True, "user_priority": False, "accountName": True, "dest_ip": False, "ownerEmail": False}.items():
        assert one(T.is_identity_key(F.lit(key))) is yes


def plain_spans(tokens, text, least, trusted):
    spans, current = [], None
    for pos, start, end, tag, score in sorted(tokens):
        if start == end:
            continue
        head, _, kind = tag.partition("-")
        if head == "O" or not kind:
            current = None
            continue
        if head == "B" or current is None or current[0] != kind:
            current = [kind, start, end, score]
            spans.append(current)
        else:
            current[2], current[3] = end, min(current[3], score)
    return sorted((k, s, e, c, text[s:e].strip()) for k, s, e, c in spans if c >= least and k in trusted and text[s:e].strip())


def test_merged_spans_against_a_loop(spark):
    rng = random.Random(8)
    tokens, texts, want = [], [], {}
    for d in range(40):
        text, at, own = "", 0, []
        for pos in range(rng.randint(0, 40)):
            word = rng.choice(["", " a", " bc", "d", "  "])
            own.append((pos, at, at + len(word), rng.choice(["O", "B-X", "I-X", "I-Y", "B-Y", "I-Z"]), rng.random()))
            text, at = text + word, at + len(word)
        tokens += [(d, *t) for t in own]
        texts.append((d, text))
        want[d] = plain_spans(own, text, 0.3, {"X", "Y"})
    got = entities.merged_spans(spark.createDataFrame(tokens, "d int, pos int, start int, end int, tag string, score double"), spark.createDataFrame(texts, "d int, text string"), "d", 0.3, ["X", "Y"])
    by = {d: [] for d in want}
    for r in got.collect():
        by[r.d].append((r.label, r.start, r.end, r.score, r.value))
    assert {d: sorted(x) for d, x in by.items()} == want


def test_hold_and_sort(spark):
    rows = [("q", 100.0, 5), ("q", 101.0, 2), ("q", 103.5, 9), ("q", 110.0, 1), ("r", 50.0, 3)]
    df = spark.createDataFrame(rows, "k string, s double, id int").withColumn("t", F.timestamp_seconds("s"))
    got = {r.id: (r.batch, r.place, r.held, r.out) for r in windows.hold_and_sort(df, "k", "t", "id", 3.0).select("id", "batch", "place", "held", F.unix_millis("released_at").alias("out")).collect()}
    assert got == {2: (0, 1, 3, 106500), 5: (0, 2, 3, 106500), 9: (0, 3, 3, 106500), 1: (1, 1, 1, 113000), 3: (0, 1, 1, 53000)}


def test_context_similarity(spark):
    w = {"identity": {"name": 60.0, "sector": 40.0}}
    obj = lambda kind, **p: F.struct(F.lit(kind).alias("type"), F.create_map(*[F.lit(x) for kv in p.items() for x in kv]).alias("props"))
    score = lambda a, b: spark.range(1).select(D.context_similarity(F.array(*a), F.array(*b), w).alias("x")).first().x
    assert score([obj("identity", name="a", sector="s")], [obj("identity", name="a", sector="t"), obj("identity", name="b")]) == 60.0
    assert score([obj("identity", name="a")], [obj("identity", name="a", sector="t")]) == 100.0
    assert score([obj("identity", name="a")], [obj("other", name="a")]) == 0.0
    assert score([obj("identity", name="a"), obj("identity", name="zz")], [obj("identity", name="a")]) == 100.0  # what agrees in nothing isn't counted


def test_fuzzy_layer_compares_what_length_allows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    rows = [(i, f"2024-01-01 00:{i % 30:02d}:00", "c", rng.choice(["r1", "r2", "r3"]), word(), word(), word() + " " + word()) for i in range(120)]
    df = spark.createDataFrame(rows, "alert_id long, ts string, customer string, alert_name string, u string, v string, w string").withColumn("ts", F.to_timestamp("ts"))
    fp = D.fingerprints(df, {"user": F.array("u"), "ip": F.array("v"), "domain": F.array("w")})
    l1 = D.dedup_l1(fp)
    got = {r.alert_id: (r.verdict, r.score, r.matched_alert_id) for r in D.dedup_l2(fp, ["u", "v", "w"], l1, 60.0).collect()}
    from alertweave.functions.similarity import token_sort_score

    left = {r.alert_id for r in l1.filter("verdict = 'NEW'").collect()}
    want = {}
    for a in rows:
        best = None
        for b in rows:
            if (b[1], b[0]) < (a[1], a[0]) and b[3] != a[3]:
                s = round(sum(round(token_sort_score(x, y), 2) for x, y in zip(a[4:], b[4:])) / 3, 2)
                if s >= 60.0 and (best is None or (-s, b[1], b[0]) < best):
                    best = (-s, b[1], b[0])
        if a[0] in left:
            want[a[0]] = ("SIMILAR", -best[0], best[2]) if best else ("NEW", 0.0, None)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(math.isclose(got[k][1], want[k][1], abs_tol=0.011) for k in want)


def test_token_paged_source(spark):
    def log_service(first, end, token, page):
        rows = [(t, f"line {t}") for t in range(first, end) if t % 3 == 0]
        at = int(token or 0)
        return rows[at : at + page], str(at + page) if at + page < len(rows) else None

    spark.dataSource.register(files.token_paged_source("logs_by_token", log_service, 1000, 1997, "t long, line string", slices=5, page=7))
    got = sorted(r.t for r in spark.read.format("logs_by_token").load().filter(F.col("line").rlike("(?i)LINE 1[0-9]")).collect())
    assert got == [t for t in range(1000, 1997) if t % 3 == 0]


def test_run_consistency(spark):
    rows = [(1, "a", 2.0), (1, "b", 4.0), (2, "b", 5.0), (2, "b", 5.0), (3, "b", 1.0), (3, None, 1.0)]
    r = aggregates.run_consistency(spark.createDataFrame(rows, "run int, v string, s double"), "run", "v", "s").first()
    assert (r.runs, r.least, r.most, r.in_all, r.in_any) == (3, 1.0, 5.0, 1, 2)


def test_first_layer_joins_on_rare_slots_only(spark):
    """Eight slots of few values: every pair at the threshold is found through its prefix."""
    rng = random.Random(9)
    names = [f"s{i}" for i in range(8)]
    rows = [(i, f"2024-01-01 00:{i % 30:02d}:00", "c", "rule", [rng.choice(["x", "x", "x", "y", None]) for _ in names]) for i in range(150)]
    df = spark.createDataFrame(rows, "alert_id long, ts string, customer string, alert_name string, v array<string>").withColumn("ts", F.to_timestamp("ts"))
    fp = D.fingerprints(df, {n: F.array(F.get("v", F.lit(i))) for i, n in enumerate(names)})
    for threshold in (0.5, 0.8, 1.0):
        pairs = {(r.a, r.b): r.confidence for r in D.l1_matches(fp, threshold).collect()}
        every = {(r.a, r.b): r.confidence for r in D.l1_candidates(fp).collect() if r.confidence >= threshold}
        assert pairs == every and every


def test_first_layer_counts_without_pairs(spark):
    """Slots with few values, some absent, and one address that all share."""
    rng = random.Random(10)
    names = [f"s{i}" for i in range(5)]
    rows = [(i, "2024-01-01 00:00:00", f"c{i % 2}", "rule", ["same", *[rng.choice(["x", "y", None]) for _ in names[1:]]] if i % 9 else [None] * 5) for i in range(200)]
    df = spark.createDataFrame(rows, "alert_id long, ts string, customer string, alert_name string, v array<string>").withColumn("ts", F.to_timestamp("ts"))
    fp = D.fingerprints(df, {n: F.array(F.get("v", F.lit(i))) for i, n in enumerate(names)})
    want = {(r.matched, r.confidence): r.n for r in D.l1_candidates(fp).groupBy("matched", "confidence").agg(F.count("*").alias("n")).collect()}
    got = {}
    for r in D.l1_counts(fp, names).collect():
        got[r.matched, r.confidence] = got.get((r.matched, r.confidence), 0) + r.n
    assert got == want and len(want) > 8
    assert D.l1_counts(fp.limit(0), names).count() == 0


def test_joined_terms_equal_broadcast_terms(spark, sf_dir):
    from alertweave.operators import tfidf
    from alertweave.sources.views import table

    docs = table(spark, sf_dir, "documents")
    rows = [{(r.doc_id, r.term): round(r.weight, 9) for r in tfidf.weights(docs, "doc_id", tfidf.words(F.col("text")), 1, few=few).collect()} for few in (200_000, 0)]
    assert rows[0] == rows[1] and rows[0]


def test_offsets_of_many_matches(spark):
    import re as plain_re

    from alertweave.functions import arrays, text

    texts = ["", "a", "ab " * 3000, "x" * 700 + " \U0001f600ab", None, "ab"]
    got = {r.i: r.m for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.spans(F.col("t"), "ab").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert [(m.first, m.end, m.found) for m in got[i] or []] == [(m.start(), m.end(), m[0]) for m in plain_re.finditer("ab", t or "")]
    xs = [random.Random(3).randint(0, 9) for _ in range(1000)]
    out = spark.createDataFrame([(xs,), ([],), ([4],)], "x array<int>").select(arrays.sums_before(F.col("x"), 7).alias("s")).collect()
    assert [r.s for r in out] == [[sum(xs[:i]) for i in range(1000)], [], [0]]


def test_inventory_of_awkward_records(spark):
    from alertweave.sources import files

    lines = ['{"disposition":"A","server":"s","close_time":"t","CEF":[{"a":1},{"b":2}]}', '{"disposition":"A","server":"s","CEF":[]}', '{"disposition":""}', "no json", None, '{"disposition":"B","CEF":null,"x":1}']
    got = {r.key: r.n for r in files.inventory(spark.createDataFrame([(x,) for x in lines], "j string"), "j", ["A"]).collect()}
    assert got == {
        "records": 6, "labelled": 2, "unlabelled": 4, "no_close_time": 1, "disposition:A": 2, "disposition:(none)": 3, "disposition:B": 1, "server:s": 2, "server:": 4,
        "artifacts:2": 1, "artifacts:0": 5, "key:disposition": 4, "key:server": 2, "key:close_time": 1, "key:CEF": 3, "key:x": 1,
    }


def test_forward_scores_see_earlier_folds_only(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    rng = random.Random(11)
    rows = [(i, float(rng.random() < 0.5) if i >= 20 else 0.0, Vectors.dense(rng.random(), rng.random())) for i in range(120)]
    df = evaluation.forward_folds(spark.createDataFrame(rows, ["id", "label", "features"]), ["id"])
    got = {r.id: (r.fold, r.score) for r in evaluation.forward_scores(df, 5).collect()}
    assert set(got) == set(range(20, 120)) and all(s is None for f, s in got.values() if f == 1)  # fold 0 has one class
    for k in (2, 5):
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(df.filter(F.col("fold") < k))
        for r in model.transform(df.filter(F.col("fold") == k)).select("id", F.get(vector_to_array("probability"), F.lit(1)).alias("s")).collect():
            assert got[r.id] == (k, pytest.approx(r.s, abs=1e-9))


def test_a_text_meets_its_spans_once(spark):
    """One long text with characters beyond 16 bits: cut by place, not by a walk for each span."""
    words = ["\U0001f600a", "bc", "ä", "d"] * 500
    text, tokens = " ".join(words), []
    for i, w in enumerate(words):
        at = sum(len(x) + 1 for x in words[:i])
        tokens.append((1, i, at, at + len(w), "B-X", 0.9))
    df = entities.merged_spans(spark.createDataFrame(tokens, "d int, pos int, start int, end int, tag string, score double"), spark.createDataFrame([(1, text), (2, None)], "d int, text string"), "d", 0.3, ["X"])
    assert [r.value for r in sorted(df.collect(), key=lambda r: r.start)] == words
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "substring" not in plan


def odd_texts():
    rng = random.Random(21)
    words = ["", "a", "bc", "def", "hosts", "\U0001f600x", "user.x", "a\tb", "x\ny", "longer-word", " "]
    return [None, "", " ", "   ", "a", "hosts", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]]


def spans_both_ways(spark, texts):
    """Of documents with keys of their own: in their rows, and from tokens."""
    from alertweave.plans import entities as plans

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = entities.listed_spans(docs, "doc_id", plans.tags_of, plans.LABELS, 0.2, plans.LABELS)
    return listed, entities.merged_spans(plans.tagged(docs), docs, "doc_id", 0.2, plans.LABELS)


def test_listed_spans_equal_merged_spans(spark):
    """Nothing is dealt out to make them, so no disk is needed."""
    listed, merged = spans_both_ways(spark, odd_texts())
    spans = listed.select("doc_id", F.inline("spans"))
    assert spans.dtypes == merged.dtypes
    assert sorted(spans.collect()) == sorted(merged.collect()) and spans.count() > 200
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_listed_values_equal_value_lists(spark):
    """The values of a label are put together in their document's row."""
    from alertweave.plans import entities as plans

    listed, merged = spans_both_ways(spark, odd_texts())
    values = entities.listed_values(listed, "doc_id", plans.LABELS)
    assert sorted(values.collect()) == sorted(entities.value_lists(merged, "doc_id").collect()) and values.count() > 60
    assert "Exchange" not in values._jdf.queryExecution().executedPlan().toString()


def test_listed_spans_leave_out_untrusted_labels(spark):
    import numpy as np

    def tag(text):
        return np.array([0, 2, 2, 4, 6]), np.array([1, 3, 2, 5, 7]), np.array([0, 0, 1, 1, 0]), np.array([True, False, True, False, True]), np.array([0.9, 0.4, 0.1, 0.8, 0.2])

    docs = spark.createDataFrame([(1, "a b c d")], "d int, text string")
    pick = lambda least, trusted: [tuple(s) for r in entities.listed_spans(docs, "d", tag, ["X", "Y"], least, trusted).collect() for s in r.spans]
    assert pick(0.3, ["X", "Y"]) == [("X", 0, 3, 0.4, "a b"), ("Y", 4, 5, 0.8, "c")]
    assert pick(0.3, ["Y"]) == [("Y", 4, 5, 0.8, "c")] and pick(0.95, ["X", "Y"]) == []


def test_many_spans_leave_a_batch_in_parts(spark, monkeypatch):
    texts = odd_texts()
    want = sorted(spans_both_ways(spark, texts)[0].collect())
    monkeypatch.setattr(entities, "LISTED", 7)
    assert sorted(spans_both_ways(spark, texts)[0].collect()) == want


def test_spans_of_documents_that_share_a_key(spark, tmp_path):
    """They are tagged as one document, as before."""
    from alertweave.plans import entities as plans

    rows = [(1, "host abc defghi"), (1, "host abc defghi"), (2, "abc hosts x"), (None, "abc defghi")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    merged = entities.merged_spans(plans.tagged(docs), docs, "doc_id", 0.2, plans.LABELS)
    assert sorted(plans.ner_spans(spark, str(tmp_path)).collect()) == sorted(merged.collect()) != []
    assert {r.doc_id for r in plans.ner_values(spark, str(tmp_path)).collect()} == {1, 2}
