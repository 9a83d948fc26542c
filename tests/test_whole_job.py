"""Whole jobs against brute force, where a narrower one would pass unnoticed."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from alertweave.functions import similarity as S


def test_cosine_match_crosses_labels(spark, sf_dir):
    from alertweave.plans import indicators

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label").collect()
    label = {r.vec_id: r.label for r in rows}
    got = {r.a: r.n for r in indicators.cosine_match_all(spark, sf_dir).collect()}
    narrow = {r.a: r.n for r in indicators.cosine_match(spark, sf_dir).collect()}  # the higher bound
    assert set(got) == {k for k in label if k % 20 == 0}
    assert all(got[a] >= n for a, n in narrow.items()) and sum(got.values()) > sum(narrow.values())


def test_cosine_counts_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, -1.0]), (40, None), (60, [0.0, 0.0]), (80, [1.0, 0.0, 0.0]), (1, [2.0, 0.1]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (None, [3.0, 0.0]), (3, None), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or not any(x) or not any(y):
            return None
        return sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))

    want = {a: 0 for a, _ in rows if a is not None and a % 20 == 0}
    for a, x in rows:
        for b, y in rows:
            if a in want and b != a and (c := cosine(x, y)) is not None and c >= 0.1:
                want[a] += 1
    assert want[0] == 8 and want[20] == 0
    for block, deals, rows_ in ((2, 3, 2), (1024, 3, 1), (2, None, None)):
        got = S.cosine_counts(df.filter("vec_id % 20 = 0"), df, 0.1, block=block, deals=deals, query_deals=rows_)
        assert {r.a: r.n for r in got.collect()} == want


NAME = re.compile(r"\b[A-Z][a-z]{5,}\b", re.A)


def test_spans_against_whole_texts(spark, tmp_path):
    from alertweave.plans import indicators

    rng = random.Random(4)
    parts = ["London", "Londoner", "preLondon", "Berlin.", "a", "\U0001f600", "x9", "(Madrid)", "Q" + "w" * 97, "Q" + "w" * 98, "Q" + "w" * 99, "Q" + "w" * 300]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += ["x" * k + " " + "London " * 200 for k in range(480, 510)] + ["London", "", None, "Q" + "w" * 1300, "y" * 592 + " Londons", "y" * 593 + " London"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.value) for r in indicators.span_dedupe(spark, str(tmp_path)).collect())
    assert got == sorted((d, m.start(), m[0]) for d, t in enumerate(texts) for m in NAME.finditer(t or ""))


def test_metric_grid_against_brute_force(spark, sf_dir):
    import numpy as np

    from alertweave.plans import evaluations
    from alertweave.sources.views import scores

    rows = scores(spark, sf_dir).select("score", "y").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.y for r in rows])
    got = sorted(evaluations.metric_sweep_600(spark, sf_dir).collect(), key=lambda r: r.threshold)
    grid = np.quantile(s, np.linspace(0.0005, 0.9995, 600))
    assert {round(r.threshold, 6) for r in got} == {round(t, 6) for t in grid.tolist()} and len(got) > 50
    for r in got:
        at = s >= r.threshold
        tp, fp, fn, tn = (int((a & b).sum()) for a, b in ((at, y == 1), (at, y == 0), (~at, y == 1), (~at, y == 0)))
        root = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        assert math.isclose(r.f1, 2 * tp / (2 * tp + fp + fn)) and math.isclose(r.mcc, (tp * tn - fp * fn) / root if root else 0.0, abs_tol=1e-12)
        assert math.isclose(r.accuracy, (tp + tn) / len(s)) and math.isclose(r.specificity, tn / (tn + fp))
    for x in ("f1", "mcc"):
        assert [r.threshold for r in got if r[f"best_{x}"]] == [max(got, key=lambda r: (r[x], -r.threshold)).threshold]


def test_bootstrap_has_400_rounds(spark, sf_dir):
    from alertweave.operators import evaluation as E
    from alertweave.plans import evaluations
    from alertweave.sources.views import scores

    assert evaluations.bootstrap_ci(spark, sf_dir).collect() == E.bootstrap_auc(scores(spark, sf_dir), 400).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_terms_are_all_broadcast(spark):
    """Rare terms move to no other task while all terms together are few."""
    from alertweave.operators import tfidf

    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 50} both") for i in range(3000)], "doc_id long, text string")
    words = tfidf.words(F.col("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [plan_of(tfidf.weights(docs, "doc_id", words, 1, few=few)) for few in (200_000, 10)]
        got = [{(r.doc_id, r.term): round(r.weight, 9) for r in tfidf.weights(docs, "doc_id", words, 1, few=few).collect()} for few in (200_000, 10, 3, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert len(got[0]) == 9000 and all(g == got[0] for g in got)


def test_words_of_a_window_are_taken_once(spark):
    """However often the encoder names them."""
    from alertweave.operators import pooling

    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    out = pooling.pooled(docs, "id", "text", lambda w: F.array(*[F.size(w).cast("double") * k for k in range(1, 7)]))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1 and len(out.first().vector) == 6


def term_docs(spark):
    rows = [(i, f"w{i % 7} v{i % 50} both both x{i // 3} once{i}") for i in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, ""), (402, "once only")], "doc_id long, text string")


def test_known_terms_move_nothing(spark):
    """Documents and their terms stay where they are read while all terms are known."""
    from alertweave.operators import tfidf

    docs = term_docs(spark)
    plan = plan_of(tfidf.weights(docs, "doc_id", tfidf.words(F.col("text")), 2))
    assert "Exchange" not in plan and "Window" not in plan
    m = tfidf.matched(docs, "doc_id", tfidf.words(F.col("text")), 1, 2, 60)
    assert sum(len(r.ids) for r in m.known.collect()) == 1200
    assert sorted({r.term[0] for r in m.rest.collect()}) == ["x"]  # w, v and both are known; once has no second document


def test_listed_terms_equal_joined_terms(spark, monkeypatch):
    """The best terms of documents in their rows, and from a table of all weights."""
    from alertweave.operators import tfidf

    docs, words = term_docs(spark), tfidf.words(F.col("text"))
    monkeypatch.setattr(tfidf, "PART", 20)
    want, shown = None, lambda df: sorted((r.doc_id, r.rank, r.term, round(r.contribution, 8)) for r in df.collect())
    for few in (200_000, 40, 3, 0):
        m = tfidf.matched(docs, "doc_id", words, 1, 2, few)
        lists = tfidf.listed(m, "doc_id")
        weights = tfidf.flat(lists, m, "doc_id")
        coef = weights.groupBy("term").agg((F.avg("weight") - 0.3).alias("coef")).filter("term <> 'v3'")
        got = shown(tfidf.top_listed(lists, m, coef, "doc_id", 2))
        want = want or shown(tfidf.top_terms(weights, coef, "doc_id", 2))
        assert got == want and len(want) == 800
        numbers = {r.doc_id: r.terms for r in tfidf.term_numbers(docs, "doc_id", words, 1).collect()}
        assert numbers == {r.doc_id: r.n for r in weights.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} and len(numbers) == 400


def test_terms_of_rows_that_share_a_key(spark):
    """They are one document, and no pair of words crosses them."""
    from alertweave.operators import tfidf

    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "aa bb cc"), (3, "dd"), (None, "dd")], "k long, text string")
    for few in (200_000, 2, 0):
        got = {(r.k, r.term): r.weight for r in tfidf.weights(docs, "k", tfidf.words(F.col("text")), 2, few=few).collect()}
        assert set(got) == {(k, t) for k in (1, 2) for t in ("aa", "bb", "cc", "aa bb", "bb cc")} | {(3, "dd"), (None, "dd")}
        idf = math.log(4 / 3) + 1
        length = math.sqrt(4 * idf**2 + ((1 + math.log(2)) * idf) ** 2)
        assert got[1, "bb"] == pytest.approx((1 + math.log(2)) * idf / length) and got[1, "aa bb"] == pytest.approx(idf / length) and got[None, "dd"] == 1
    assert {r.k: r.terms for r in tfidf.term_numbers(docs, "k", tfidf.words(F.col("text"))).collect()} == {1: 5, 2: 5, 3: 1, None: 1}
