"""Importance resampling against a plain loop over rows."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from alertweave.llm import importance, queries

from . import util

BENCH = "item_id bigint, text string"


def features(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return len(w), [crc32(x) % 10000 for x in w] + [crc32(a + b" " + b) % 10000 for a, b in zip(w, w[1:])]


def brute(docs, bench):
    found = [(d, *features(t)) for d, t, *_ in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for _, text in bench:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (s_all + 10000)) / float((s[b] + 1) * (t_all + 10000))))
    rows = []
    for d, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: 25 * len(fit) // 100]
    return rows, [r[0] for r in drawn]


def spread(spark, tmp_path, rows, bench):
    sf = util.saved(spark, tmp_path, rows, benchmark=(bench, BENCH))
    return queries.op13_importance(spark, sf).collect()


def compare(got, docs, bench):
    rows, drawn = brute(docs, bench)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((d, n, w, s) for d, _, n, w, s in rows), key=key)
    ranked = sorted((r.rank, r.doc_id) for r in got if r["rank"] is not None)
    assert [r for r, _ in ranked] == list(range(1, len(drawn) + 1)) and [d for _, d in ranked] == drawn


def test_odd_rows_copies_and_ties(spark, tmp_path):
    rng = random.Random(13)
    bench = [(1, "seven wizards quietly mix potions"), (2, None), (3, "Ünïcode 東京 stone bridge"), (3, "stone bridge")]
    docs = util.doc_rows() + [(100 + i, " ".join(rng.choice("alpha beta gamma delta stone bridge é9 x".split()) for _ in range(rng.randint(15, 60))), "en", "a", 1) for i in range(80)]
    docs += [(300 + i, docs[20][1], None, "b", 1) for i in range(60)]  # a third are one text
    docs += [(400, "w" * 200_000 + " " + "v" * 70, "en", "a", 1), (401, "one-two_three\x00four\x7ffive", "en", "a", 1)]
    compare(spread(spark, tmp_path, docs, bench), docs, bench)


def test_empty_tables(spark, tmp_path):
    docs = util.doc_rows()
    compare(spread(spark, tmp_path / "a", docs, []), docs, [])
    assert spread(spark, tmp_path / "b", [], [(1, "some text")]) == []


def test_other_columns_and_parameters(spark):
    docs = util.clashing(util.docs(spark)).withColumnRenamed("text", "body").withColumnRenamed("doc_id", "ident")
    bench = spark.createDataFrame([("seven wizards",)], "body string")
    out = importance.resampled(docs, bench, percent=100, least_words=1, order=3, buckets=64, id_col="ident", text_col="body")
    assert out.columns == ["ident", "n_words", "n_features", "weight", "score", "rank"]
    rows = out.collect()
    assert len(rows) == 12 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 10))
    assert all(r.n_features == max(0, 3 * r.n_words - 3) or r.n_words < 3 for r in rows)


def test_an_identical_text_is_featured_once(spark):
    docs = util.docs(spark, [(i, f"text number {i % 3}", "en", "a", 1) for i in range(300)])
    each = importance.collapsed(docs, 2, 10_000)
    assert sorted(r.copies for r in each.collect()) == [100, 100, 100]
