"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np

from alertweave.llm import collocations, queries

from . import util


def brute(docs, longest=5, least=100, top=2000, cover=100):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    often = {p: c for p, c in f.items() if c >= least}
    covered = set()
    for (lang, p), c in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * c >= cover * f[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    rows = {}
    for (lang, p), a in often.items():
        if len(p) < 2 or (lang, p) in covered:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = set()
    for lang, own in rows.items():
        own.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, i + 1, *r) for i, r in enumerate(own[:top])}
    return out


def rows_of(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts(rng, n):
    vocabulary = ["der", "of", "The", "é", "東京", "x-y", "(so", "so)", "w\x00", "a_b", "don't", "\xa0", "#1"] + [f"v{i}" for i in range(30)]
    fixed = ["the state of the art", "once upon a time", "New York City", "x-y  of\tThe state"]
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        yield i, rng.choice([" ", ", ", ". ", "\n", "\t", ";\x0b"]).join(parts), rng.choice(["en", "en", "de", None, ""]), "a", 1


def test_against_a_plain_count(spark, monkeypatch):
    rng = random.Random(5)
    docs = list(texts(rng, 400)) + util.doc_rows() + [(1000 + i, "copies of one text stay copies", "en", "a", 1) for i in range(200)]
    monkeypatch.setattr(collocations, "TEXT_BYTES", 3000)
    for least, cover, buckets in ((100, 100, 1 << 23), (7, 100, 1 << 13), (3, 60, 1 << 14)):
        got = rows_of(collocations.collocations(util.docs(spark, docs), least=least, cover=cover, buckets=buckets))
        assert got == brute(docs, least=least, cover=cover), (least, cover, buckets)


def test_the_first_ranks_only(spark):
    docs = list(texts(random.Random(6), 300))
    got = rows_of(collocations.collocations(util.docs(spark, docs), longest=3, least=4, top=5, buckets=1 << 14))
    assert got == brute(docs, longest=3, least=4, top=5)


def test_empty_and_without_candidates(spark, tmp_path):
    assert queries.op11_collocations(spark, util.saved(spark, tmp_path, [])).collect() == []
    assert collocations.collocations(util.docs(spark)).filter("lang = 'fr'").collect() == []


def test_other_columns(spark):
    docs = [(i, "one two three", "en", "a", 1) for i in range(120)]
    df = util.clashing(util.docs(spark, docs)).withColumnsRenamed({"text": "body", "lang": "tongue"})
    out = collocations.collocations(df, text_col="body", lang_col="tongue")
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(out) == {("en", 1, "one two three", 120, 120, 120, 360, 3000)}


def test_products_past_64_bits(spark):
    """The exact quotient, where products need over 64 bits."""
    a, n, left, right = 4_000_000_000_007, 9_000_000_000_000_011, 5_000_000_000_021, 6_000_000_000_033
    exact = "cast(a as decimal(19,0)) * cast(words as decimal(19,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    row = spark.createDataFrame([(a, n, left, right)], "a bigint, words bigint, l bigint, r bigint").selectExpr(f"{exact} as score").first()
    assert row.score == 1000 * a * n // (left * right)


def test_pruning_keeps_what_is_frequent():
    """A bucket's clipped partial counts come to ``least`` if and only if the counts do."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        parts = rng.integers(0, 150, (6, 40))
        assert ((np.minimum(parts, 100).sum(0) >= 100) == (parts.sum(0) >= 100)).all()
