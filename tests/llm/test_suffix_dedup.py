import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from alertweave.llm import suffix_dedup as S

from . import util


def brute(docs, length=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in docs]
    key = lambda d: S.NO_ID if d is None else d
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(key(d), least.get(w, S.NO_ID))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    assert rows(S.repeated(util.docs(spark, docs))) == want
    assert rows(S.repeated(util.docs(spark, docs), run_bytes=20_000)) == want


def test_repeats_of_all_kinds(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(40), "x" * 49
    docs = []
    for i in range(120):
        t = text(rng.randint(0, 30))
        k = i % 6
        if k == 0:
            t = t + shared + text(5)
        elif k == 1:
            at = rng.randrange(len(shared) - 60)
            t = shared[at : at + rng.randint(45, 60)] + t
        elif k == 2:
            t = "ab" * rng.randint(20, 60) + t
        elif k == 3:
            t = (line + "\n") * rng.randint(0, 3) + t
        elif k == 4:
            t = "é" * rng.randint(10, 60)
        docs.append((rng.choice([i, i, i + 500, i % 7]), t, "en", "a", 1))
    assert rows(S.repeated(util.docs(spark, docs).repartition(5), run_bytes=900)) == brute(docs)


def test_a_gram_in_all_documents(spark):
    """A hot anchor's suffixes go by all their bytes; so do those of a hot line."""
    rng = random.Random(17)
    line = "this line of over fifty bytes stands in every document of the table"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    tails = [text(12) for _ in range(6)]
    docs = []
    for i in range(150):
        common = (line, "0123456789abcdefghij0123456789ABCDEFG", "ab" * 45)[i % 3]
        docs.append((i, text(rng.randint(0, 9)) + common + rng.choice([*tails, text(8)]), "en", "a", 1))
    rng.shuffle(docs)
    for hot in (1, 40, 10**6):
        assert rows(S.repeated(util.docs(spark, docs).repartition(3), run_bytes=3_000, hot_keys=hot)) == brute(docs), hot


def test_rows_of_one_id_are_dealt_to_many_runs(spark):
    docs = [(d, f"{i} " * 20 + "the same passage of text, much longer than fifty bytes, in all of the rows", "en", "a", 1) for i in range(60) for d in (None, 4)]
    df = util.docs(spark, docs)
    assert rows(S.repeated(df, run_bytes=500)) == brute(docs)


def test_blobs_stay_in_proportion():
    runs = lambda total: -(-total // max(S.RUN_BYTES, S.math.isqrt(S.BLOB * total)))
    for total in (10**9, 10**11, 10**13, 10**14):
        assert runs(total) ** 2 <= 1.01 * max(total / S.BLOB, (total / S.RUN_BYTES) ** 2 if total < 64 * 10**9 else 0) + 1


def test_awkward_rows(spark):
    docs = util.doc_rows()
    assert rows(S.repeated(util.clashing(util.docs(spark)))) == brute(docs)
    assert S.repeated(util.docs(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    coded = [(r, [0] + [S.shared_prefix(a, b, 0) for a, b in zip(r, r[1:])]) for r in runs]
    which, place, shared = S.merged(coded)
    out = [runs[w][p] for w, p in zip(which, place)]
    assert out == sorted(x for r in runs for x in r)
    assert shared[1:] == [S.shared_prefix(a, b, 0) for a, b in zip(out, out[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=8), min_size=1, max_size=40), st.integers(0, 1 << 40))
def test_codings_round_trip(keys, base):
    mat = np.frombuffer(b"".join(sorted(set(keys))), np.uint8).reshape(-1, 8)
    ids = np.arange(len(mat)) + base
    back, shared, got = S.front_decoded(S.front_coded(mat, ids))
    assert (back == mat).all() and (got == ids).all()
    h = np.unique(np.frombuffer(b"".join(keys), np.uint64) >> np.uint64(16))
    flags = (h % np.uint64(7)).astype(np.uint8)
    a, b = S.unpacked_hashes(S.packed_hashes(h, flags))
    assert (a == h).all() and (b == flags).all()
