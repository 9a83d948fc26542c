import random
import re
from collections import defaultdict

import numpy as np

from alertweave.llm import near_dedup

from . import util

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(docs, percent=85):
    sets = [shingles(t) for _, t, *_ in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted((str(d), len(sets[i]), str(c := least.get(find(i))), d == c) for i, (d, *_) in enumerate(docs))


def rows(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute(docs)
    assert sum(not r[3] for r in want) > 20
    assert rows(near_dedup.components(util.docs(spark, docs), percent=85)) == want


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def family(rng, size=150, base=120):
    """Copies of one text with one to five edits, chains of drifting copies, texts that share
    a passage, and exact copies."""
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    centre, out = words(base), []
    out += [edited(centre, rng, rng.randint(1, 5)) for _ in range(size)]
    drift = words(base)
    for _ in range(size // 3):
        drift = edited(drift, rng, 1).split()
        out.append(" ".join(drift))
    shared = words(70)
    out += [" ".join(shared + words(rng.randint(10, 60))) for _ in range(size)]
    out += [" ".join(words(40))] * size
    rng.shuffle(out)
    return out


def test_large_groups(spark):
    rng = random.Random(11)
    docs = [(i, t, "en", "a", 1) for i, t in enumerate(family(rng))]
    got = rows(near_dedup.components(util.docs(spark, docs).repartition(6), percent=85))
    assert got == brute(docs)


def test_hot_buckets_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = [(i, t, "en", "a", 1) for i, t in enumerate(family(rng, 60))]
    assert rows(near_dedup.components(util.docs(spark, docs), percent=85)) == brute(docs)


def test_awkward_rows(spark):
    docs = util.doc_rows() + [(30, "Two Words", "en", "a", 1), (31, "a b c d e f", "en", "a", 1), (32, "A B c d e f", "en", "a", 1)]
    assert rows(near_dedup.components(util.clashing(util.docs(spark, docs)), percent=85)) == brute(docs)
    assert near_dedup.components(util.docs(spark, [])).collect() == []
    kept = near_dedup.deduplicated(util.clashing(util.docs(spark, docs)))
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted({d for d, _, _, k in brute(docs, 80) if k})


def test_pruning_keeps_links_and_drops_strangers():
    least = near_dedup.least_matches(0.85, 1e-6)
    assert (np.diff(least) > 0).all() and least[0] < 27 and least[-1] > 250


def test_null_and_repeated_ids_stay_linear(spark, monkeypatch):
    """Rows of null doc_id, and many texts under one doc_id, are rows each; a class's text is
    fetched by its own row, not by doc_id."""
    sent = []
    whole = near_dedup.common.written
    monkeypatch.setattr(near_dedup.common, "written", lambda df, name: (sent.append((name, out := whole(df, name))), out)[1])
    rng = random.Random(31)
    base = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(400)]
    texts = [edited(b.split(), rng, rng.randint(0, 2)) for b in base for _ in range(2)]
    docs = [(None, t, "en", "a", 1) for t in texts] + [(7, t.upper() + " tail", "en", "b", 1) for t in texts] + [(1000 + i, t, "en", "c", 1) for i, t in enumerate(texts[:200])]
    rng.shuffle(docs)
    assert rows(near_dedup.components(util.docs(spark, docs), percent=85)) == brute(docs, 85)
    assert max(df.count() for name, df in sent if name == "near-sets") <= len(docs)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(32)
    base = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(40)]
    docs = [(None if i % 3 else 5, edited(base[i % 40].split(), rng, i % 2), "en", "ab"[i % 2], 1) for i in range(240)]
    docs += [(9, base[0], "en", "a", 1)] * 50 + [(None, None, "en", "a", 1)] * 3 + [(2, "", "en", "a", 1)] * 2
    out = near_dedup.deduplicated(util.docs(spark, docs)).collect()
    bare = [r for r in out if not WORD.search(r.text or "")]
    assert len(bare) == 5
    left = [tuple(r) for r in out if WORD.search(r.text or "")]
    fake = [(i, *r[1:]) for i, r in enumerate(r for r in docs if WORD.search(r[1] or ""))]
    assert len(left) == sum(k for *_, k in brute(fake, 80))  # as many as components
    assert sum(k for *_, k in brute([(i, *r[1:]) for i, r in enumerate(left)], 80)) == len(left)
    again = near_dedup.deduplicated(util.docs(spark, docs[::-1]).repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_rounds_of_components_are_few(spark, monkeypatch):
    """A path in the order of its numbers, a star, a grid and a tree, all at once."""
    rounds = []
    whole = near_dedup.common.written
    monkeypatch.setattr(near_dedup.common, "written", lambda df, name: (rounds.append(name), whole(df, name))[1])
    path = [(i, i + 1) for i in range(199)]
    star = [(1000, 1001 + i) for i in range(300)]
    grid = [(2000 + 20 * i + j, 2000 + 20 * i + j + d) for i in range(20) for j in range(20) for d in (1, 20) if (d == 20 or j < 19) and (d == 1 or i < 19)]
    tree = [(3000 + i // 2, 3000 + i) for i in range(2, 200)]
    got = {r.nid: r.label for r in near_dedup.labels_of(spark.createDataFrame(path + star + grid + tree, "a bigint, b bigint")).collect()}
    groups = defaultdict(set)
    for n, label in got.items():
        groups[label].add(n)
    want = [set(range(200)), {1000, *range(1001, 1301)}, set(range(2000, 2400)), set(range(3001, 3200))]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert rounds.count("near-edges") < 12, rounds.count("near-edges")


def test_only_texts_that_pairs_name_are_sent(spark, monkeypatch):
    """Of many unlike texts and a few alike, hardly any others leave the scan."""
    sent = []
    whole = near_dedup.common.among
    monkeypatch.setattr(near_dedup.common, "among", lambda df, c, hashes: (sent.append(out := whole(df, c, hashes)), out)[1])
    rng = random.Random(33)
    texts = [" ".join(f"u{i}x{k}" for k in range(30)) for i in range(2000)] + [edited([f"v{k}" for k in range(60)], rng, 1) for _ in range(20)]
    docs = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    assert rows(near_dedup.components(util.docs(spark, docs), percent=85)) == brute(docs)
    assert sent and max(df.count() for df in sent) < 40
