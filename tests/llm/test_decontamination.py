import re

from alertweave.llm.decontamination import contamination, items_digest, judged

from . import util

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def lower(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for name, text in items:
        ws = lower(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + size]), set()).add(name)
    out = []
    for d, text in docs:
        ws, hit, names = lower(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((str(d), len(ws), len(hit), len(names), items_digest([str(x) for x in names]), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_documents(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[5] for r in want)
    assert rows(judged(contamination(docs, bench))) == want
    assert rows(judged(contamination(docs, bench, block_bytes=3000))) == want


def test_awkward_rows(spark):
    items = [("7", "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions near"), ("8", "Two, words!"), ("9", None), ("10", ""), ("7", "naïve"), (None, "row without"), ("11", "word0 tail0")]
    bench = util.clashing(spark.createDataFrame(items, "item_id string, text string"))
    docs = util.doc_rows()
    want = brute([(d, t) for d, t, *_ in docs], [("null" if i is None else i, t) for i, t in items])
    assert rows(judged(contamination(util.clashing(util.docs(spark)), bench))) == want
    none = spark.createDataFrame([], "item_id string, text string")
    assert {r.n_hit for r in judged(contamination(util.docs(spark), none)).collect()} == {0}
    assert contamination(util.docs(spark, []), bench).collect() == []
