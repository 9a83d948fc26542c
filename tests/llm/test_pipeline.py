from collections import Counter

import corpus_pipeline
from alertweave.llm import mixing

from . import util
from .test_decontamination import brute as contaminated
from .test_near_dedup import brute as duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = lambda df: [tuple(r) for r in df.select(*COLUMNS).collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    first = stage["quality"](spark, docs, sf_dir)
    assert first.columns == docs.columns
    kept = {r[0] for r in rows(first)}
    assert sum(d in kept for d, q in labels.items() if q) > 0.97 * sum(labels.values())
    assert sum(d in kept for d, q in labels.items() if not q) < 0.25 * (len(labels) - sum(labels.values()))

    first = util.docs(spark, before := rows(first))
    second = stage["near_duplicates"](spark, first, sf_dir)
    assert sorted(rows(second)) == sorted(r for r, (_, _, _, k) in zip(sorted(before, key=lambda r: str(r[0])), duplicates(before, 80)) if k)

    second = util.docs(spark, before := rows(second))
    third = stage["decontamination"](spark, second, sf_dir)
    dirty = {d for d, *_, c in contaminated([r[:2] for r in before], items) if c}
    assert dirty and sorted(rows(third)) == sorted(r for r in before if str(r[0]) not in dirty)

    third = util.docs(spark, before := rows(third))
    fourth = stage["mixing"](spark, third, sf_dir)
    taken = mixing.Mixture(third).taken().collect()
    got, pieces = Counter(), Counter()
    for d, t, *_ in rows(fourth):
        got[d] += len(t.split())
        pieces[d] += 1
    assert got == Counter({r.doc_id: r.taken for r in taken if r.taken})
    assert all((r.taken > 0) <= pieces[r.doc_id] <= 2 for r in taken)  # a row for each pass

    fifth = stage["sharding"](spark, fourth, sf_dir)
    assert Counter(r.doc_id for r in fifth.collect()) == Counter(r[0] for r in rows(fourth))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() > 50


def test_awkward_tables(spark, tmp_path):
    folder = util.saved(spark, tmp_path, labels=([(1, 1, 0), (9, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int"), benchmark=([("1", None)], "item_id string, text string"))
    clash = util.clashing(util.docs(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, folder)
        assert out.columns == clash.columns
        out.collect()
        assert stage(spark, util.docs(spark, []), folder).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, util.docs(spark, []), folder).collect() == []
    corpus_pipeline.run(spark, folder).collect()
