import zlib

import numpy as np

from alertweave.llm import quality_model

from . import util


def test_encoding_of_passages():
    x, n = quality_model.encode([b"", None, b"a b", b" ".join([b"word"] * 130), "ÉÉ !! 12".encode()])
    assert list(n) == [1, 1, 1, 3, 1] and x.shape == (7, quality_model.FEATURES)
    assert np.isfinite(x).all() and x[0, len(quality_model.CLASSES)] == 1
    alone = np.concatenate([quality_model.encode([t])[0] for t in (b"", None, b"a b", b" ".join([b"word"] * 130), "ÉÉ !! 12".encode())])
    assert np.allclose(x, alone, atol=1e-6)


def test_gradient():
    rng = np.random.Generator(np.random.PCG64(2))
    x, counts = rng.normal(size=(40, 5)), np.array([4] * 10)
    y = (np.add.reduceat(x[:, 0], np.arange(0, 40, 4)) > 0).astype(float)
    model = quality_model.Attention.fit(x, counts, y)
    assert ((model.score(x, counts) > 0.5) == y).mean() >= 0.9


def naive_score(model, passages):
    """One bag's score, number by number."""
    import math

    w, sig = model.w, lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    hs, es = [], []
    for x in passages:
        z = [max(-8, min(8, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        h = [math.tanh(sum(zi * w["W"][i][k] for i, zi in enumerate(z)) + w["b"][k]) for k in range(w["W"].shape[1])]
        gate = range(w["V"].shape[1])
        v = [math.tanh(sum(hk * w["V"][k][g] for k, hk in enumerate(h))) for g in gate]
        u = [sig(sum(hk * w["U"][k][g] for k, hk in enumerate(h))) for g in gate]
        hs.append(h)
        es.append(math.exp(sum(v[g] * u[g] * w["w"][g] for g in gate)))
    pooled = [sum(e * h[k] for e, h in zip(es, hs)) / sum(es) for k in range(len(hs[0]))]
    return sig(sum(p * c for p, c in zip(pooled, w["c"])) + float(w["c0"]))


def test_every_score_against_a_naive_pass(spark, sf_dir):
    """The whole table, each document alone, from its features to its score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fitted(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.scored(docs, model).collect()}
    for r in docs.collect():
        x, _ = quality_model.encode([r.text.encode() if r.text else None])
        assert abs(got[r.doc_id] - naive_score(model, x.tolist())) < 1e-6


def naive_features(text):
    """Passages of 64 words: what encode() says of each, word by word."""
    import re

    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", text))
    out = []
    for at in range(0, len(words), quality_model.PASSAGE):
        own = words[at : at + quality_model.PASSAGE]
        stop = words[at + len(own)].start() if at + len(own) < len(words) else len(text) + 1
        raw = (text + b" ")[own[0].start() : stop]
        said = [m[0] for m in own]
        size = [len(w) for w in said]
        mean = sum(size) / len(size)
        sd = max(0.0, sum(s * s for s in size) / len(size) - mean * mean) ** 0.5
        shares = [sum(bool(c[b]) for b in raw) / len(raw) for c in quality_model.CLASSES]
        # a run of words goes on over the words just before it in the same passage
        same = sum(a == b for a, b in zip(said, said[1:]))
        out.append([*shares, 0, np.log1p(mean), sd / mean, same / len(said), len(set(said)) / len(said), len(said) / quality_model.PASSAGE])
    return out


def test_features_against_a_naive_count(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if r.text and r.text.split():
            x, _ = quality_model.encode([r.text.encode()])
            assert np.allclose(x[:, : len(quality_model.CLASSES) + 6], naive_features(r.text.encode()), atol=1e-4), r.doc_id


def test_gradient_against_differences():
    rng = np.random.Generator(np.random.PCG64(5))
    x, counts, y = rng.normal(size=(23, 6)), np.array([4, 1, 6, 2, 7, 3]), np.array([1.0, 0, 1, 0, 0, 1])
    model = quality_model.Attention.fit(x, counts, y)
    model.w = {k: np.array(v) for k, v in model.w.items()}
    grad = model.gradient(model.forward(x, counts), y)
    loss = lambda: -np.mean(y * np.log(p := model.score(x, counts)) + (1 - y) * np.log(1 - p))
    for k, w in model.w.items():
        flat = w.reshape(-1)
        for i in range(len(flat)):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - np.asarray(grad[k]).reshape(-1)[i]) < 1e-6, (k, i)


def test_repeated_ids_learn_from_one_text(spark):
    rows = [(i, f"good words number {i} here", "en", "a", 1) for i in range(30)] + [(i, f"### {i} $$$ bad", "en", "a", 1) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    fit = lambda r, n: quality_model.fitted(util.docs(spark, r).repartition(n), labels).w["W"]
    assert np.array_equal(fit(rows, 3), fit(rows[::-1], 5))
    assert list(quality_model.spread(3, 64)) == [0, 1, 2] and list(quality_model.spread(10, 5)) == [0, 2, 4, 6, 8]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.scored(docs, quality_model.fitted(docs, labels, sample=1500)).withColumn("held", quality_model.held_out()).join(labels, "doc_id").filter("held").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s >= 0.7 for s in bad]) < 0.1


def test_awkward_rows(spark):
    labels = util.clashing(spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (8, 0, 1), (9, 0, 1), (10, 0, 0), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").drop("size"))
    docs = util.clashing(util.docs(spark))
    got = quality_model.scored(docs, quality_model.fitted(docs, labels)).collect()
    assert len(got) == len(util.doc_rows()) and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality_model.scored(docs, quality_model.fitted(docs, none)).collect()} == {0.5}
    assert quality_model.scored(util.docs(spark, []), quality_model.fitted(docs, labels)).collect() == []
