"""Bootstrap from counts against resampled rows; averaged SGD against a plain loop."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertweave.operators import evaluation, linear


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    s, y = scores[order], labels[order]
    _, at, n = np.unique(s, return_index=True, return_counts=True)
    pos = np.add.reduceat(y, at)
    neg = n - pos
    below = np.concatenate([[0], np.cumsum(neg)[:-1]])
    return (pos * (2 * below + neg)).sum() / (2 * pos.sum() * neg.sum())


def test_bootstrap_interval_is_that_of_resampled_rows(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(600) < 0.3).astype(int)
    s = np.round(rng.normal(y * 1.2, 1.0) * 10).astype(int)
    draws = [auc(s[i], y[i]) for i in (rng.integers(0, 600, 600) for _ in range(10_000))]
    low, high = np.percentile(draws, [2.5, 97.5])
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score int, y int")
    got = evaluation.bootstrap_auc(df, 400)
    row = got.first()
    # the error of a 2.5 percentile of 400 draws, from the draws themselves
    error = 5 * np.std([np.percentile(rng.choice(draws, 400), 2.5) for _ in range(300)])
    assert abs(row.low - low) < error and abs(row.high - high) < error
    assert evaluation.bootstrap_auc(df.repartition(7), 400).first() == row


def test_bootstrap_work_follows_distinct_scores(spark):
    """A million rows of 50 scores: rounds x scores x labels, not rows x rounds."""
    df = spark.range(1_000_000).select((F.col("id") % 50).alias("score"), (F.xxhash64("id") % 3 == 0).cast("int").alias("y"))
    c = evaluation.ranged(evaluation.by_score(df))
    assert c.count() == 50
    row = evaluation.bootstrap_auc(df, 100).first()
    exact = evaluation.roc_auc(df).first().auc
    assert row.low < exact < row.high and row.high - row.low < 0.01


def test_poisson_draws(spark):
    for mean in (0.5, 3.0, 20.0, 50.0, 400.0):
        x = np.array([r.x for r in spark.range(6000).select(evaluation.poisson(F.lit(mean), F.col("id")).alias("x")).collect()])
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / 6000) and abs(x.var() - mean) < 0.12 * mean
    x = [r.x for r in spark.range(20_000).select(evaluation.poisson(F.lit(1), F.col("id")).alias("x")).collect()]
    for k in range(5):
        p = math.exp(-1) / math.factorial(k)
        assert abs(x.count(k) / 20_000 - p) < 5 * math.sqrt(p / 20_000)


def test_auc_by_key_in_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(v), int(y)) for k, v, y in zip(rng.integers(0, 4, 5000), rng.integers(0, 900, 5000), rng.integers(0, 2, 5000))] + [(9, 1, 1)]
    got = {r.k: r for r in evaluation.roc_auc(spark.createDataFrame(rows, "k int, score int, y int"), "k").collect()}
    for k in range(4):
        s, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        assert got[k].auc == pytest.approx(auc(s, y), abs=1e-12)
    assert got[9].auc is None


def data(spark, n, seed=1, size=64):
    rng = random.Random(seed)
    true = [rng.gauss(0, 1.5) for _ in range(size)]
    rows = []
    for i in range(n):
        at = sorted(rng.sample(range(size), rng.randint(0, 9)))
        x = [rng.random() for _ in at]
        z = sum(true[a] * v for a, v in zip(at, x))
        rows.append((i, float(rng.random() < 1 / (1 + math.exp(-3 * z))), at, x))
    return rows, spark.createDataFrame(rows, "id bigint, label double, indices array<int>, values array<double>")


def plain_loop(rows, order, size, alpha, passes):
    """Averaged SGD on dense weights, a step a row."""
    w, b = np.zeros(size), 0.0
    total, b_total, t = np.zeros(size), 0.0, 0
    t0 = 1 / (math.sqrt(1 / math.sqrt(alpha)) * alpha)
    for _ in range(passes):
        for i in order:
            _, y, at, x = rows[i]
            eta = 1 / (alpha * (t0 + t))
            g = 1 / (1 + math.exp(-(sum(w[a] * v for a, v in zip(at, x)) + b))) - y
            w *= 1 - eta * alpha
            for a, v in zip(at, x):
                w[a] -= eta * g * v
            b -= eta * g
            total, b_total, t = total + w, b_total + b, t + 1
    return total / t, b_total / t


def test_one_stream_is_the_plain_algorithm(spark):
    rows, df = data(spark, 300)
    order = [r.id for r in df.select("id").orderBy(F.xxhash64(F.lit(42), F.lit(1), F.col("id").cast("string"))).collect()]
    for alpha in (1e-5, 1e-2):
        model = linear.averaged_sgd(df, "id", 64, alpha=alpha, passes=3, workers=1)
        w, b = plain_loop(rows, order, 64, alpha, 3)
        assert np.allclose(model.weights, w, rtol=1e-9, atol=1e-12) and math.isclose(model.bias, b, rel_tol=1e-9)


def test_one_stream_is_its_own_loop_bit_for_bit(spark):
    rows, df = data(spark, 300)
    order = [r.id for r in df.select("id").orderBy(F.xxhash64(F.lit(42), F.lit(1), F.col("id").cast("string"))).collect()]
    s = linear.Stream(np.zeros(64), 0.0, 1e-5, 0)
    for i in order:
        s.step(np.array(rows[i][2], np.int64), np.array(rows[i][3]), rows[i][1])
    model = linear.averaged_sgd(df, "id", 64, passes=1, workers=1)
    assert (model.weights == s.sums() / s.rows).all() and model.bias == s.bias_sum / s.rows


def test_many_streams_are_as_good_and_reruns_agree(spark):
    _, df = data(spark, 6000)
    train, test = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    one, many = (linear.averaged_sgd(train, "id", 64, workers=k) for k in (1, 16))
    of = lambda m: evaluation.roc_auc(m.scored(test).select("score", F.col("label").cast("int").alias("y"))).first().auc
    a, b = of(one), of(many)
    print("auc", a, b)
    assert a > 0.7 and abs(a - b) < 0.005
    again = linear.averaged_sgd(train.repartition(5), "id", 64, workers=16)
    assert (again.weights == many.weights).all() and again.bias == many.bias


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 1.0, [0], [1.0]), (2, 0.0, None, None), (3, None, [1], [1.0]), (None, 0.0, [], []), (1, 1.0, [0], [1.0])], "id bigint, label double, indices array<int>, values array<double>")
    model = linear.averaged_sgd(df, "id", 4, workers=2)
    assert model.weights[0] > 0 and model.weights[1] == 0 and len(model.scored(df).collect()) == 5
    assert [r.score for r in linear.averaged_sgd(df.limit(0), "id", 4).scored(df).collect()] == [0.5] * 5
    with pytest.raises(ValueError):
        linear.averaged_sgd(df, "id", 1 << 25)


def test_forward_scores_by_sgd(spark):
    _, df = data(spark, 600)
    folds = evaluation.forward_folds(df, ["id"])
    got = {r.id: r.score for r in evaluation.forward_scores(folds, 5, evaluation.sgd("id", 64, workers=2)).collect()}
    fold = folds.filter("fold = 3").select("id").collect()
    own = {r.id: r.score for r in linear.averaged_sgd(folds.filter("fold < 3"), "id", 64, workers=2).scored(folds.filter("fold = 3")).collect()}
    assert len(own) == len(fold) and all(got[i] == s for i, s in own.items())


def test_forward_scores_read_their_input_once(spark):
    """Twice the folds read the rows, so these are stored; the fit's passes read dealt rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    df = data(spark, 60)[1].withColumn("fold", (F.col("id") % 4).cast("int"))
    counted = df.mapInPandas(count, df.schema)
    assert evaluation.forward_scores(counted, 3, evaluation.sgd("id", 64, workers=2, passes=2)).count() == 45
    assert seen.value == 60
