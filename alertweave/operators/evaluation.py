"""Thresholds and evaluation of scored alerts.

Frames have y (1 for what must not be missed) and a numeric score. Curves first group by
distinct score; continuous scores have one for each alert, so running totals and quantiles
are taken in ranges (``ordered``), never by one window over all."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import upper_bound
from ..storage import written
from .linear import averaged_sgd
from .ordered import quantiles, running, split_at


def by_score(df: DataFrame, *keys: str) -> DataFrame:
    """n and p (positives) of each distinct score."""
    return df.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("p"))


def curve(df: DataFrame, descending: bool = False) -> DataFrame:
    """by_score with lane and hits: rows and positives up to each score; lane_all, hits_all."""
    return running(written(by_score(df), "scores"), F.col("score"), {"lane": F.col("n"), "hits": F.col("p")}, descending)


def time_split(df: DataFrame, time: str, share: float = 0.7) -> DataFrame:
    """train up to the exact quantile of time, ties included; test after it."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    cut = quantiles(df.select(t.alias("t")), "t", [share]).select(F.get("q", F.lit(0)).alias("__cut"))
    return df.join(F.broadcast(cut)).withColumn("split", F.when(t <= F.col("__cut"), "train").otherwise("test")).drop("__cut")


def forward_folds(df: DataFrame, order: Sequence[str], folds: int = 5) -> DataFrame:
    """fold 0 to ``folds``, for ``forward_scores``: later blocks are judged by earlier ones. Rank
    edges come from distinct values of the order's first column, so rows aren't ranked."""
    first = order[0]
    kind = df.schema[first].dataType.typeName()
    at = F.unix_micros(F.col(first).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(first)
    c = running(written(df.groupBy(first).agg(F.count("*").alias("c")), "counts"), at, {"before": F.col("c")}, before=True).withColumnRenamed("before_all", "total")
    within = F.row_number().over(W.partitionBy(first).orderBy(*(order[1:] or order))) - 1
    out = df.join(c, first).withColumn("__r", F.col("before") + within)
    return out.withColumn("fold", F.floor(F.col("__r") * (folds + 1) / F.col("total")).cast("int")).drop("__r", "c", "before", "total")


#: Fits a model on rows and returns what adds a column ``score`` to others.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def logistic(features: str = "features", label: str = "label", iterations: int = 20, penalty: float = 0.01) -> Fit:
    """The library's logistic regression, by L-BFGS."""

    def fit(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import vector_to_array

        model = LogisticRegression(featuresCol=features, labelCol=label, maxIter=iterations, regParam=penalty).fit(rows)
        return lambda df: model.transform(df).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")

    return fit


def sgd(id_col: str, size: int, **options) -> Fit:
    """Averaged stochastic gradient (``linear``)."""
    return lambda rows: averaged_sgd(rows, id_col, size, **options).scored


def forward_scores(df: DataFrame, folds: int, fit: Fit | None = None, label: str = "label") -> DataFrame:
    """``df`` (fold, label, features) of the folds from 1 on, each with the score of a linear
    model that was fitted on all earlier folds; a fold whose predecessors have one class only
    has null scores. Models are fitted one after another, their rows never leave the cluster.
    ``df`` is stored once, as every fit and every fold reads it."""
    fit = fit or logistic(label=label)
    df = written(df, "folds")
    classes = {r.fold: (r.a, r.b) for r in df.groupBy("fold").agg(F.min(label).alias("a"), F.max(label).alias("b")).collect()}
    out = None
    for k in range(1, folds + 1):
        fold, seen = df.filter(F.col("fold") == k), [c for f, c in classes.items() if f < k]
        if seen and min(a for a, _ in seen) < max(b for _, b in seen):
            part = fit(df.filter(F.col("fold") < k))(fold)
        else:
            part = fold.withColumn("score", F.lit(None).cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def miss_budget(df: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """For each budget: the widest lane of lowest scores with no more positives, and the
    score that ends it (included)."""
    c = curve(df).withColumnsRenamed({"hits": "misses", "lane_all": "total"})
    b = df.sparkSession.createDataFrame([(int(x),) for x in budgets], "budget int")
    j = c.join(F.broadcast(b), F.col("misses") <= F.col("budget"))
    return j.groupBy("budget").agg(F.max("lane").alias("lane"), F.max("score").alias("score"), F.max("total").alias("total"))


def certified_cut(df: DataFrame, tolerance: float, confidence: float = 0.95) -> DataFrame:
    """The widest lane whose Clopper-Pearson bound on the miss rate is within tolerance. Of
    lanes with equally many misses the widest has the least bound, and no bound is below the
    rate itself, so only such lanes have theirs computed."""
    c = curve(df).withColumnRenamed("hits", "misses").filter(F.col("misses") <= tolerance * F.col("lane"))
    c = c.groupBy("misses").agg(F.max(F.struct("lane", "score")).alias("x")).select("x.lane", "x.score", "misses")
    c = c.withColumn("bound", upper_bound(confidence)("misses", "lane")).filter(F.col("bound") <= tolerance)
    return c.agg(F.max(F.struct("lane", "score", "misses", "bound")).alias("x")).select("x.*")


def calibration_windows(df: DataFrame, time: str, weeks: int) -> DataFrame:
    """part: the last ``weeks`` validate, those before calibrate, the rest trains."""
    last = df.agg(F.max(time).alias("__last"))
    age = F.datediff("__last", time)
    return df.join(F.broadcast(last)).withColumn("part", F.when(age < 7 * weeks, "validate").when(age < 14 * weeks, "calibrate").otherwise("train")).drop("__last")


def threshold_sweep(df: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """For each threshold: the lane below it, its misses, and the rates."""
    t = df.sparkSession.createDataFrame([(int(x),) for x in thresholds], "threshold int")
    j = by_score(df).join(F.broadcast(t), F.col("score") < F.col("threshold"))
    a = j.groupBy("threshold").agg(F.sum("n").alias("lane"), F.sum("p").alias("misses"))
    return t.join(a, "threshold", "left").select("threshold", F.coalesce("lane", F.lit(0)).alias("lane"), F.coalesce("misses", F.lit(0)).alias("misses"))


def score_bands(df: DataFrame, width: int) -> DataFrame:
    """Right-open bands with cumulative counts."""
    b = df.groupBy((F.floor(F.col("score") / width) * width).alias("band")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("p"))
    w = W.orderBy("band").rowsBetween(W.unboundedPreceding, 0)
    return b.withColumns({"cum_n": F.sum("n").over(w), "cum_p": F.sum("p").over(w)})


def reliability(df: DataFrame, bins: int, least: int, scale: float) -> DataFrame:
    """Bins of equal counts by exact quantile edges: mean score against the rate."""
    edges = quantiles(df, "score", [i / bins for i in range(1, bins)]).withColumnRenamed("q", "e")
    b = F.size(F.filter("e", lambda e: e < F.col("score")))
    a = df.join(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), (F.sum("score") / F.count("*") / scale).alias("mean_score"), F.avg("y").alias("rate"))
    return a.filter(F.col("n") >= least)


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


#: Ranges of scores within a key, so that no task gets all scores of one.
SCORE_RANGES = 64


def ranged(c: DataFrame, ranges: int = SCORE_RANGES) -> DataFrame:
    """``c`` (score, ...), stored, with ``__range``: splitters from a sketch of the scores."""
    c = written(c, "scores")
    x = F.col("score").cast("double")
    edges = c.agg(F.percentile_approx(x, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("__edges"))
    return c.join(F.broadcast(edges)).withColumn("__range", split_at(x, F.col("__edges"), ranges)).drop("__edges")


def pair_counts(c: DataFrame, *keys: str) -> DataFrame:
    """keys, wins (twice the pairs in which a positive outscores a negative, ties once), pos
    and neg. c: keys, __range, score, p, neg, one row for each score. A range is summed up by
    itself, and what is below it is carried to it, a row for each key and range."""
    w = W.partitionBy(*keys, "__range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    each = c.groupBy(*keys, "__range").agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("neg"))).alias("wins"), F.sum("p").alias("pos"), F.sum("neg").alias("neg"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("carry", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    return each.groupBy(*keys).agg(F.sum(F.col("wins") + 2 * F.col("pos") * F.col("carry")).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def roc_auc(df: DataFrame, *keys: str) -> DataFrame:
    """Chance that a positive outscores a negative, ties for a half. All in whole numbers
    until the last division."""
    c = ranged(by_score(df, *keys)).withColumn("neg", F.col("n") - F.col("p"))
    a = pair_counts(c, *keys)
    return a.select(*keys, "pos", "neg", (F.col("wins") / (2 * F.nullif(F.col("pos") * F.col("neg"), F.lit(0)))).alias("auc"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Step-wise average precision over distinct scores."""
    c = curve(df, descending=True)
    return c.agg(F.sum(F.col("p") / F.col("hits_all") * F.col("hits") / F.col("lane")).alias("ap"))


def ks(df: DataFrame) -> DataFrame:
    c = curve(df)
    cp, cq = F.col("hits") / F.col("hits_all"), (F.col("lane") - F.col("hits")) / (F.col("lane_all") - F.col("hits_all"))
    return c.agg(F.max(F.abs(cp - cq)).alias("ks"))


def losses(df: DataFrame, probability: Column, least: float = 1e-15) -> DataFrame:
    """One row: n, base_rate, auc, gini, brier and log_loss of scores that are ordered as
    ``probability`` is; probabilities are kept ``least`` away from 0 and 1."""
    p = F.greatest(F.least(probability, F.lit(1 - least)), F.lit(least))
    y = F.col("y").cast("double")
    one = df.agg(F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg((probability - y) * (probability - y)).alias("brier"), (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    return one.join(F.broadcast(roc_auc(df).select("auc"))).select("n", "base_rate", "auc", (2 * F.col("auc") - 1).alias("gini"), "brier", "log_loss")


def poisson(mean: Column, *keys: Column) -> Column:
    """A Poisson draw that the keys choose: by inversion for a mean below 32, else from a
    normal variate."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    u, m = uniform(1), mean.cast("double")

    def step(a: Column, k: Column) -> Column:
        chance = a["chance"] * m / k
        more = a["sum"] < u
        return F.struct(F.when(more, k).otherwise(a["n"]).alias("n"), chance.alias("chance"), F.when(more, a["sum"] + chance).otherwise(a["sum"]).alias("sum"))

    none = F.exp(-m)
    few = F.aggregate(F.sequence(F.lit(1), F.when(m < 2, 20).when(m < 8, 40).otherwise(96)), F.struct(F.lit(0).alias("n"), none.alias("chance"), none.alias("sum")), step)["n"]
    normal = F.round(m + F.sqrt(m) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(2)))
    return F.when(m <= 0, 0).when(m < 32, few).otherwise(F.greatest(normal, F.lit(0.0))).cast("long")


def bootstrap_auc(df: DataFrame, rounds: int = 400, seed: int = 7) -> DataFrame:
    """2.5 and 97.5 percentiles of the AUC over Poisson resamples: every row is taken a
    Poisson number of times with mean one, so all rows of a score and label together are with
    their count as the mean, and one draw is made for each score, label and round. Draws come
    from hashes, so reruns agree. Resamples of one label have no AUC and don't count."""
    c = ranged(by_score(df)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    draw = lambda n, label: poisson(n, F.col("score"), F.lit(label), F.col("round"), F.lit(seed))
    # under other names than those drawn from, which a lambda would take for the new columns
    drawn = c.select("round", "__range", "score", draw(F.col("p"), 1).alias("drawn_p"), draw(F.col("n") - F.col("p"), 0).alias("drawn_n"))
    a = pair_counts(drawn.withColumnsRenamed({"drawn_p": "p", "drawn_n": "neg"}), "round").select((F.col("wins") / (2 * F.nullif(F.col("pos") * F.col("neg"), F.lit(0)))).alias("auc"))
    return a.agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def confusion(df: DataFrame, threshold: int) -> DataFrame:
    at, pos = F.col("score") >= threshold, F.col("y") == 1
    return df.agg(F.count_if(at & pos).alias("tp"), F.count_if(at & ~pos).alias("fp"), F.count_if(~at & pos).alias("fn"), F.count_if(~at & ~pos).alias("tn"))


def decision_metrics(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(
        "tp", "fp", "fn", "tn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(tn, tn + fp).alias("specificity"), div(tn, tn + fn).alias("npv"),
        div(fn, fn + tp).alias("fnr"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced"),
        div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), div((tp + tn) / n - chance, 1 - chance).alias("kappa"),
    )


def metric_sweep(df: DataFrame, grid: int) -> DataFrame:
    """f1 at ``grid`` quantile thresholds; the grid joins cumulative counts by score."""
    edges = quantiles(df, "score", [i / grid for i in range(grid)]).select(F.explode(F.array_distinct("q")).alias("threshold"))
    t = df.agg(F.sum(F.col("y").cast("long")).alias("pos"))
    j = by_score(df).join(F.broadcast(edges), F.col("score") >= F.col("threshold")).groupBy("threshold").agg(F.sum("n").alias("k"), F.sum("p").alias("tp")).join(F.broadcast(t))
    return j.select("threshold", (2 * F.col("tp") / (F.col("k") + F.col("pos"))).alias("f1"))


def metric_grid(df: DataFrame, grid: int = 600) -> DataFrame:
    """Metrics at the distinct ones of ``grid`` quantiles from 0.0005 to 0.9995, and which
    threshold has the best f1 and the best mcc, the lowest of equals."""
    at = [0.0005 + 0.999 * i / (grid - 1) for i in range(grid)]
    counts = written(by_score(df), "scores")
    edges = quantiles(counts, "score", at, F.col("n")).select(F.explode(F.array_distinct(F.transform("q", lambda v: F.round(v, 9)))).alias("score"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"), F.lit(True).alias("edge"))
    both = counts.select(F.col("score").cast("double").alias("score"), "n", "p", F.lit(False).alias("edge")).unionByName(edges)
    both = written(both.groupBy("score").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("edge").alias("edge")), "grid")
    c = running(both, F.col("score"), {"k": F.col("n"), "tp": F.col("p")}, descending=True).filter("edge").withColumnsRenamed({"k_all": "total", "tp_all": "pos"})
    k, tp, total, pos = (F.col(x).cast("double") for x in ("k", "tp", "total", "pos"))
    div = lambda a, b, none: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(none))
    fp, fn, tn = k - tp, pos - tp, total - pos - k + tp
    recall, specificity = div(tp, pos, 0.0), div(tn, total - pos, 0.0)
    m = c.select(
        F.col("score").alias("threshold"), div(tp, k, 1.0).alias("precision"), recall.alias("recall"), specificity.alias("specificity"), div(2 * tp, k + pos, 0.0).alias("f1"),
        ((tp + tn) / total).alias("accuracy"), ((recall + specificity) / 2).alias("balanced"), div(tp * tn - fp * fn, F.sqrt(k * pos * (total - pos) * (total - k)), 0.0).alias("mcc"),
    )
    rank = lambda x: F.struct(F.round(x, 9), -F.col("threshold"))
    best = lambda x: (F.max(rank(x)).over(W.partitionBy()) == rank(x)).alias(f"best_{x}")
    return m.select("*", best("f1"), best("mcc"))


def gain_lift(df: DataFrame) -> DataFrame:
    """From the highest score down: share of alerts, share of positives, and lift."""
    g = curve(df, descending=True).select("score", (F.col("lane") / F.col("lane_all")).alias("share"), (F.col("hits") / F.col("hits_all")).alias("gain"))
    return g.select("score", "share", "gain", (F.col("gain") / F.col("share")).alias("lift"))


def lane_purity(df: DataFrame) -> DataFrame:
    """From the lowest score up: the lane's share and how much of it is negative."""
    return curve(df).select("score", (F.col("lane") / F.col("lane_all")).alias("share"), (1 - F.col("hits") / F.col("lane")).alias("purity"))


def score_band(p: Column) -> Column:
    """Confidence by distance from an even chance."""
    far = F.abs(p - 0.5)
    return F.when(far >= 0.4, "very high").when(far >= 0.3, "high").when(far >= 0.15, "medium").otherwise("low")


def route(score: Column, scorable: Column, threshold: float) -> Column:
    """What can't be scored goes to a person."""
    return F.when(~scorable | score.isNull(), "human_lane").when(score < threshold, "auto_lane").otherwise("human_lane")
