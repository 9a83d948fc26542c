"""Thresholds and evaluation over the scores view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..sources.views import containers, scores, with_views
from ..storage import written
from .registry import query


def on(body: str) -> str:
    return with_views("scores", body)


G = ", g AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM scores GROUP BY score)"
UP = "(ORDER BY score ROWS UNBOUNDED PRECEDING)"
DOWN = "(ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
LANE = G + f", c AS (SELECT score, CAST(sum(n) OVER {UP} AS BIGINT) AS lane, CAST(sum(p) OVER {UP} AS BIGINT) AS misses, CAST(sum(n) OVER () AS BIGINT) AS total FROM g)"


@query(with_views("containers", ", q AS (SELECT quantile_cont(epoch_us(t), 0.7) AS cut FROM containers) SELECT container_id, CASE WHEN epoch_us(t) <= cut THEN 'train' ELSE 'test' END AS split FROM containers, q"))
def time_split(spark, d):
    return E.time_split(containers(spark, d), "t").select("container_id", "split")


@query(with_views("containers", ", r AS (SELECT container_id, row_number() OVER (ORDER BY t, container_id) - 1 AS r, count(*) OVER () AS n FROM containers) SELECT container_id, CAST(floor(r * 6 / n) AS INTEGER) AS fold FROM r"))
def forward_folds(spark, d):
    return E.forward_folds(containers(spark, d), ["t", "container_id"]).select("container_id", "fold")


@query(on(LANE + " SELECT budget, max(lane) AS lane, max(score) AS score, max(total) AS total FROM c JOIN (VALUES (0), (1), (2), (5), (10), (20), (50)) b(budget) ON misses <= budget GROUP BY budget"))
def miss_budget(spark, d):
    return E.miss_budget(scores(spark, d), [0, 1, 2, 5, 10, 20, 50])


def tail_sql(m: str, n: str, p: str) -> str:
    """The chance of at most m of n at rate p, summed up."""
    return f"list_sum(list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) + k * ln({p}) + ({n} - k) * ln(1 - {p}))))"


@query(on(LANE + f""", w AS (SELECT lane, score, misses FROM c WHERE misses < lane AND {tail_sql("misses", "lane", "0.08::DOUBLE")} <= 0.05 ORDER BY lane DESC LIMIT 1),
h AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
 SELECT i + 1, CASE WHEN t > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN t > 0.05 THEN high ELSE (low + high) / 2 END FROM (SELECT h.*, {tail_sql("w.misses", "w.lane", "((low + high) / 2)")} AS t FROM h, w WHERE i < 60))
SELECT lane, score, misses, round((low + high) / 2, 7) AS bound FROM (SELECT 1) LEFT JOIN w ON true LEFT JOIN h ON i = 60""").replace("WITH ", "WITH RECURSIVE ", 1))
def clopper_pearson_cut(spark, d):
    return E.certified_cut(scores(spark, d), 0.08).withColumn("bound", F.round("bound", 7))


@query(with_views("containers", ", l AS (SELECT max(t) AS last FROM containers) SELECT CASE WHEN date_diff('day', t, last) < 56 THEN 'validate' WHEN date_diff('day', t, last) < 112 THEN 'calibrate' ELSE 'train' END AS part, count(*) AS n FROM containers, l GROUP BY 1"))
def calibration_windows(spark, d):
    return E.calibration_windows(containers(spark, d), "t", 8).groupBy("part").agg(F.count("*").alias("n"))


@query(on("SELECT CAST(t AS INTEGER) AS threshold, count(score) AS lane, CAST(coalesce(sum(y), 0) AS BIGINT) AS misses FROM range(0, 1001, 50) r(t) LEFT JOIN scores ON score < t GROUP BY t"))
def threshold_sweep(spark, d):
    return E.threshold_sweep(scores(spark, d), range(0, 1001, 50))


@query(on(", b AS (SELECT score // 100 * 100 AS band, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM scores GROUP BY 1) SELECT band, n, p, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(p) OVER w AS BIGINT) AS cum_p FROM b WINDOW w AS (ORDER BY band)"))
def score_bands(spark, d):
    return E.score_bands(scores(spark, d), 100)


@query(on("SELECT month, count(*) AS n, count(*) FILTER (score < 300) AS lane, count(*) FILTER (score < 300 AND y = 1) AS misses FROM scores GROUP BY month"))
def period_check(spark, d):
    low = F.col("score") < 300
    return scores(spark, d).groupBy("month").agg(F.count("*").alias("n"), F.count_if(low).alias("lane"), F.count_if(low & (F.col("y") == 1)).alias("misses"))


BINS = ", e AS (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS e FROM scores), b AS (SELECT CAST((score > e[1])::INT + (score > e[2])::INT + (score > e[3])::INT AS INTEGER) AS bin, score, y FROM scores, e), r AS (SELECT bin, count(*) AS n, sum(score) / count(*) / 1000.0 AS mean_score, avg(y) AS rate FROM b GROUP BY bin HAVING count(*) >= 5)"


@query(on(BINS + " SELECT bin, n, round(mean_score, 9) AS mean_score, rate FROM r"))
def reliability(spark, d):
    return E.reliability(scores(spark, d), 4, 5, 1000.0).select("bin", "n", F.round("mean_score", 9).alias("mean_score"), "rate")


@query(on(BINS + " SELECT round(sum(n * abs(mean_score - rate)) / sum(n), 9) AS ece FROM r"))
def ece(spark, d):
    return E.ece(E.reliability(scores(spark, d), 4, 5, 1000.0)).select(F.round("ece", 9).alias("ece"))


BINS_12 = f", e AS (SELECT quantile_cont(score, {[i / 12 for i in range(1, 12)]}) AS e FROM scores), b AS (SELECT CAST(len(list_filter(e, lambda x: x < score)) AS INTEGER) AS bin, score, y FROM scores, e), r AS (SELECT bin, count(*) AS n, sum(score) / count(*) / 1000.0 AS mean_score, avg(y) AS rate FROM b GROUP BY bin HAVING count(*) >= 20)"


@query(on(BINS_12 + " SELECT bin, n, round(mean_score, 9) AS mean_score, rate FROM r"))
def reliability_12(spark, d):
    return E.reliability(scores(spark, d), 12, 20, 1000.0).select("bin", "n", F.round("mean_score", 9).alias("mean_score"), "rate")


@query(on(BINS_12 + " SELECT round(sum(n * abs(mean_score - rate)) / sum(n), 9) AS ece FROM r"))
def ece_12(spark, d):
    return E.ece(E.reliability(scores(spark, d), 12, 20, 1000.0)).select(F.round("ece", 9).alias("ece"))


AUC = "CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, (sum(CASE WHEN y = 1 THEN 2 * below + same ELSE 0 END)) / (2 * nullif(sum(y) * sum(1 - y), 0)) AS auc"


@query(on(", r AS (SELECT y, coalesce(sum(1 - y) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(1 - y) OVER (PARTITION BY score) AS same FROM scores) SELECT " + AUC + " FROM r"))
def roc_auc(spark, d):
    return E.roc_auc(scores(spark, d))


@query(on(", r AS (SELECT month, y, coalesce(sum(1 - y) OVER (PARTITION BY month ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(1 - y) OVER (PARTITION BY month, score) AS same FROM scores) SELECT month, " + AUC + " FROM r GROUP BY month HAVING sum(y) >= 1 AND sum(1 - y) >= 1"))
def monthly_auc(spark, d):
    return E.roc_auc(scores(spark, d), "month").filter("pos >= 1 and neg >= 1")


@query(on(G + f", c AS (SELECT p, sum(p) OVER {DOWN} AS tp, sum(n) OVER {DOWN} AS k, sum(p) OVER () AS pos FROM g) SELECT round(sum(p / pos * tp / k), 9) AS ap FROM c"))
def pr_auc(spark, d):
    return E.pr_auc(scores(spark, d)).select(F.round("ap", 9).alias("ap"))


@query(on(G + f", c AS (SELECT sum(p) OVER {UP} / sum(p) OVER () - sum(n - p) OVER {UP} / sum(n - p) OVER () AS gap FROM g) SELECT round(max(abs(gap)), 9) AS ks FROM c"))
def ks(spark, d):
    return E.ks(scores(spark, d)).select(F.round("ks", 9).alias("ks"))


@query()
def bootstrap_ci(spark, d):
    return E.bootstrap_auc(scores(spark, d), 400)


CONF = "count(*) FILTER (score >= 500 AND y = 1) AS tp, count(*) FILTER (score >= 500 AND y = 0) AS fp, count(*) FILTER (score < 500 AND y = 1) AS fn, count(*) FILTER (score < 500 AND y = 0) AS tn"


@query(on(f"SELECT {CONF} FROM scores"))
def confusion(spark, d):
    return E.confusion(scores(spark, d), 500)


@query(on(f", c AS (SELECT {CONF} FROM scores) SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, tn / nullif(tn + fn, 0) AS npv, fn / nullif(fn + tp, 0) AS fnr, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) AS mcc, round(((tp + tn) / n - e) / nullif(1 - e, 0), 9) AS kappa FROM c, (SELECT tp + fp + fn + tn AS n, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS e FROM c)"))
def decision_metrics(spark, d):
    out = E.decision_metrics(E.confusion(scores(spark, d), 500))
    return out.select("tp", "fp", "fn", "tn", "precision", "recall", "specificity", "npv", "fnr", "f1", *[F.round(c, 9).alias(c) for c in ("balanced", "mcc", "kappa")])


@query(on(", e AS (SELECT DISTINCT unnest(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8])) AS threshold FROM scores) SELECT threshold, 2 * count(*) FILTER (y = 1) / (count(*) + (SELECT sum(y) FROM scores)) AS f1 FROM e JOIN scores ON score >= threshold GROUP BY threshold"))
def metric_sweep(spark, d):
    return E.metric_sweep(scores(spark, d), 5)


GRID = [0.0005 + 0.999 * i / 599 for i in range(600)]


@query(on(f""", e AS (SELECT DISTINCT round(unnest(quantile_cont(score, {GRID})), 9) AS threshold FROM scores),
c AS (SELECT threshold, count(*) FILTER (score >= threshold)::DOUBLE AS k, (count(*) FILTER (score >= threshold AND y = 1))::DOUBLE AS tp, count(*)::DOUBLE AS total, sum(y)::DOUBLE AS pos FROM e, scores GROUP BY threshold),
m AS (SELECT threshold, coalesce(tp / nullif(k, 0), 1) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce((total - pos - k + tp) / nullif(total - pos, 0), 0) AS specificity, coalesce(2 * tp / nullif(k + pos, 0), 0) AS f1,
 (tp + (total - pos - k + tp)) / total AS accuracy, coalesce((tp * (total - pos - k + tp) - (k - tp) * (pos - tp)) / nullif(sqrt(k * pos * (total - pos) * (total - k)), 0), 0) AS mcc FROM c)
SELECT threshold, precision, recall, specificity, f1, accuracy, (recall + specificity) / 2 AS balanced, mcc, threshold = (SELECT threshold FROM m ORDER BY round(f1, 9) DESC, threshold LIMIT 1) AS best_f1, threshold = (SELECT threshold FROM m ORDER BY round(mcc, 9) DESC, threshold LIMIT 1) AS best_mcc FROM m"""))
def metric_sweep_600(spark, d):
    return E.metric_grid(scores(spark, d), 600)


@query(on(G + f", c AS (SELECT score, sum(n) OVER {DOWN} / sum(n) OVER () AS share, sum(p) OVER {DOWN} / sum(p) OVER () AS gain FROM g) SELECT score, share, gain, gain / share AS lift FROM c"))
def gain_lift(spark, d):
    return E.gain_lift(scores(spark, d))


@query(on(LANE + " SELECT score, lane / total AS share, 1 - misses / lane AS purity FROM c"))
def lane_purity(spark, d):
    return E.lane_purity(scores(spark, d))


@query(on("SELECT doc_id, CASE WHEN abs(score / 1000 - 0.5) >= 0.4 THEN 'very high' WHEN abs(score / 1000 - 0.5) >= 0.3 THEN 'high' WHEN abs(score / 1000 - 0.5) >= 0.15 THEN 'medium' ELSE 'low' END AS band FROM scores"))
def score_band(spark, d):
    return scores(spark, d).select("doc_id", E.score_band(F.col("score") / 1000).alias("band"))


@query(on("SELECT doc_id, CASE WHEN lang = 'en' AND score < 300 THEN 'auto_lane' ELSE 'human_lane' END AS lane FROM scores"))
def route(spark, d):
    return scores(spark, d).select("doc_id", E.route(F.col("score"), F.col("lang") == "en", 300).alias("lane"))


def hashed_words(spark, d):
    """doc_id, label (1 for low quality) and the document's words hashed to 4,096 features."""
    from pyspark.ml.feature import HashingTF

    from ..sources.views import table

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", (1 - F.col("quality")).cast("double").alias("label"), F.split(F.lower("text"), r"\s+").alias("w"))
    return HashingTF(inputCol="w", outputCol="features", numFeatures=1 << 12).transform(docs).drop("w")


@query()
def logistic_model(spark, d):
    """A linear model on hashed words, fitted on two thirds; every row is scored."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    x = hashed_words(spark, d)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(x.filter("doc_id % 3 <> 0"))
    return model.transform(x).select("doc_id", (F.col("doc_id") % 3 == 0).alias("held_out"), "label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


@query()
def forward_scores(spark, d):
    """Out-of-fold scores: five folds in order of doc_id, each by a model of those before."""
    x = E.forward_folds(written(hashed_words(spark, d), "features"), ["doc_id"])
    return E.forward_scores(x, 5).select("doc_id", "fold", "label", "score")


def word_features(spark, d):
    """doc_id, label (1 for low quality), indices and values of the document's words."""
    from ..operators.linear import hashed_features
    from ..sources.views import table

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = hashed_features(docs.select("doc_id", "quality", F.split(F.lower("text"), r"\s+").alias("w")), "doc_id", F.col("w"), 1 << 12)
    return x.select("doc_id", (1 - F.col("quality")).cast("double").alias("label"), "indices", "values")


@query()
def sgd_model(spark, d):
    """Averaged stochastic gradient on hashed words, fitted on two thirds; every row is scored."""
    from ..operators.linear import averaged_sgd

    x = written(word_features(spark, d), "features")
    model = averaged_sgd(x.filter("doc_id % 3 <> 0"), "doc_id", 1 << 12)
    return model.scored(x).select("doc_id", (F.col("doc_id") % 3 == 0).alias("held_out"), "label", "score")


@query()
def forward_scores_sgd(spark, d):
    """Out-of-fold scores by averaged stochastic gradient, each fold by a model of those before."""
    x = E.forward_folds(written(word_features(spark, d), "features"), ["doc_id"])
    return E.forward_scores(x, 5, E.sgd("doc_id", 1 << 12, workers=4)).select("doc_id", "fold", "label", "score")
