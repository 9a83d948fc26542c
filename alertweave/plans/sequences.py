"""Prior-only features, signals and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import windows as X
from ..sources.views import HALF_HOUR, alerts, containers, table, with_views
from .registry import query

ORD = "ORDER BY t, container_id"
PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
HIT = "CASE WHEN verdict = 'True Positive' THEN 1 ELSE 0 END"
LAG = f", p AS (SELECT *, lag(verdict) OVER (PARTITION BY tenant, rule {ORD}) AS prev FROM containers)"
DAILY = ", daily AS (SELECT rule, CAST(t AS DATE) AS day, count(*) AS n, count(*) FILTER (verdict = 'True Positive') AS tp FROM containers GROUP BY 1, 2)"
DENSE = ", dense AS (SELECT CAST(g.day AS DATE) AS day, count(c.t) AS n FROM (SELECT unnest(generate_series((SELECT min(CAST(t AS DATE)) FROM containers), (SELECT max(CAST(t AS DATE)) FROM containers), INTERVAL 1 DAY)) AS day) g LEFT JOIN containers c ON CAST(c.t AS DATE) = CAST(g.day AS DATE) GROUP BY 1)"
TAPE = DENSE + """, tape AS (SELECT day, n,
 CASE WHEN count(*) OVER f = 7 THEN avg(n) OVER f END AS fast, CASE WHEN count(*) OVER s = 28 THEN avg(n) OVER s END AS slow,
 CASE WHEN count(*) OVER b = 20 THEN avg(n) OVER b END AS mid, CASE WHEN count(*) OVER b = 20 THEN stddev_samp(n) OVER b END AS sd FROM dense
 WINDOW f AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), s AS (ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), b AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def on(body: str) -> str:
    return with_views("containers", body)


@query(on(f"""SELECT container_id, count(*) OVER w AS pair_n, round((coalesce(sum({HIT}) OVER w, 0) + 20 * p) / (count(*) OVER w + 20), 9) AS pair_rate FROM containers, (SELECT avg({HIT}) AS p FROM containers) WINDOW w AS (PARTITION BY tenant, rule {ORD} {PREV})"""))
def prior_rates(spark, d):
    return X.prior_rate(containers(spark, d), X.PAIR, F.col("verdict") == "True Positive", "pair").select("container_id", "pair_n", F.round("pair_rate", 9).alias("pair_rate"))


@query(on(f"SELECT container_id, row_number() OVER (PARTITION BY tenant, rule {ORD}) - 1 AS seen FROM containers"))
def pair_seen(spark, d):
    return X.seen_before(containers(spark, d)).select("container_id", "seen")


@query(on(LAG + " SELECT container_id, coalesce(prev, 'none') AS prev FROM p"))
def prev_verdict(spark, d):
    return X.previous(containers(spark, d)).select("container_id", "prev")


@query(on(f""", i AS (SELECT *, coalesce(sum(CASE WHEN verdict <> 'Benign Positive' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant, rule {ORD} {PREV}), 0) AS island FROM containers)
SELECT container_id, CAST(coalesce(sum(CASE WHEN verdict = 'Benign Positive' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant, rule, island {ORD} {PREV}), 0) AS BIGINT) AS benign_run FROM i"""))
def benign_run(spark, d):
    return X.benign_run(containers(spark, d)).select("container_id", "benign_run")


@query(on(LAG + f""" SELECT container_id, CASE WHEN sum(CASE WHEN prev IS NULL THEN 0 ELSE 1 END) OVER w > 0 THEN sum(CASE WHEN prev <> verdict THEN 1 ELSE 0 END) OVER w / sum(CASE WHEN prev IS NULL THEN 0 ELSE 1 END) OVER w END AS flip_rate FROM p WINDOW w AS (PARTITION BY rule {ORD} {PREV})"""))
def rule_flip_rate(spark, d):
    return X.flip_rate(containers(spark, d)).select("container_id", "flip_rate")


@query(on(f""", f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY rule, tenant {ORD}) = 1 THEN 1 ELSE 0 END AS first FROM containers)
SELECT container_id, CAST(coalesce(sum(first) OVER (PARTITION BY rule {ORD} {PREV}), 0) AS BIGINT) AS distinct_before FROM f"""))
def rule_tenants(spark, d):
    return X.distinct_before(containers(spark, d)).select("container_id", "distinct_before")


RECUR = """, g AS (SELECT alert_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY customer, alert_name, user_name ORDER BY ts, alert_id))) / 1e6 AS gap FROM alerts),
b AS (SELECT alert_id, CASE WHEN gap IS NULL THEN 'first' WHEN gap <= 3600 THEN '<=1h' WHEN gap <= 86400 THEN '<=24h' WHEN gap <= 604800 THEN '<=7d' ELSE '>7d' END AS bucket, gap FROM g)"""
RECUR_KEYS = ["customer", "alert_name", "user_name"]


@query(with_views("alerts", RECUR + " SELECT alert_id, bucket FROM b"))
def recurrence_bucket(spark, d):
    return X.recurrence(alerts(spark, d), "ts", RECUR_KEYS, "alert_id").select("alert_id", "bucket")


@query(with_views("alerts", RECUR + " SELECT bucket, count(*) AS n FROM b GROUP BY bucket"))
def recurrence_hist(spark, d):
    return A.count_by(X.recurrence(alerts(spark, d), "ts", RECUR_KEYS, "alert_id"), "bucket")


@query(with_views("alerts", RECUR + " SELECT alert_id, coalesce(gap <= 1800, false) AS duplicate FROM b"))
def usecase_dedup(spark, d):
    return X.usecase_dedup(alerts(spark, d), RECUR_KEYS, "ts", "alert_id", 1800).select("alert_id", "duplicate")


@query(on(DENSE + " SELECT * FROM dense"))
def daily_dense(spark, d):
    return X.daily_dense(containers(spark, d))


@query(on(TAPE + " SELECT day, n, round(fast, 9) AS fast, round(slow, 9) AS slow, round(mid + 2 * sd, 6) AS upper, round(greatest(mid - 2 * sd, 0), 6) AS lower FROM tape"))
def signal_tape(spark, d):
    r = lambda c, k: F.round(c, k).alias(c)
    return X.signal_tape(X.daily_dense(containers(spark, d))).select("day", "n", r("fast", 9), r("slow", 9), r("upper", 6), r("lower", 6))


@query(on(TAPE + """, a AS (SELECT day, coalesce(fast > slow, false) AS above, row_number() OVER (ORDER BY day) AS rn FROM tape), b AS (SELECT *, lag(above) OVER (ORDER BY day) AS was FROM a)
SELECT day, CASE WHEN above THEN 'up' ELSE 'down' END AS direction FROM b WHERE rn > 28 AND above <> was"""))
def crossovers(spark, d):
    return X.crossovers(X.signal_tape(X.daily_dense(containers(spark, d))))


@query(on(DAILY + """, m AS (SELECT *, CASE WHEN count(n) OVER w >= 4 THEN median(n) OVER w END AS med FROM daily WINDOW w AS (PARTITION BY rule ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT day, CAST(sum(CASE WHEN n > med THEN 1 WHEN n < med THEN -1 WHEN n = med THEN 0 END) AS BIGINT) AS breadth FROM m GROUP BY day"""))
def breadth(spark, d):
    return X.breadth(X.per_rule_days(containers(spark, d)))


@query(on(DAILY + """ SELECT rule, day, round(CASE WHEN count(n) OVER w >= 10 AND stddev_samp(n) OVER w > 0 THEN (n - avg(n) OVER w) / stddev_samp(n) OVER w END, 6) AS z FROM daily WINDOW w AS (PARTITION BY rule ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def volume_zscore(spark, d):
    return X.volume_z(X.per_rule_days(containers(spark, d))).select("rule", "day", F.round("z", 6).alias("z"))


@query(on(DENSE + f""", s AS (SELECT CAST(t AS DATE) AS day, sum(2 * {HIT} - 1) AS step FROM containers GROUP BY 1), e AS (SELECT dense.day, CAST(sum(coalesce(step, 0)) OVER (ORDER BY dense.day) AS BIGINT) AS equity FROM dense LEFT JOIN s ON s.day = dense.day)
SELECT day, equity, equity - max(equity) OVER (ORDER BY day) AS drawdown FROM e"""))
def equity_drawdown(spark, d):
    return X.equity(containers(spark, d))


@query(on(f""", s AS (SELECT container_id, rule, t, coalesce(sum(2 * {HIT} - 1) OVER (PARTITION BY rule {ORD} {PREV}), 0) AS s FROM containers)
SELECT container_id, CAST(max(s) OVER (PARTITION BY rule {ORD} ROWS UNBOUNDED PRECEDING) - s AS BIGINT) AS below_high FROM s"""))
def score_drawdown(spark, d):
    return X.score_drawdown(containers(spark, d)).select("container_id", "below_high")


@query(on(DAILY + """ SELECT a.rule, a.day, CAST(sum(b.n) AS BIGINT) AS support, CASE WHEN sum(b.n) >= 5 THEN sum(b.tp) / sum(b.n) END AS momentum FROM daily a JOIN daily b ON a.rule = b.rule AND b.day BETWEEN a.day - 29 AND a.day GROUP BY a.rule, a.day"""))
def momentum(spark, d):
    return X.momentum(X.per_rule_days(containers(spark, d)), 30, 5).select("rule", "day", "support", "momentum")


AFTER = "count(*) FILTER (prev = 'True Positive') AS n_after, count(*) FILTER (prev <> 'True Positive') AS n_other, avg({h}) FILTER (prev = 'True Positive') AS rate_after, avg({h}) FILTER (prev <> 'True Positive') AS rate_other, avg({h}) FILTER (prev = 'True Positive') - avg({h}) FILTER (prev <> 'True Positive') AS gap".format(h=HIT)


@query(on(LAG + f" SELECT tenant, {AFTER} FROM p WHERE prev IS NOT NULL GROUP BY tenant HAVING n_after >= 5 AND n_other >= 5"))
def lift_by_prev(spark, d):
    return X.rate_after(containers(spark, d), "tenant", 5)


@query(on(LAG + f" SELECT rule, {AFTER} FROM p WHERE prev IS NOT NULL GROUP BY rule HAVING n_after >= 5 AND n_other >= 5 ORDER BY abs(gap) DESC, rule LIMIT 10"))
def momentum_gap(spark, d):
    return X.rate_after(containers(spark, d), "rule", 5).orderBy(F.desc(F.abs("gap")), "rule").limit(10)


@query(on(LAG + " SELECT rule, count(*) AS n, count(*) FILTER (prev <> verdict) AS flips, count(*) FILTER (prev <> verdict) / count(*) AS flip_share FROM p WHERE prev IS NOT NULL GROUP BY rule"))
def flip_by_rule(spark, d):
    return X.flips_by_rule(containers(spark, d))


@query(on(LAG + ", c AS (SELECT prev, verdict, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY prev) AS share FROM c"))
def transition_matrix(spark, d):
    return X.transition_matrix(containers(spark, d))


# dates and bins


@query(f"SELECT event_id, {HALF_HOUR} AS bucket, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events")
def time_buckets(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.floor(ms / 1_800_000).alias("bucket"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


@query("SELECT event_id, hour(ts) BETWEEN 8 AND 17 AND isodow(ts) < 6 AS business, hour(ts) BETWEEN 13 AND 23 AS shift FROM events")
def business_hours(spark, d):
    """08 to 17 on Monday to Friday, both hours included; the dashboard's shift is 13 to 23 UTC."""
    h = F.hour("ts")
    return table(spark, d, "events").select("event_id", (h.between(8, 17) & (F.weekday("ts") < 5)).alias("business"), h.between(13, 23).alias("shift"))


@query(on(f"SELECT CAST(date_trunc('week', t) AS DATE) + 6 AS week, count(*) AS n, avg({HIT}) AS tp_share FROM containers GROUP BY 1"))
def weekly_drift(spark, d):
    """Weeks are named by the Sunday that ends them."""
    week = F.date_add(F.to_date(F.date_trunc("week", "t")), 6)
    return containers(spark, d).groupBy(week.alias("week")).agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "True Positive").cast("int")).alias("tp_share"))


@query(on("SELECT CAST(t AS DATE) AS day, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) AS total FROM containers GROUP BY 1"))
def status_timeline(spark, d):
    return A.pivot_counts(containers(spark, d).withColumn("day", F.to_date("t")), "day", "status", ("closed", "duplicate"), ("closed", "duplicate"))


@query(on("SELECT CAST(date_trunc('month', t) AS DATE) AS month, count(*) AS n, avg(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS dup_rate FROM containers GROUP BY 1"))
def dup_trend(spark, d):
    return containers(spark, d).groupBy(F.trunc("t", "month").alias("month")).agg(F.count("*").alias("n"), F.avg((F.col("status") == "duplicate").cast("int")).alias("dup_rate"))


@query("SELECT doc_id, CASE WHEN n_chars <= 500 THEN '(0, 500]' WHEN n_chars <= 2000 THEN '(500, 2000]' ELSE '(2000, inf)' END AS bin FROM documents")
def cut_bins(spark, d):
    """Right-closed bins."""
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n <= 500, "(0, 500]").when(n <= 2000, "(500, 2000]").otherwise("(2000, inf)").alias("bin"))


@query("""WITH q AS (SELECT quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]) AS e FROM documents)
SELECT doc_id, CAST((n_chars > e[1])::INT + (n_chars > e[2])::INT + (n_chars > e[3])::INT + (n_chars > e[4])::INT AS INTEGER) AS fifth FROM documents, q""")
def quantile_bins(spark, d):
    """Fifths by exact interpolated edges, right-closed."""
    df = table(spark, d, "documents").select("doc_id", "n_chars")
    edges = df.agg(F.percentile("n_chars", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    fifth = sum((F.col("n_chars") > F.get("e", F.lit(i))).cast("int") for i in range(4))
    return df.join(F.broadcast(edges)).select("doc_id", fifth.alias("fifth"))


@query("SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN -1 ELSE 0 END AS severity FROM orders")
def severity_numeric(spark, d):
    from ..functions.text import severity_number

    p = F.substring("o_orderpriority", 1, 1)
    word = F.when(p == "1", "Critical").when(p == "2", "HIGH").when(p == "3", "medium").when(p == "4", "urgent").otherwise("informational")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), severity_number(word).alias("severity"))


@query(with_views("alerts", """, c AS (SELECT user_name, CAST(ts AS DATE) AS day, count(*) AS n FROM alerts GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN count(n) OVER w >= 3 THEN avg(n) OVER w END AS base FROM c WINDOW w AS (PARTITION BY user_name ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT user_name, day, n, coalesce(n <= base, false) AS suppressed FROM b"""))
def entity_baseline(spark, d):
    daily = alerts(spark, d).groupBy("user_name", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return X.entity_baseline(daily, "user_name").select("user_name", "day", "n", "suppressed")
