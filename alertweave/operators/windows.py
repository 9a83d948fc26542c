"""Prior-only features and sequence windows. Rows are ordered by (t, container_id), so ties
have one order; a feature of a row sees earlier rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from .scans import Scan

PAIR = ("tenant", "rule")
BENIGN = "Benign Positive"


def order(*keys: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy("t", "container_id")


def prior_rate(df: DataFrame, keys: Sequence[str], hit: Column, name: str, smoothing: float = 20.0, prior: float | None = None) -> DataFrame:
    """(hits before + smoothing * p) / (n before + smoothing), and n before. p is the whole
    population's mean unless given. Without smoothing the rate of the unseen is null."""
    h = hit.cast("int")
    if prior is None:
        # a scalar subquery keeps the mean from being a window over all rows in one task
        df = df.crossJoin(F.broadcast(df.agg(F.avg(h).alias("__p"))))
        p = F.col("__p")
    else:
        p = F.lit(float(prior))
    df = Scan(df, keys).sums_before({"__n": F.lit(1), "__hits": F.coalesce(h, F.lit(0))})
    n, hits = F.col("__n"), F.col("__hits")
    rate = (hits + smoothing * p) / (n + F.lit(smoothing)) if smoothing else F.when(n > 0, hits / n)
    return df.withColumn(f"{name}_n", n).withColumn(f"{name}_rate", rate).drop("__p", "__n", "__hits")


def seen_before(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    return Scan(df, keys).sums_before({"seen": F.lit(1)})


def previous(df: DataFrame, keys: Sequence[str] = PAIR, column: str = "verdict", default: str | None = "none") -> DataFrame:
    return Scan(df, keys).last_before("prev", column, default)


def benign_run(df: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Benign verdicts in a row right before a row."""
    return Scan(df, keys).run_before("benign_run", F.col("verdict") == BENIGN)


def flip_rate(df: DataFrame) -> DataFrame:
    """Within a rule, of the earlier rows that had a previous verdict of their own pair, the
    share that differed from it; null without any."""
    df = Scan(df, PAIR).last_before("__prev", "verdict", None)
    p = F.col("__prev")
    df = Scan(df, ["rule"]).sums_before({"__had": p.isNotNull().cast("int"), "__flip": F.coalesce((p != F.col("verdict")).cast("int"), F.lit(0))})
    return df.withColumn("flip_rate", F.when(F.col("__had") > 0, F.col("__flip") / F.col("__had"))).drop("__had", "__flip", "__prev")


def distinct_before(df: DataFrame, key: str = "rule", value: str = "tenant") -> DataFrame:
    """Distinct values so far, by counting first occurrences."""
    df = Scan(df, [key, value]).sums_before({"__before": F.lit(1)})
    return Scan(df, [key]).sums_before({"distinct_before": (F.col("__before") == 0).cast("int")}).drop("__before")


def recurrence(df: DataFrame, time: str, keys: Sequence[str], tie: str) -> DataFrame:
    """Seconds since the key's previous row, and their bucket."""
    w = W.partitionBy(*keys).orderBy(time, tie)
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1e6
    df = df.withColumn("gap", gap)
    return df.withColumn("bucket", F.when(F.col("gap").isNull(), "first").when(F.col("gap") <= 3600, "<=1h").when(F.col("gap") <= 86400, "<=24h").when(F.col("gap") <= 7 * 86400, "<=7d").otherwise(">7d"))


# calendars


def daily_dense(df: DataFrame, time: str = "t") -> DataFrame:
    """day, n for every day between the first and the last."""
    c = df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    days = c.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(c, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rolling(column: str, n: int, f, by: Column | str = "day") -> Column:
    """``f`` over the last ``n`` rows, null until there are as many."""
    w = W.orderBy(by).rowsBetween(-n + 1, 0)
    return F.when(F.count("*").over(w) == n, f(F.col(column)).over(w))


def signal_tape(daily: DataFrame, fast: int = 7, slow: int = 28, band: int = 20) -> DataFrame:
    """Fast and slow means and a band of two deviations, cut at zero below. A calendar has a
    row for each day, so the unpartitioned windows stay small at any input."""
    out = daily.withColumns({"fast": rolling("n", fast, F.avg), "slow": rolling("n", slow, F.avg), "mid": rolling("n", band, F.avg), "sd": rolling("n", band, F.stddev_samp)})
    return out.withColumns({"upper": F.col("mid") + 2 * F.col("sd"), "lower": F.greatest(F.col("mid") - 2 * F.col("sd"), F.lit(0.0))})


def crossovers(tape: DataFrame, skip: int = 28) -> DataFrame:
    """Days on which fast crosses slow, after the first ``skip``."""
    w = W.orderBy("day")
    above = F.col("fast") > F.col("slow")
    out = tape.withColumn("above", F.coalesce(above, F.lit(False))).withColumn("rn", F.row_number().over(w))
    out = out.withColumn("was", F.lag("above").over(w))
    return out.filter((F.col("rn") > skip) & (F.col("above") != F.col("was"))).select("day", F.when(F.col("above"), "up").otherwise("down").alias("direction"))


def per_rule_days(df: DataFrame) -> DataFrame:
    return df.groupBy("rule", F.to_date("t").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "True Positive").alias("tp"))


def against_median(daily: DataFrame, n: int = 7, least: int = 4) -> DataFrame:
    """rule, day, side: 1 above the median of the rule's last ``n`` days with alerts, -1
    below; null with fewer than ``least`` of them."""
    w = W.partitionBy("rule").orderBy("day").rowsBetween(-n, -1)
    median = F.when(F.count("n").over(w) >= least, F.percentile("n", 0.5).over(w))
    return daily.withColumn("median", median).withColumn("side", F.signum(F.col("n") - F.col("median")).cast("int"))


def breadth(daily: DataFrame) -> DataFrame:
    """Rules above their median less rules below, by day."""
    return against_median(daily).groupBy("day").agg(F.sum("side").alias("breadth"))


def volume_z(daily: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    w = W.partitionBy("rule").orderBy("day").rowsBetween(-n, -1)
    enough = F.count("n").over(w) >= least
    mean, sd = F.avg("n").over(w), F.stddev_samp("n").over(w)
    return daily.withColumn("z", F.when(enough & (sd > 0), (F.col("n") - mean) / sd))


def equity(df: DataFrame) -> DataFrame:
    """By day: the running sum of +1 for a true positive and -1 otherwise, days without
    alerts carried forward, and its fall from the running maximum."""
    step = F.sum(F.when(F.col("verdict") == "True Positive", 1).otherwise(-1))
    c = df.groupBy(F.to_date("t").alias("day")).agg(step.alias("step"))
    days = daily_dense(df).select("day").join(c, "day", "left").withColumn("step", F.coalesce("step", F.lit(0)))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumn("equity", F.sum("step").over(w))
    return days.withColumn("drawdown", F.col("equity") - F.max("equity").over(w)).select("day", "equity", "drawdown")


def score_drawdown(df: DataFrame) -> DataFrame:
    """For each row, how far the rule's running score stood below its own high before it."""
    return Scan(df, ["rule"]).below_high("below_high", F.when(F.col("verdict") == "True Positive", 1).otherwise(-1))


def momentum(daily: DataFrame, days: int = 14, least: int = 20) -> DataFrame:
    """Rolling true-positive share over calendar days, with support. A range frame needs no
    filled calendar."""
    w = W.partitionBy("rule").orderBy(F.unix_date("day")).rangeBetween(-days + 1, 0)
    n, tp = F.sum("n").over(w), F.sum("tp").over(w)
    return daily.withColumn("support", n).withColumn("momentum", F.when(n >= least, tp / n))


def rate_after(df: DataFrame, key: str, least: int) -> DataFrame:
    """Per key: the true-positive share after a true positive of the pair and after another
    verdict, where both have support, and their difference."""
    p = previous(df, default=None).filter("prev is not null")
    tp, after = (F.col("verdict") == "True Positive").cast("int"), F.col("prev") == "True Positive"
    a = p.groupBy(key).agg(F.count_if(after).alias("n_after"), F.count_if(~after).alias("n_other"), F.avg(F.when(after, tp)).alias("rate_after"), F.avg(F.when(~after, tp)).alias("rate_other"))
    return a.filter((F.col("n_after") >= least) & (F.col("n_other") >= least)).withColumn("gap", F.col("rate_after") - F.col("rate_other"))


def flips_by_rule(df: DataFrame) -> DataFrame:
    p = previous(df, default=None).filter("prev is not null")
    return p.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("prev") != F.col("verdict")).alias("flips")).withColumn("flip_share", F.col("flips") / F.col("n"))


def transition_matrix(df: DataFrame) -> DataFrame:
    """prev, verdict, n and the share of prev's row."""
    c = previous(df, default=None).filter("prev is not null").groupBy("prev", "verdict").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("prev")))


def entity_baseline(daily: DataFrame, key: str, days: int = 7, least: int = 3) -> DataFrame:
    """Suppressed where today's count is within the mean of the earlier ``days`` rows."""
    w = W.partitionBy(key).orderBy("day").rowsBetween(-days, -1)
    base = F.when(F.count("n").over(w) >= least, F.avg("n").over(w))
    return daily.withColumn("baseline", base).withColumn("suppressed", F.coalesce(F.col("n") <= F.col("baseline"), F.lit(False)))


def usecase_dedup(df: DataFrame, keys: Sequence[str], time: str, tie: str, seconds: int) -> DataFrame:
    """Duplicate if the same rule and source fired within the window before."""
    return recurrence(df, time, keys, tie).withColumn("duplicate", F.coalesce(F.col("gap") <= seconds, F.lit(False)))


def hold_and_sort(df: DataFrame, key: str, time: str, order: str, quiet_seconds: float) -> DataFrame:
    """Rows of a key are held until none has come for ``quiet_seconds``, then released together
    in ``order``. Adds batch (from 0), place (from 1), held (rows of the batch) and
    released_at; the first of a batch is its origin."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = W.partitionBy(key).orderBy(time, order)
    opens = F.coalesce((at - F.lag(at).over(w)) > F.lit(int(quiet_seconds * 1e6)), F.lit(False))
    df = df.withColumn("__opens", opens.cast("long")).withColumn("batch", F.sum("__opens").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__opens")
    b = W.partitionBy(key, "batch")
    last = F.timestamp_micros(F.max(at).over(b) + F.lit(int(quiet_seconds * 1e6)))
    return df.withColumns({"place": F.row_number().over(b.orderBy(order)), "held": F.count("*").over(b), "released_at": last})


def indicator_frame(df: DataFrame) -> DataFrame:
    """Each verdict row with its day's indicators: the rule's volume z, whether the rule runs
    fast, and the market's breadth, each with its bin; null where there is no support. The
    indicators are small tables of rule and day, joined on their keys."""
    daily = per_rule_days(df)
    w = lambda n: W.partitionBy("rule").orderBy("day").rowsBetween(-n + 1, 0)
    mean = lambda n, least: F.when(F.count("n").over(w(n)) >= least, F.avg("n").over(w(n)))
    z = volume_z(daily).withColumn("z", F.round("z", 9)).withColumn("fast_high", mean(7, 4) > mean(28, 10)).select("rule", "day", "z", "fast_high")
    out = df.withColumn("day", F.to_date("t")).join(z, ["rule", "day"], "left").join(breadth(daily), "day", "left")
    z_bin = F.when(F.col("z") <= -1, "z <= -1").when(F.col("z") <= -0.5, "-1 to -0.5").when(F.col("z") <= 0.5, "-0.5 to 0.5").when(F.col("z") <= 1, "0.5 to 1").when(F.col("z") <= 2, "1 to 2").when(F.col("z").isNotNull(), "z > 2")
    breadth_bin = F.when(F.col("breadth") <= -5, "<= -5").when(F.col("breadth") <= 0, "-5 to 0").when(F.col("breadth") <= 5, "0 to 5").when(F.col("breadth") <= 10, "5 to 10").when(F.col("breadth").isNotNull(), "> 10")
    return out.withColumns({"z_bin": z_bin, "regime": F.when(F.col("fast_high"), "fast").when(~F.col("fast_high"), "slow"), "breadth_bin": breadth_bin})
