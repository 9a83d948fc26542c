"""Disposition analytics: counts, rates, pivots, profiles and associations.

Frames of containers have container_id, t, tenant, rule, instance, verdict, status, role,
is_esc and cost. Shares are fractions of counts, unrounded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import EMPTY_VALUES
from .filters import CLASSES
from .ordered import running


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def is_unique(df: DataFrame, key: str) -> bool:
    """Whether each row has a key of its own, none of them null."""
    rows, keys = df.select(F.count("*"), F.count_distinct(key)).first()
    return rows == keys


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts with nulls kept and each value's share."""
    c = count_by(df, column)
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def rule_volume(df: DataFrame) -> DataFrame:
    dup = (F.col("status") == "duplicate").cast("int")
    return df.groupBy("rule").agg(F.count("*").alias("n"), F.sum(dup).alias("dups"), F.avg(F.col("is_esc").cast("int")).alias("esc_rate")).withColumn("worked", F.col("n") - F.col("dups")).withColumn("dup_share", F.col("dups") / F.col("n"))


def tenant_rates(df: DataFrame) -> DataFrame:
    return df.groupBy("tenant", "instance").agg(F.count("*").alias("n"), F.avg((F.col("status") == "duplicate").cast("int")).alias("dup_rate"), F.avg(F.col("is_esc").cast("int")).alias("esc_rate"))


def kpi_tiles(df: DataFrame) -> DataFrame:
    """One row from one pass."""
    share = lambda c: F.avg(c.cast("int"))
    return df.agg(
        F.count("*").alias("n"), F.count_distinct("rule").alias("rules"), F.count_distinct("tenant").alias("tenants"),
        F.count_if(F.col("status") == "duplicate").alias("dups"), share(F.col("status") == "duplicate").alias("dup_share"),
        share(F.col("is_esc")).alias("esc_share"), share(F.col("verdict") == "True Positive").alias("tp_share"),
    )


def pivot_counts(df: DataFrame, key: str, column: str, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Counts of each value in a fixed column order, with the row's total."""
    cells = [F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names)]
    return df.groupBy(key).agg(*cells, F.count("*").alias("total"))


def with_shares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{n}_share": F.col(n) / F.col("total") for n in names})


def verdict_by(df: DataFrame, key: str) -> DataFrame:
    return with_shares(pivot_counts(df, key, "verdict", CLASSES, ("tp", "fp", "bp")), ("tp", "fp", "bp"))


def folded(df: DataFrame, key: str, k: int, into: str = "Other") -> DataFrame:
    """All but the ``k`` most frequent keys become ``into``."""
    top = count_by(df, key).orderBy(F.desc("n"), key).limit(k).select(F.col(key).alias("__k"))
    return df.join(F.broadcast(top), F.col(key) == F.col("__k"), "left").withColumn(key, F.coalesce("__k", F.lit(into))).drop("__k")


def clock_matrix(df: DataFrame, time: str) -> DataFrame:
    """The whole 7 by 24 grid, Monday 0, with zeros."""
    grid = df.sparkSession.range(7 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    n = df.groupBy(F.weekday(time).alias("weekday"), F.hour(time).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(n, ["weekday", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dominant(df: DataFrame, key: str, column: str) -> DataFrame:
    """The most frequent value of each key; ties go to the smallest."""
    c = count_by(df, key, column)
    return c.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), column))).filter("rn = 1").drop("rn")


def coerced_sums(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sums of what reads as an integer; the rest counts as missing."""
    v = F.expr(f"try_cast({text} as bigint)")
    return df.groupBy(key).agg(F.sum(v).alias("total"), F.count(v).alias("numeric"), F.count("*").alias("n"))


def unpivot_count(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.explode(F.array(*columns)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def explode_count(df: DataFrame, text: str, sep: str) -> DataFrame:
    return df.select(F.explode(F.split(text, sep)).alias("value")).select(F.trim("value").alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def rule_pareto(df: DataFrame, least: int = 1) -> DataFrame:
    """Cost and yield of each rule, and the best yield among rules at least as costly."""
    a = df.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "True Positive").alias("found")).filter(F.col("n") >= least)
    a = a.withColumn("yield_", F.col("found") / F.col("n"))
    return a.withColumn("best", F.max("yield_").over(W.orderBy(F.desc("n"), "rule").rowsBetween(W.unboundedPreceding, 0)))


def concentration_curve(df: DataFrame) -> DataFrame:
    """Cumulative shares of work and of finds, the most productive rules first."""
    a = df.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "True Positive").alias("found"))
    w = W.orderBy(F.desc(F.col("found") / F.col("n")), "rule").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy()
    return a.select("rule", (F.sum("n").over(w) / F.sum("n").over(all_)).alias("work_share"), (F.sum("found").over(w) / F.sum("found").over(all_)).alias("find_share"))


def verdict_noise(df: DataFrame, least: int) -> DataFrame:
    """Per rule: groups of (tenant, rule) with several verdicts, of groups with support."""
    g = df.groupBy("tenant", "rule").agg(F.count("*").alias("n"), F.count_distinct("verdict").alias("kinds")).filter(F.col("n") >= least)
    return g.groupBy("rule").agg(F.count("*").alias("groups"), F.count_if(F.col("kinds") > 1).alias("split"), F.sum("n").alias("n")).withColumn("split_share", F.col("split") / F.col("groups"))


def title_stats(df: DataFrame, title: str, least: int) -> DataFrame:
    """By the lower-cased last part of the title: support, share of true positives, and the
    first title in order."""
    tail = F.lower(F.element_at(F.split(title, " - "), -1))
    return df.groupBy(tail.alias("tail")).agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "True Positive").cast("int")).alias("tp_share"), F.min(title).alias("first_title")).filter(F.col("n") >= least)


def rater_lift(df: DataFrame) -> DataFrame:
    """Mean of a role's verdicts less the mean of their (rule, tenant) group, over groups
    that two roles or more have rated. Group means come from counts, so no row is windowed."""
    tp = (F.col("verdict") == "True Positive").cast("int")
    by = df.groupBy("rule", "tenant", "role").agg(F.count("*").alias("n"), F.sum(tp).alias("tp"))
    w = W.partitionBy("rule", "tenant")
    by = by.withColumns({"roles": F.count("*").over(w), "gn": F.sum("n").over(w), "gtp": F.sum("tp").over(w)}).filter("roles >= 2")
    return by.groupBy("role").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), (F.sum(F.col("tp") - F.col("n") * F.col("gtp") / F.col("gn")) / F.sum("n")).alias("lift"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's score interval."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def wilson_consistency(df: DataFrame, least: int) -> DataFrame:
    """Share of a rule's most frequent verdict, with its interval."""
    c = count_by(df, "rule", "verdict").groupBy("rule").agg(F.max("n").alias("top"), F.sum("n").alias("n")).filter(F.col("n") >= least)
    low, high = wilson(F.col("top"), F.col("n"))
    return c.withColumns({"low": low, "high": high})


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """From whole numbers, whose products may pass 64 bits."""
    n, x, y, xx, yy, xy = (c.cast("decimal(19,0)") for c in (n, x, y, xx, yy, xy))
    root = lambda c: F.sqrt(c.cast("double"))
    return (n * xy - x * y).cast("double") / (root(n * xx - x * x) * root(n * yy - y * y))


def phi_matrix(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Pairwise correlation of 0/1 flags, from one pass of counts."""
    sums = [F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f"s_{f}") for f in flags]]
    sums += [F.sum((F.col(a) & F.col(b)).cast("long")).alias(f"p_{a}_{b}") for i, a in enumerate(flags) for b in flags[i + 1 :]]
    one = df.agg(*sums)
    pairs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col("n"), F.col(f"s_{a}"), F.col(f"s_{b}"), F.col(f"s_{a}"), F.col(f"s_{b}"), F.col(f"p_{a}_{b}")).alias("phi"))
        for i, a in enumerate(flags) for b in flags[i + 1 :]
    ]
    return one.select(F.inline(F.array(*pairs)))


def rule_corr(df: DataFrame, k: int) -> DataFrame:
    """Correlation of the daily counts of the ``k`` most frequent rules, days without an
    alert of the rule counting as zero; rules that don't vary have none."""
    top = count_by(df, "rule").orderBy(F.desc("n"), "rule").limit(k).select("rule")
    daily = df.join(F.broadcast(top), "rule", "left_semi").groupBy("rule", F.to_date("t").alias("day")).agg(F.count("*").alias("c"))
    days = df.select(F.to_date("t").alias("day")).agg(F.count_distinct("day").alias("days"))
    own = daily.groupBy("rule").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    a, b = daily.select(F.col("rule").alias("a"), "day", F.col("c").alias("ca")), daily.select(F.col("rule").alias("b"), "day", F.col("c").alias("cb"))
    cross = a.join(b, "day").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("xy"))
    x, y = own.toDF("a", "xa", "xxa"), own.toDF("b", "yb", "yyb")
    j = x.join(F.broadcast(y), F.col("a") < F.col("b")).join(cross, ["a", "b"], "left").join(F.broadcast(days))
    xy = F.coalesce("xy", F.lit(0))
    return j.filter("days * xxa > xa * xa and days * yyb > yb * yb").select("a", "b", pearson(F.col("days"), F.col("xa"), F.col("yb"), F.col("xxa"), F.col("yyb"), xy).alias("r"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells with row, column and overall totals."""
    c = count_by(df, a, b)
    return c.withColumns({"ra": F.sum("n").over(W.partitionBy(a)), "rb": F.sum("n").over(W.partitionBy(b)), "total": F.sum("n").over(W.partitionBy())})


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V with bias correction."""
    c = contingency(df, a, b)
    s = c.agg((F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.max("total").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"))
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("phi2") - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    return s.select(F.col("n"), F.col("r"), F.col("k"), F.sqrt(phi / F.least(kc - 1, rc - 1)).alias("v"))


def mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropy of ``b`` and its mutual information with ``a``, natural logarithms."""
    c = contingency(df, a, b)
    mi = c.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("ra") * F.col("rb")))).alias("mi"))
    h = count_by(df, b).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy())).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))
    return mi.join(F.broadcast(h))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, present, distinct_n, top, top_n. Values are stacked once and counted once."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    c = long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = c.withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value")))
    return ranked.groupBy("column").agg(F.sum("n").alias("present"), F.count("*").alias("distinct_n"), F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("top"), F.max(F.when(F.col("rn") == 1, F.col("n"))).alias("top_n"))


def presence_lift(df: DataFrame, flag: Column, hit: Column) -> DataFrame:
    h = hit.cast("int")
    return df.agg(F.count_if(flag).alias("present"), F.avg(F.when(flag, h)).alias("with_"), F.avg(F.when(~flag, h)).alias("without")).withColumn("lift", F.col("with_") - F.col("without"))


def scorecard(df: DataFrame, bins: Sequence[str], least: int) -> DataFrame:
    """For each indicator and bin: n and the true-positive share, of bins with support; an
    indicator needs two of them. Spread is between its extremes."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(b).alias("indicator"), F.col(b).cast("string").alias("bin"), (F.col("verdict") == "True Positive").cast("int").alias("tp")) for b in bins])))
    c = long.groupBy("indicator", "bin").agg(F.count("*").alias("n"), F.avg("tp").alias("tp_share")).filter(F.col("n") >= least)
    w = W.partitionBy("indicator")
    return c.withColumns({"bins": F.count("*").over(w), "spread": F.max("tp_share").over(w) - F.min("tp_share").over(w)}).filter("bins >= 2")


def key_coverage(df: DataFrame, id_col: str, keys: Column, tokens: int) -> DataFrame:
    """Share of alerts that have each key, with a band: rare under 1 %, common from 50 %."""
    total = df.agg(F.count("*").alias("total"))
    c = df.select(id_col, F.explode(keys).alias("key")).groupBy("key").agg(F.count_distinct(id_col).alias("n"))
    share = F.col("n") / F.col("total")
    return c.join(F.broadcast(total)).select("key", "n", share.alias("share"), F.when(share < 0.01, "rare").when(share < 0.5, "some").otherwise("common").alias("band"))


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at position floor(share * n) of the ascending order."""
    c = running(df.groupBy(value).agg(F.count("*").alias("c")), F.col(value), {"upto": F.col("c")})
    return c.filter(F.col("upto") > F.floor(F.col("upto_all") * F.lit(share))).agg(F.min(value).alias("value"))


def extremes(df: DataFrame, columns: Sequence[str], k: int, key: str) -> DataFrame:
    """Rows that are among the ``k`` largest by any of the columns, once each."""
    out = None
    for c in columns:
        top = df.orderBy(F.desc(c), key).limit(k)
        out = top if out is None else out.unionByName(top)
    return out.dropDuplicates([key])


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 0, clamped to the pages that there are."""
    n = df.count()
    first = min(max(number, 0), max(-(-n // size) - 1, 0)) * size
    got = df.orderBy(*order).offset(first).limit(size)
    return got.withColumn("rank", (F.row_number().over(W.orderBy(*order)) + first).cast("int"))  # of a page


def run_consistency(df: DataFrame, run: str, value: str, score: str) -> DataFrame:
    """Over runs: spread of the score, and how many values all runs or any run have. Runs are
    counted for each value, so no task holds the values of a run."""
    per = df.groupBy(run).agg(F.avg(score).alias("s")).agg(F.count("*").alias("runs"), F.min("s").alias("least"), F.max("s").alias("most"))
    held = df.filter(F.col(value).isNotNull()).select(run, value).distinct().groupBy(value).agg(F.count("*").alias("in_runs")).groupBy("in_runs").agg(F.count("*").alias("n"))
    both = per.join(F.broadcast(held), how="left")  # a row for each number of runs
    out = both.groupBy("runs", "least", "most").agg(F.coalesce(F.sum(F.when(F.col("in_runs") == F.col("runs"), F.col("n"))), F.lit(0)).alias("in_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("in_any"))
    return out.select("runs", "least", "most", (F.col("most") - F.col("least")).alias("spread"), "in_all", "in_any")


def key_tokens(df: DataFrame, id_col: str, entries: Column) -> DataFrame:
    """For each key of a map of rendered values: how many alerts have a value, the words of
    ``key value``, coverage and share of all words in percent, and the coverage's band."""
    total = df.agg(F.count("*").alias("alerts"))
    v = F.trim(F.col("value"))
    long = df.select(id_col, F.explode(entries).alias("key", "value")).filter((v != "") & ~F.lower(v).isin(*EMPTY_VALUES))
    words = F.size(F.filter(F.split(F.concat_ws(" ", "key", "value"), r"\s+"), lambda w: w != ""))
    c = long.groupBy("key").agg(F.count("*").alias("on_alerts"), F.sum(words.cast("long")).alias("tokens"))
    all_ = c.agg(F.sum("tokens").alias("all_tokens"))
    c = c.join(F.broadcast(total)).join(F.broadcast(all_))
    cover = F.round(F.col("on_alerts") / F.col("alerts") * 100, 1)
    band = F.when(cover <= 1, "<1%").when(cover <= 10, "1-10%").when(cover <= 50, "10-50%").when(cover <= 90, "50-90%").when(cover <= 99.9, "90-99.9%").otherwise("100%")
    return c.select("key", "on_alerts", "tokens", cover.alias("coverage_pct"), F.round(F.col("tokens") / F.col("all_tokens") * 100, 3).alias("token_share_pct"), band.alias("band"))
