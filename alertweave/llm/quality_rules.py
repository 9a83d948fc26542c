"""Quality rules: learned decision lists, with DataFrame operations only on the corpus.

Statistics of every whole text come from built-in expressions. From labelled statistics,
sequential covering learns an ordered list of rules: a rule grows by the threshold with the
best information gain on two thirds of the rows, is pruned on the other third, and is kept
while its precision there holds; the rows that it covers then leave. The list is emitted as
one CASE WHEN expression.

Learning sees at most ``sample`` labelled rows (20,000), those with the least hash of their
doc_id; statistics and verdicts cover all rows.

Defined results: a null text has no words and fails the base rule, as an empty one does;
null or missing labels are not learned from, several labels of a document count by their
mean; without labels there are no learned rules; repeated rows are judged each; other
columns are ignored. Windows are compared by a 64-bit hash of their five words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SIZE = 5
SAMPLE = 20_000
BINS = 48
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "digits", "word_length", "n_words", "distinct"]


def let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: F.Column) -> F.Column:
    """Words that stand in windows found twice or more."""
    n = F.size(words)

    def of_hashes(h: F.Column) -> F.Column:
        each = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SIZE)]))
        return let(each, of_windows)

    def of_windows(w: F.Column) -> F.Column:
        by_hash = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: F.Column) -> F.Column:
            same = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def covered(p: F.Column) -> F.Column:
            last = F.lit(-SIZE)
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), last.alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(SIZE), x - a["at"])).alias("n"), x.alias("at")))["n"]

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(by_hash, starts), covered))

    return F.when(n < SIZE, F.lit(0)).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), of_hashes))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and
    the learned rules' features."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: F.Column) -> F.Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))

    def dup_lines(lines: F.Column) -> F.Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    words = F.filter(F.split(text, SPACE), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id",
        let(words, of_words).alias("w"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, dup_lines).alias("n_dup_lines"),
        F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace(text, "[^0-9]+", "")).cast("long").alias("n_digits"),
    )
    out = out.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.n_distinct", "n_upper", "n_digits")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def features(stats: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> F.Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")

    return stats.withColumns(
        {
            "symbols": share("n_symbols", "word_chars"), "dup_lines": F.col("n_dup_lines").cast("double"), "repeats": share("n_repeat_words", "n_words"),
            "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"), "word_length": share("word_chars", "n_words"), "distinct": share("n_distinct", "n_words"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> F.Column:
        c = F.col(self.feature).cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def holds(self, row) -> bool:
        return (row[self.feature] > self.threshold) == self.above


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def _grow(rows: list, bad: list[bool], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    import bisect

    rule: list[Condition] = []
    live = list(range(len(rows)))
    while len(rule) < most:
        p0 = sum(bad[i] for i in live)
        n0 = len(live) - p0
        if not p0 or not n0:
            break
        best, chosen = 1e-9, None
        for f, own in cuts.items():
            pos, neg = [0] * (len(own) + 1), [0] * (len(own) + 1)
            for i in live:
                (pos if bad[i] else neg)[bisect.bisect_left(own, rows[i][f])] += 1
            p = n = 0
            for k, t in enumerate(own):  # at or below t
                p, n = p + pos[k], n + neg[k]
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    if (g := _gain(a, b, p0, n0)) > best:
                        best, chosen = g, Condition(f, above, t)
        if chosen is None:
            break
        rule.append(chosen)
        live = [i for i in live if chosen.holds(rows[i])]
    return rule


def _counts(rule: list[Condition], rows: list, bad: list[bool]) -> tuple[int, int]:
    hit = [b for r, b in zip(rows, bad) if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _prune(rule: list[Condition], rows: list, bad: list[bool]) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        p, n = _counts(r, rows, bad)
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(rows: list, bad: list[bool], most_rules: int = 8, most_conditions: int = 3, precision: float = 0.8, support: int = 5) -> list[list[Condition]]:
    """The decision list that rejects; rows: mappings of FEATURES to numbers."""
    rules: list[list[Condition]] = []
    live = list(range(len(rows)))
    while len(rules) < most_rules:
        own, flags = [rows[i] for i in live], [bad[i] for i in live]
        grow = [i for i in range(len(own)) if i % 3]
        prune = [i for i in range(len(own)) if i % 3 == 0]
        if not any(flags[i] for i in grow):
            break
        cuts = {}
        for f in FEATURES:
            values = sorted(own[i][f] for i in grow)
            cuts[f] = sorted({values[min(len(values) - 1, len(values) * k // BINS)] for k in range(1, BINS)})
        rule = _grow([own[i] for i in grow], [flags[i] for i in grow], cuts, most_conditions)
        if not rule:
            break
        rule = _prune(rule, [own[i] for i in prune], [flags[i] for i in prune])
        p, n = _counts(rule, [own[i] for i in prune], [flags[i] for i in prune])
        if p + n < support or p < precision * (p + n):
            break
        rules.append(rule)
        live = [i for i in live if not all(c.holds(rows[i]) for c in rule)]
    return rules


def rule_column(rules: list[list[Condition]]) -> F.Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules) - 1, -1, -1):
        every = rules[k][0].column()
        for c in rules[k][1:]:
            every = every & c.column()
        out = F.when(every, F.lit(k + 1)).otherwise(out)
    return out


def labelled(frame: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, list[bool]]:
    """At most ``sample`` rows with labels, those of the least doc_id hash."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.select(F.col("doc_id").alias("label_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = frame.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select(*FEATURES, "quality", F.xxhash64("doc_id").alias("o")).orderBy("o", *FEATURES).limit(sample).collect()
    return [r.asDict() for r in got], [r.quality < 0.5 for r in got]


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The statistics of every row, the first rule that rejects it (``rule``) and ``kept``."""
    stats = features(common.written(statistics(docs), "rule-stats"))
    rules = learn(*labelled(stats, labels, sample))
    return stats.withColumn("rule", rule_column(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
