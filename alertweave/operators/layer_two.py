"""Layer two of deduplication: similar alerts of other rules in the same window.

Alerts hold lists of values by indicator type. A type that one of two alerts has scores 0,
one that neither has doesn't count, and one that both have scores the mean, over the later
alert's values, of the best token-sort ratio with the earlier one's; the alert's score is the
mean over types. What is wanted of each alert is the best earlier one, ties to the earliest,
so of each distinct set of values only its record scores are kept: in order of the other
sets' first alerts, those higher than all before.

Sets of a window are dealt to blocks by hash; a task compares a block with a block. It first
bounds all scores at once: a common subsequence has no more characters of a kind than either
text, so the counts of characters bound each ratio, and through best and mean each score. The
ratio itself is computed only where the bound is above the threshold and the set's record so
far. Where sets of two blocks share few distinct lists of each type, the scores of these are
computed instead, all pairs of them, and looked up for the sets; windows share them too. Pairs
never leave the task, only records do, and of those before a set's earliest wanted alert only
the last. Work is in proportion to the square of a window's distinct sets, in numpy, spread
over as many tasks as the window has blocks; a window of 20,000 sets takes 100 block pairs.

Defined results: null values in lists are left out, a null list is an empty one; alerts
without values are similar to nothing; repeated values count each; ties of time go to the
smaller alert_id; rule names compare trimmed and in lower case (``name_hash``)."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions.similarity import lcs_length, sorted_tokens
from ..storage import written

#: Values of a block, cells of a matrix of bounds, kinds of characters, and a length beyond
#: which a text isn't bounded.
BLOCK, CELLS, KINDS, LONG = 2048, 4_000_000, 40, 60_000
#: Pairs of a window so small that bounds cost more than they save.
FEW = 256
#: Columns of ones by which the least of two counts is a product, if there are so few.
ONES = 1500
#: Pairs of sets for each pair of values, and characters of a value, up to which the scores of
#: distinct lists are computed for all pairs.
SHARED, SHORT = 4, 200
#: Scores are rounded to hundredths, twice.
SLACK = 0.011
_KIND = np.array([c - 97 if 97 <= c <= 122 else 26 + c - 48 if 48 <= c <= 57 else 36 + c % 4 for c in range(128)], np.int64)


def token_ratio(x: str, y: str) -> float:
    """The ratio of two texts of sorted tokens."""
    return 100.0 if x == y else 100.0 * 2 * lcs_length(x, y) / (len(x) + len(y))


def mean(scores: Sequence[float]) -> float:
    """Added from left to right, and rounded to hundredths."""
    total = 0.0
    for s in scores:
        total += s
    return round(total / len(scores), 2)


@lru_cache(1 << 16)
def short_ratio(x: str, y: str) -> float:
    return token_ratio(x, y)


@lru_cache(1 << 15)
def list_score(x: tuple[str, ...], y: tuple[str, ...]) -> float:
    """The score of a type: lists of short texts of sorted tokens."""
    return mean([max(short_ratio(v, w) for w in y) for v in x]) if x and y else 0.0


def hundredths(x: np.ndarray) -> np.ndarray:
    """Hundredths of ``round(x, 2)``; what is close to a half is left to ``round``."""
    y = x * 100
    out = np.rint(y)
    near = np.abs(y - np.floor(y) - 0.5) < 1e-6
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([np.rint(round(float(v), 2) * 100) for v in values])[at]
    return out.astype(np.int16)


def kinds_of(text: str) -> np.ndarray:
    """How many characters of each kind the text has."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(raw < 128, _KIND[np.minimum(raw, 127)], 36 + raw % 4), minlength=KINDS)


class Kind:
    """The values of one type in a block: each distinct text once, and each set's own."""

    def __init__(self, lists: list[list[str]], bounded: bool = True):
        self.texts = sorted({sorted_tokens(v) for own in lists for v in own})
        at = {t: i for i, t in enumerate(self.texts)}
        self.of = [[at[sorted_tokens(v)] for v in own] for own in lists]
        self.has = np.array([bool(o) for o in self.of])
        if not bounded:
            return
        self.sets = np.flatnonzero(self.has)
        self.flat = np.array([i for o in self.of for i in o], np.int64)
        sizes = np.array([len(o) for o in self.of if o], np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.lengths = np.array([len(t) for t in self.texts], np.float32)
        self.bags = np.array([np.minimum(kinds_of(t), 65_535) for t in self.texts], np.uint16).reshape(-1, KINDS)


def common_kinds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows the sum over kinds of the lesser count. A count is as many ones,
    so the sums are a product of matrices; with high counts they are taken kind by kind."""
    most = np.minimum(x.max(axis=0), y.max(axis=0)).astype(np.int64)
    if most.sum() <= ONES:
        kind = np.repeat(np.arange(KINDS), most)
        level = np.concatenate([np.arange(1, n + 1) for n in most]) if len(kind) else np.zeros(0, np.int64)
        return (x[:, kind] >= level).astype(np.float32) @ (y[:, kind] >= level).astype(np.float32).T
    out = np.zeros((len(x), len(y)), np.float32)
    for k in np.flatnonzero(most):
        out += np.minimum(x[:, k][:, None], y[:, k][None, :])
    return out


def bounds(a: Kind, b: Kind, first: int, last: int) -> np.ndarray:
    """Upper bounds of the ratio of texts ``first`` to ``last`` of ``a`` with those of ``b``."""
    common = common_kinds(a.bags[first:last], b.bags)
    total = a.lengths[first:last, None] + b.lengths[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(total > 0, np.float32(200) * common / total, np.float32(100)).astype(np.float32)
    out[(a.lengths[first:last, None] > LONG) | (b.lengths[None, :] > LONG)] = 100
    return out


def type_bounds(a: Kind, b: Kind, n: int, m: int) -> np.ndarray:
    """Upper bounds of a type's score for each pair of sets; 0 where a set lacks it."""
    out = np.zeros((n, m), np.float32)
    if not len(a.sets) or not len(b.sets):
        return out
    step = max(1, CELLS // max(len(b.texts), len(b.flat), 1))
    best = np.empty((len(a.texts), len(b.sets)), np.float32)
    for i in range(0, len(a.texts), step):
        each = bounds(a, b, i, min(len(a.texts), i + step))[:, b.flat]
        best[i : i + step] = each if (b.sizes == 1).all() else np.maximum.reduceat(each, b.starts, axis=1)
    mean = best[a.flat] if (a.sizes == 1).all() else np.add.reduceat(best[a.flat], a.starts, axis=0) / a.sizes[:, None].astype(np.float32)
    out[np.ix_(a.sets, b.sets)] = mean
    return out


class Pairing:
    """A block of sets with a block of earlier ones."""

    def __init__(self, a: list[list[list[str]]], b: list[list[list[str]]], types: int):
        bounded = len(a) * len(b) > FEW
        kinds = [(Kind([x[t] for x in a], bounded), Kind([x[t] for x in b], bounded)) for t in range(types)]
        self.kinds = kinds
        self.ratios: list[dict[tuple[int, int], float]] = [{} for _ in range(types)]
        present = np.zeros((len(a), len(b)), np.float32)
        total = np.zeros((len(a), len(b)), np.float32)
        for x, y in kinds:
            present += x.has[:, None] | y.has[None, :]
            if bounded:
                total += type_bounds(x, y, len(a), len(b))
        if not bounded:
            total = 100 * present
        self.bound = np.where(present > 0, total / np.maximum(present, 1), np.float32(-1))

    def ratio(self, t: int, i: int, j: int) -> float:
        known = self.ratios[t]
        if (i, j) not in known:
            x, y = self.kinds[t][0].texts[i], self.kinds[t][1].texts[j]
            known[i, j] = (short_ratio if len(x) + len(y) <= 2 * SHORT else token_ratio)(x, y)
        return known[i, j]

    def score(self, i: int, j: int) -> float:
        scores = []
        for t, (x, y) in enumerate(self.kinds):
            if x.of[i] and y.of[j]:
                best = [max(self.ratio(t, v, w) for w in y.of[j]) for v in x.of[i]]
                scores.append(mean(best))
            elif x.of[i] or y.of[j]:
                scores.append(0.0)
        return mean(scores)

    def records(self, i: int, may: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """(set, score) of the sets of ``may``, in their order, that are more similar than
        all before, from ``least`` on."""
        own = self.bound[i]
        left = np.flatnonzero(may & (own + SLACK >= least))
        best, at = -1.0, 0
        while at < len(left):
            j = int(left[at])
            at += 1
            s = self.score(i, j)
            if s >= least and s > best:
                yield j, s
                best = s
                left, at = left[at:], 0
                left = left[own[left] + SLACK > best]
                if best >= 100.0:
                    return


class Side:
    """Sets of a block: for each type its distinct lists and each set's own, and when the
    set's alerts are, as (micros, alert_id)."""

    def __init__(self, rows: pa.StructArray, types: int):
        self.f = dict(zip([x.name for x in rows.type], rows.flatten()))
        self.n, self.lists, self.own = len(rows), [], []
        for t in range(types):
            d = self.f[f"t{t}"].dictionary_encode()
            self.lists.append([json.loads(v) for v in d.dictionary.to_pylist()])
            self.own.append(d.indices.to_numpy(zero_copy_only=False))
        self.rule = self.f["name_hash"]

    def when(self, name: str) -> list[tuple]:
        at = self.f[name]
        own = dict(zip([x.name for x in at.type], at.flatten()))
        return list(zip(own["ts"].cast(pa.int64()).to_pylist(), own["alert_id"].to_pylist()))

    def vals(self) -> list[list[list[str]]]:
        return [[lists[o[i]] for lists, o in zip(self.lists, self.own)] for i in range(self.n)]


def score_table(a: Side, b: Side) -> np.ndarray | None:
    """Scores in hundredths of all pairs of sets, -1 where neither has a value; None where
    there are too many distinct lists, or long values."""
    sizes = [(sum(map(len, x)) or 1) * (sum(map(len, y)) or 1) for x, y in zip(a.lists, b.lists)]
    if sum(sizes) * SHARED > a.n * b.n or any(len(v) > SHORT for s in (a, b) for x in s.lists for own in x for v in own):
        return None
    (ka, ia), (kb, ib) = (np.unique(np.stack(s.own), axis=1, return_inverse=True) for s in (a, b))
    total, present = np.zeros((ka.shape[1], kb.shape[1])), np.zeros((ka.shape[1], kb.shape[1]))
    for t, (x, y) in enumerate(zip(a.lists, b.lists)):
        x, y = ([tuple(map(sorted_tokens, own)) for own in own_lists] for own_lists in (x, y))
        table = np.array([[list_score(v, w) for w in y] for v in x])
        has = np.array([bool(v) for v in x])[:, None] | np.array([bool(w) for w in y])[None, :]
        at = np.ix_(ka[t], kb[t])
        total += table[at]
        present += has[at]
    scores = np.where(present > 0, hundredths(total / np.maximum(present, 1)), np.int16(-1))
    return scores[np.ix_(ia.ravel(), ib.ravel())]


def table_records(scores: np.ndarray, may: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that are higher than all before in their row."""
    need = int(least * 100) - 1
    while need / 100 < least:
        need += 1
    v = np.where(may & (scores >= max(need, 0)), scores, np.int16(-1))
    high = np.maximum.accumulate(v, axis=1)
    rec = v > np.concatenate([np.full((len(v), 1), -1, np.int16), high[:, :-1]], axis=1)
    return np.nonzero(rec)


def paired(a: pa.StructArray, b: pa.StructArray, types: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records of each set of ``a`` (name_hash, early and last alert, lists by type) among
    those of ``b`` (name_hash, first alert, lists): rows of ``a`` and of ``b``, and scores. Of
    the records before the early alert only the last is told."""
    a, b = Side(a, types), Side(b, types)
    firsts = b.when("first")
    order = np.array(sorted(range(b.n), key=firsts.__getitem__), np.int64)
    firsts = [firsts[j] for j in order]
    early, last = (np.array([bisect_left(firsts, w) for w in a.when(x)]) for x in ("early", "last"))
    rules = pa.chunked_array([a.rule, b.rule]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    rule_a, rule_b = rules[: a.n], rules[a.n :][order]
    table = score_table(a, b)
    rows, cols, scores = [], [], []
    if table is not None:
        step = max(1, CELLS // b.n)
        for i in range(0, a.n, step):
            some = slice(i, i + step)
            part = table[some][:, order]
            may = (rule_a[some, None] != rule_b[None, :]) & (np.arange(b.n)[None, :] < last[some, None])
            r, c = table_records(part, may, least)
            rows.append(r + i), cols.append(c), scores.append(part[r, c] / 100.0)
    else:
        theirs = b.vals()
        pairing = Pairing(a.vals(), [theirs[j] for j in order], types)
        for i in range(a.n):
            may = (rule_b != rule_a[i]) & (np.arange(b.n) < last[i])
            found = list(pairing.records(i, may, least))
            rows.append(np.full(len(found), i)), cols.append(np.array([j for j, _ in found], np.int64)), scores.append(np.array([x for _, x in found], np.float64))
    r, c, x = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, scores))
    r, c = r.astype(np.int64), c.astype(np.int64)
    # a record before the early alert counts unless the set's next one is before it too
    later = np.zeros(len(r), bool)
    later[:-1] = (r[1:] == r[:-1]) & (c[1:] < early[r[1:]])
    return r[~later], order[c[~later]], x[~later]


def matches(sets: DataFrame, types: int, least: float) -> DataFrame:
    """key, score and first (an earlier alert of another rule): the records of the sets that
    have a ``last``. ``sets``: window, key, name_hash, vals, first, early, last."""
    counts = sets.groupBy("window").agg(F.ceil(F.sum(F.greatest(F.lit(1), F.size(F.flatten("vals")))) / BLOCK).cast("int").alias("blocks"))
    dealt = sets.join(counts, "window").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    lists = [F.to_json(F.get("vals", F.lit(t))).alias(f"t{t}") for t in range(types)]
    a = dealt.filter("last is not null").groupBy("window", "blocks", "block").agg(F.collect_list(F.struct("key", "name_hash", "early", "last", *lists)).alias("a"))
    b = dealt.groupBy("window", "block").agg(F.collect_list(F.struct("name_hash", "first", *lists)).alias("b"))
    met = a.select("window", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(b, ["window", "block"])
    schema = StructType([StructField("key", StringType()), StructField("score", DoubleType()), StructField("first", sets.schema["first"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column(0)[i].values, batch.column(1)[i].values
                r, c, scores = paired(x, y, types, least)
                yield pa.RecordBatch.from_arrays([x.field("key").take(pa.array(r)), pa.array(scores, pa.float64()), y.field("first").take(pa.array(c))], ["key", "score", "first"])

    return met.select("a", "b").mapInArrow(run, schema)


def listed(df: DataFrame, name: str) -> Column:
    """The column's values as a list, without nulls."""
    c = F.col(name) if isinstance(df.schema[name].dataType, ArrayType) else F.array(name)
    return F.coalesce(F.filter(c, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def similar(fp: DataFrame, values: Sequence[str], left: DataFrame, threshold: float) -> DataFrame:
    """alert_id, verdict, score, matched_alert_id of the alerts whose alert_id is in ``left``:
    the most similar earlier alert of another rule of the same customer and window."""
    vals = F.transform(F.array(*[listed(fp, v) for v in sorted(values)]), lambda v: F.array_sort(v))
    window = F.sha2(F.to_json(F.struct("customer", "bucket")), 256).alias("window")
    own = fp.select("alert_id", "ts", window, "name_hash", vals.alias("vals"))
    own = own.withColumn("key", F.sha2(F.to_json(F.struct("window", "name_hash", "vals")), 256))
    own = written(own.join(left.select("alert_id", F.lit(True).alias("left")), "alert_id", "left"), "layer-two-alerts")
    at = F.struct("ts", "alert_id")
    sets = own.groupBy("window", "key", "name_hash", "vals").agg(F.min(at).alias("first"), F.min(F.when(F.col("left"), at)).alias("early"), F.max(F.when(F.col("left"), at)).alias("last"))
    found = matches(written(sets, "layer-two-sets"), len(values), threshold)
    met = own.filter("left").select("alert_id", "ts", "key").join(found, "key", "left")
    earlier = F.when(F.col("first") < F.struct("ts", "alert_id"), F.struct((-F.col("score")).alias("s"), F.col("first")))
    best = met.groupBy("alert_id").agg(F.min(earlier).alias("m"))
    return best.select("alert_id", F.when(F.col("m").isNull(), "NEW").otherwise("SIMILAR").alias("verdict"), F.coalesce(-F.col("m.s"), F.lit(0.0)).alias("score"), F.col("m.first.alert_id").alias("matched_alert_id"))
