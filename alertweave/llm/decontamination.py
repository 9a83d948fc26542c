"""Benchmark decontamination by an FM-index for each shard of the corpus.

A shard is a stretch of documents within one task. Its words become symbols (words that no
benchmark item has become separators), and only runs of symbols at least as long as the
shortest window can hold an occurrence, so the other positions are left out of the index;
nothing that could match is. Windows are searched backward through wavelet-matrix ranks,
all windows of a length at once; occurrences are located from sampled suffix positions and
merged to removal spans.

The benchmark is a stated query set: it is taken in blocks of bounded bytes, each block
going to the executors with the task; every few blocks the state is written, so that a task
never has more than ``CHAIN`` workers. Documents are never shuffled.

Defined results: null and empty texts have no words and are clean; items without words have
no windows; a null item_id is called "null"; repeated documents are judged each, repeated
item_ids count as one item; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark text that one pass over the documents takes, and words of a shard.
BLOCK_BYTES, SHARD_WORDS = 8_000_000, 1_500_000
#: Blocks that follow one another within a stage, each with a worker; then a table is written.
CHAIN = 4
#: Every so many positions of a shard keep their suffix position.
SAMPLE = 8


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; an item of fewer words, but not none, is one window."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or [tuple(words)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the least and unique."""
    n, width = len(text), 1
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(text[order]) != 0)])
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        width *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbol at a time from the highest."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
            zeros = len(seq) - int(before[-1])
            self.levels.append((bit, before, zeros))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low, high = np.zeros_like(at), at
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = before[low], before[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: symbols from 2 up, 1 between runs; a final 0 is added here."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.sampled = order % SAMPLE == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.ranks.rank(symbol, at)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, its interval of suffixes (empty: both ends equal)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for c in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, c]
            low[live], high[live] = self.step(s, low[live]), self.step(s, high[live])
            dead = high[live] <= low[live]
            high[live[dead]] = low[live[dead]]
            live = live[~dead]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[at])
        while len(walking):
            at[walking] = self.step(self.bwt[at[walking]], at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled[at[walking]]]
        return self.samples[self.sample_no[at]] + steps


class Patterns:
    """A benchmark block's windows as symbols."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            for w in item_windows(words_of(text), size):
                owners.setdefault(w, set()).add(name)
        self.symbol = {w: i + 2 for i, w in enumerate(sorted({x for w in owners for x in w}))}
        self.by_length: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]] = {}
        for n in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == n]
            self.by_length[n] = (np.array([[self.symbol[x] for x in w] for w in own], np.int64), [tuple(sorted(owners[w])) for w in own])
        self.shortest = min(self.by_length, default=0)


def scan_shard(texts: list[list[bytes]], patterns: Patterns) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Removal spans (first word, end) and items of each document."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    get = patterns.symbol.get
    symbols = np.fromiter((s for ws in texts for s in (*[get(w, 1) for w in ws], 1)), np.int64)
    ends = np.cumsum([len(ws) + 1 for ws in texts])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (symbols > 1).astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= max(1, patterns.shortest)
    first, last = first[long], last[long]
    if not len(first):
        return spans, items
    sizes = last - first + 1  # with one separator each
    place = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    text = symbols[place]
    text[np.cumsum(sizes) - 1] = 1
    index = FMIndex(text, len(patterns.symbol) + 2)
    cover = np.zeros(len(symbols) + 1, np.int64)
    found: set[tuple[int, tuple[str, ...]]] = set()
    for n, (rows, owners) in patterns.by_length.items():
        low, high = index.search(rows)
        for at in np.array_split(np.flatnonzero(high > low), max(1, int((high - low).sum()) // 2_000_000)):
            times = high[at] - low[at]
            if not len(at):
                continue
            which = np.repeat(at, times)
            hits = np.repeat(low[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            where = place[index.locate(hits)]
            np.add.at(cover, where, 1)
            np.add.at(cover, where + n, -1)
            pairs = np.unique(np.searchsorted(ends, where, "right") * len(rows) + which)
            found.update((int(p // len(rows)), owners[p % len(rows)]) for p in pairs)
    for d, names in found:
        items[d].update(names)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])))
    starts = ends - [len(ws) + 1 for ws in texts]
    for a, b in zip(edge[::2], edge[1::2]):
        d = int(np.searchsorted(ends, a, "right"))
        spans[d].append((int(a - starts[d]), int(b - starts[d])))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """For each document: n_words, spans (merged removal spans in words, end exclusive),
    items (sorted ids of items with occurring windows). ``carry`` names further columns of
    ``docs`` to keep."""
    keep = carry or []
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), common.text_bytes(item_text_col).alias("t")).filter("t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = tuple(f"c{i}" for i in range(len(keep)))
    out = docs.select(F.col(id_col).alias("id"), common.text_bytes(text_col).alias("t"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("n"), *[common.column(c).alias(n) for n, c in zip(names, keep)])
    schema = common.schema_of(("id", docs.schema[id_col].dataType), "t binary, spans array<struct<first:bigint,end:bigint>>, items array<string>, n bigint")

    def pass_of(items: list[tuple[str, bytes]], final: bool):
        def rows(parts: Iterator[dict]) -> Iterator[dict]:
            patterns = Patterns(items, window)
            for p in parts:
                texts = [words_of(t) for t in p["t"]]
                spans: list = [[(s["first"], s["end"]) for s in x] for x in p["spans"]]
                named = [set(x) for x in p["items"]]
                at = 0
                while at < len(texts):
                    upto, size = at, 0
                    while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SHARD_WORDS):
                        size += len(texts[upto])
                        upto += 1
                    for d, (s, i) in enumerate(zip(*scan_shard(texts[at:upto], patterns)), at):
                        spans[d] += s
                        named[d] |= i
                    at = upto
                yield p | {"n": [len(x) for x in texts], "spans": [[{"first": a, "end": b} for a, b in merged(s)] for s in spans], "items": [sorted(x) for x in named]} | ({"t": [None] * len(texts)} if final else {})

        return rows

    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.hash("i", "t"), F.lit(blocks)) == b)
        items = [(r.i, bytes(r.t)) for r in part.toLocalIterator()]
        out = common.map_rows(out, pass_of(items, b == blocks - 1), schema, batch=4000, keep=names)
        if b % CHAIN == CHAIN - 1 and b < blocks - 1:
            out = common.written(out, "contamination")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "spans", "items", *[F.col(n).alias(c) for n, c in zip(names, keep)])


def judged(found: DataFrame) -> DataFrame:
    """Adds the digest columns and the verdict: at least a twentieth of the words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
