"""Phrase collocation mining by level-wise counting with hashed buckets (PCY, DHP).

Pass k reads all texts and counts the phrases of k words exactly, but only those that can
reach ``least``: both phrases of k-1 words inside must be frequent (Apriori, by a bitmap of
the hashes of what the pass before counted), and so must be the phrase's bucket. While it
counts, a pass throws the phrases of k+1 words into hashed buckets, if both their parts may
be frequent; buckets of ``least`` or more make the bitmap of the next pass. Bitmaps have
``buckets`` bits whatever the input, so they are what is broadcast. A phrase that a bitmap
lets through by collision is counted and then dropped, so counts are exact and none is lost.

Each task counts a few MB of text at a time with numpy; partial counts of a phrase meet in a
grouped sum by (lang, phrase), after a partial sum in the task, so the most frequent phrase
costs a row a task. Buckets are clipped at ``least`` before they leave a task, which can't
change which of them reach it, and are summed by stretches of ``CHUNK`` of them.

A phrase's score is 1000 a n / (l r), floored, in decimals of 38 digits, the least over its
cuts. A candidate inside a longer candidate that is as frequent goes; since a phrase is at
most as frequent as its parts, longer by one word is enough to look at.

At 100 TB raise ``buckets`` to 1 << 27 (16 MB of bits, 128 MB a task) and ``least`` with the
corpus; fewer bits prune less and stay right.

Defined results: null and empty texts have no words; a null lang is ``und``; repeated rows
count each; ties go to the phrase in byte order, so ranks are unique; a lang without
candidates has no row; an empty table gives an empty table; other columns are ignored. Words
of a few MB are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, wordhash

#: Bytes of text that are counted at once, and buckets in a row of partial sums.
TEXT_BYTES, CHUNK = 4_000_000, 1 << 13
#: Bytes that end a piece, and those between words.
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK[[0x20, 0x09]] = True
_TIMES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some texts: where they stand, in which piece, and their hashes, which
    the lang has a part in."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.bytes = b"\n".join(texts).lower() + b"\n"
        raw = np.frombuffer(self.bytes, np.uint8)
        apart = BREAK[raw] | BLANK[raw]
        self.starts, self.ends = wordhash.words(raw, BREAK | BLANK)
        self.piece = np.cumsum(BREAK[raw])[self.starts]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        self.langs = langs
        seeds = {v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") for v in set(langs)}
        salt = np.array([seeds[v] for v in langs], np.uint64)
        self.hashes = wordhash.mix(wordhash.word_hashes(raw, self.starts, self.ends, apart) ^ salt[self.text]) if len(self.starts) else np.zeros(0, np.uint64)

    def within(self, k: int) -> np.ndarray:
        """Whether k words from each word on are of one piece."""
        out = np.zeros(len(self.starts), bool)
        m = max(0, len(out) - k + 1)
        out[:m] = self.piece[k - 1 : k - 1 + m] == self.piece[:m]
        return out

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on."""
        out = np.zeros(len(self.starts), np.uint64)
        m = max(0, len(out) - k + 1)
        for j in range(k):
            out[:m] += self.hashes[j : j + m] * _TIMES[j]
        return wordhash.mix(out)

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.bytes[self.starts[at] : self.ends[at + k - 1]].split()).decode()


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set; the number of bits is a power of two."""
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def following(flags: np.ndarray) -> np.ndarray:
    """The flag of the next word."""
    return np.append(flags[1:], False) if len(flags) else flags


def in_stretches(parts: Iterator[dict]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and langs of at most ``TEXT_BYTES`` together, or of one longer text."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for p in parts:
        for t, lang in zip(p["text"], p["lang"]):
            if texts and size + len(t) > TEXT_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
            texts.append(t)
            langs.append(lang)
            size += len(t) + 1
    if texts:
        yield texts, langs


def chunks(counts: np.ndarray) -> dict:
    """Rows of the chunks of ``counts`` that are not all zero."""
    parts = counts.reshape(-1, CHUNK)
    at = np.flatnonzero(parts.any(axis=1))
    return {"lang": [None] * len(at), "phrase": [None] * len(at), "n": [0] * len(at), "chunk": at.tolist(), "counts": [parts[i].tobytes() for i in at]}


SCHEMA = "lang string, phrase string, n bigint, chunk int, counts binary"


def counted(texts: DataFrame, k: int, longest: int, least: int, buckets: int, frequent, full) -> DataFrame:
    """One pass: partial counts of the phrases of k words that may be frequent, and bucket
    counts of those of k+1. ``frequent`` and ``full`` are broadcast bitmaps: of the frequent
    phrases of k-1 words and of the buckets of those of k words."""
    kind = np.min_scalar_type(least)

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        sums = np.zeros(buckets if k < longest else 0, np.int32)
        for some, langs in in_stretches(parts):
            w = Words(some, langs)
            can = w.within(k)
            if k > 1:
                shorter = has(frequent.value, w.grams(k - 1))
                own = w.grams(k)
                can &= shorter & following(shorter) & has(full.value, own)
            else:
                own = w.grams(1)
            at = np.flatnonzero(can)
            _, first, n = np.unique(own[at], return_index=True, return_counts=True)
            reps = at[first]
            out_lang = [w.langs[w.text[i]] for i in reps]
            phrases = [w.phrase(i, k) for i in reps]
            if k == 1:  # how many words each lang has
                per = np.bincount(w.text, minlength=len(some))
                for lang in set(langs):
                    out_lang.append(lang)
                    phrases.append(None)
                    n = np.append(n, per[[x == lang for x in langs]].sum())
            yield {"lang": out_lang, "phrase": phrases, "n": n.tolist(), "chunk": [None] * len(phrases), "counts": [None] * len(phrases)}
            if k < longest:
                next_up = can & following(can) & w.within(k + 1)
                hit = (w.grams(k + 1)[next_up] & np.uint64(buckets - 1)).astype(np.int64)
                seen, times = np.unique(hit, return_counts=True)
                sums[seen] = np.minimum(sums[seen] + times, least)
        if k < longest:
            yield chunks(sums.astype(kind))

    return common.map_rows(texts, rows, SCHEMA, batch=500)


def bitmap(rows: DataFrame, least: int, buckets: int) -> np.ndarray:
    """Bits of the buckets whose counts come to ``least``, from rows of chunk and counts. Of
    a chunk only a running sum is held; what the driver gets are ``buckets`` bits."""
    kind = np.min_scalar_type(least)

    def summed(parts: Iterator[dict]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for p in parts:
            for c, raw in zip(p["chunk"], p["counts"]):
                own = sums.setdefault(c, np.zeros(CHUNK, np.int64))
                np.minimum(own + np.frombuffer(raw, kind), least, out=own)
        yield {"chunk": list(sums), "bits": [np.packbits(s >= least, bitorder="little").tobytes() for s in sums.values()]}

    dealt = rows.select("chunk", "counts").filter("chunk is not null").repartition("chunk")
    out = np.zeros(buckets // 8, np.uint8)
    for r in common.map_rows(dealt, summed, "chunk int, bits binary", batch=500).collect():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def bits_of(phrases: DataFrame, k: int, buckets: int) -> np.ndarray:
    """The bitmap of the hashes of phrases of k words."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        found = np.zeros(buckets, np.uint8)
        for some, langs in in_stretches(parts):
            w = Words(some, langs)
            first = np.append(True, w.text[1:] != w.text[:-1])
            found[w.grams(k)[first] & np.uint64(buckets - 1)] = 1
        yield chunks(found)

    return bitmap(common.map_rows(phrases.select("lang", F.col("phrase").cast("binary").alias("text")), rows, SCHEMA, batch=500), 1, buckets)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, buckets: int = 1 << 23, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k and n of all phrases of up to ``longest`` words that occur ``least``
    times in a lang, and lang and n of the words of each lang."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(common.column(text_col), F.lit("")).cast("binary").alias("text")
    texts = docs.select(text, F.coalesce(common.column(lang_col), F.lit("und")).alias("lang"))
    levels: list[DataFrame] = []
    totals = frequent = full = None
    for k in range(1, longest + 1):
        found = common.written(counted(texts, k, longest, least, buckets, frequent, full), f"phrases-{k}")
        sums = found.filter("chunk is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        own = common.written(sums.filter((F.col("n") >= least) | F.col("phrase").isNull()).withColumn("k", F.lit(k)), f"frequent-{k}")
        totals = own.filter("phrase is null").select("lang", F.col("n").alias("words")) if k == 1 else totals
        own = own.filter("phrase is not null")
        if own.isEmpty() and k > 1:
            break
        levels.append(own)
        if k < longest:
            frequent = spark.sparkContext.broadcast(bits_of(own, k, buckets))
            full = spark.sparkContext.broadcast(bitmap(found, least, buckets))
    every = levels[0]
    for own in levels[1:]:
        every = every.unionByName(own)
    return every, totals


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, cover: int = 100, buckets: int = 1 << 23, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first ``top`` candidates that
    no longer candidate covers (``cover`` percent of a)."""
    every, totals = frequent_phrases(docs, longest, least, buckets, text_col, lang_col)
    cand = every.filter("k >= 2")
    words = F.split("phrase", " ", -1)
    part = lambda at, size: F.array_join(F.slice(words, at, size), " ")
    cuts = cand.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("cut")), "right": part(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    of = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.join(common.small(totals, totals.count()), "lang")
    exact = "cast(a as decimal(19,0)) * cast(words as decimal(19,0)) * 1000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    least_cut = F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r", "words")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut)
    longer = cand.filter("k >= 3").withColumn("phrase", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))))
    covering = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = scored.join(covering, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    out = kept.select("lang", "phrase", "a", "c.l", "c.r", F.col("c.words").alias("n"), "c.score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = out.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
