"""Suffix dedup: repeated stretches of bytes, by a distributed merge sort of suffixes.

A byte is removed if a stretch of ``length`` (50) bytes that covers it also starts in a
document with a smaller doc_id. Suffixes are cut at that length, and only some can matter:

1. Anchors. In every stretch of ``length`` bytes the ``GRAM``-byte substring of the least
   hash is an anchor (ties: all of them), so equal stretches have equal anchors at equal
   places. Of the text's suffixes only those at anchors are sorted.
2. Anchors that occur in one document only can't match. Each run of documents sends its
   sorted anchor hashes as deltas; equal hashes of different documents meet in a bucket,
   and the run gets a bit for each of its hashes. Hash collisions cost work, not rows.
3. A run sorts the suffixes at its shared anchors, each followed by its left context,
   collapses equal ones to the least doc_id, and sends them front-coded.
4. A bucket merges the runs with a loser tree whose players keep the length of the prefix
   that they share with the last winner: of two players the one that shares more wins, and
   bytes are compared only beyond a shared length, so no known prefix is compared again.
   Neighbours with the anchor in common give, for each stretch around it, the least doc_id.
5. The answer goes back to the run, which marks the bytes of its documents.

An anchor with more than ``HOT_KEYS`` suffixes in all is hot (a gram that every document
has). Around it the suffixes at every place are sorted instead of the one at the anchor:
their buckets go by all ``length`` bytes, so a hot anchor is spread as its surroundings are.

Rows are dealt to runs once, by row, in a bucketed table; passes 2, 3 and 5 read it in place.
A bucket gets a copy's suffixes once a run, not once a copy, so a text that a third of all
documents share is no hot key; nothing is collected on the driver. A run has ``run_bytes``
(8 MB), or more where the blobs that runs and buckets exchange would fall below ``BLOB``
(1 KB) on average: run_bytes grows with the square root of the input, the number of blobs
in proportion to it.

Defined results: null and empty texts have no bytes; texts shorter than the length keep all;
rows of the same doc_id don't remove each other's bytes; a null doc_id counts as the
largest; repeated rows get the same result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

LENGTH, GRAM = 50, 20
RUN_BYTES, BLOB = 8_000_000, 1_000
HOT_KEYS = 200_000
HASH_BITS = 48
NO_ID = (1 << 63) - 1
_BYTES = np.random.Generator(np.random.PCG64(4242)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.Generator(np.random.PCG64(4243)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position, by doubling."""
    n = len(raw) - size + 1
    h, width, out, at, level = _BYTES[raw], 1, None, 0, 0
    while True:
        if size & width:
            part = h[at : at + n]
            out = part.copy() if out is None else out * _STEPS[32 + level] + part
            at += width
        if width * 2 > size:
            return wordhash.mix(out)
        h = h[:-width] * _STEPS[level] + h[width:]
        width, level = width * 2, level + 1


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` neighbours."""
    done, m = 1, x
    while done * 2 <= width:
        m = f(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return f(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one document's anchors."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw, gram)
    w = length - gram + 1
    least = sliding(h, w, np.minimum)  # of the stretch from each position
    pad = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), w, np.maximum)  # of stretches that hold the gram
    at = np.flatnonzero(h == most)
    return at, wordhash.mix(h[at]) >> np.uint64(64 - HASH_BITS)  # least hashes aren't even; their mix is


class Run:
    """A run's documents as one array, and their anchors."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int, gram: int):
        self.length, self.gram, self.ids = length, gram, ids
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        at, hashes, doc = [], [], []
        for d in range(len(texts)):
            a, h = anchors(self.raw[self.first[d] : self.first[d + 1]], length, gram)
            at.append(a + self.first[d])
            hashes.append(h)
            doc.append(np.full(len(a), d))
        empty = np.zeros(0, np.int64)
        self.at = np.concatenate([empty, *at])
        self.hash = np.concatenate([empty.astype(np.uint64), *hashes])
        self.doc = np.concatenate([empty, *doc])

    def distinct_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes, how many anchors each has (as ``weight`` codes it) and
        each anchor's place among them."""
        order = np.argsort(self.hash, kind="stable")
        h = self.hash[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        if not len(h):
            return h, np.zeros(0, np.uint8), place
        ids = self.ids[self.doc[order]]
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        return h[start], weight(np.diff(np.append(start, len(h))), several), place

    def keys_of(self, at: np.ndarray, doc: np.ndarray, left: int) -> np.ndarray:
        """A row for each place: the suffix, padded to the length, its true length, ``left``
        bytes of context read backward, padded to the left width, and its true length."""
        room = self.length - self.gram
        right_n = np.minimum(self.first[doc + 1] - at, self.length)
        left_n = np.minimum(at - self.first[doc], left)
        keys = np.zeros((len(at), self.length + room + 2), np.uint8)
        ahead, back = np.arange(self.length), np.arange(1, room + 1)
        for c in range(0, len(at), 8192):  # the index matrices are eight times the keys
            s = slice(c, c + 8192)
            keys[s, : self.length] = np.where(ahead < right_n[s, None], self.raw[np.minimum(at[s, None] + ahead, len(self.raw) - 1)], 0)
            keys[s, self.length + 1 : -1] = np.where(back <= left_n[s, None], self.raw[np.maximum(at[s, None] - back, 0)], 0)
        keys[:, self.length], keys[:, -1] = right_n, left_n
        return keys

    def stretches(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of all stretches around the anchors ``chosen``, and their documents."""
        at, doc = self.at[chosen], self.doc[chosen]
        steps = np.arange(self.length - self.gram + 1)
        start = at[:, None] - steps
        fits = (start >= self.first[doc][:, None]) & (start + self.length <= self.first[doc + 1][:, None])
        i, step = np.nonzero(fits)
        start, which = np.unique(at[i] - step, return_index=True)
        return start, doc[i[which]]

    def suffixes(self, chosen: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys to sort: of the anchors ``chosen``, and of the stretches around those that are
        ``hot``. Sorted distinct keys by bucket, their least doc_id, their bucket, and the key
        of each place asked for (anchors first, then stretches)."""
        start, start_doc = self.stretches(hot)
        doc = np.concatenate([self.doc[chosen], start_doc])
        keys = np.concatenate([self.keys_of(self.at[chosen], self.doc[chosen], self.length - self.gram), self.keys_of(start, start_doc, 0)])
        h = np.concatenate([self.hash[chosen], wordhash.mix(gram_hashes(self.raw, self.length)[start]) >> np.uint64(64 - HASH_BITS) if len(start) else np.zeros(0, np.uint64)])
        bucket = bucket_of(h, buckets)
        # the bucket leads the order, big end first
        order = np.argsort(np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), keys], axis=1).view(f"S{keys.shape[1] + 4}").ravel(), kind="stable")
        keys, bucket = keys[order], bucket[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1])]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[doc[order]], first) if len(first) else np.zeros(0, np.int64)
        return keys[first], least, bucket[first], place


def weight(n: np.ndarray, several: np.ndarray) -> np.ndarray:
    """A count as a power of two, rounded up, and whether several documents share in it."""
    return (np.ceil(np.log2(n)).astype(np.uint8) << 1) | several.astype(np.uint8)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed_hashes(h: np.ndarray, weights: np.ndarray) -> bytes:
    """Sorted hashes as deltas of 4 bytes where they fit, and the weights."""
    d = np.diff(h, prepend=np.uint64(0))
    short = len(d) < 2 or int(d[1:].max()) < 1 << 32
    head = np.array([len(h), int(short), int(h[0])], np.uint64).tobytes()
    return head + (d[1:].astype(np.uint32) if short else d[1:]).tobytes() + zlib.compress(weights.tobytes(), 1)


def unpacked_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, short, first = np.frombuffer(blob, np.uint64, 3)
    kind = np.uint32 if short else np.uint64
    d = np.frombuffer(blob, kind, int(n) - 1, 24).astype(np.uint64)
    weights = np.frombuffer(zlib.decompress(blob[24 + (int(n) - 1) * np.dtype(kind).itemsize :]), np.uint8)
    return np.cumsum(np.concatenate([[first], d]).astype(np.uint64), dtype=np.uint64), weights


def front_coded(keys: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted keys: shared prefix lengths, then what each adds; and the doc_ids."""
    import zstandard

    n, width = keys.shape
    same = keys[1:] == keys[:-1]
    shared = np.concatenate([[0], np.where(same.all(axis=1), width, (~same).argmax(axis=1))]).astype(np.uint8)
    tails = keys[np.arange(width)[None, :] >= shared[:, None]]
    raw = np.array([n, width, len(tails)], np.int64).tobytes() + shared.tobytes() + least.astype(np.int64).tobytes() + tails.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def front_decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, shared prefix lengths, doc_ids."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width, n_tails = np.frombuffer(raw, np.int64, 3)
    shared = np.frombuffer(raw, np.uint8, n, 24)
    least = np.frombuffer(raw[24 + n : 24 + 9 * n], np.int64)
    keys = np.zeros((n, width), np.uint8)
    own = np.arange(width)[None, :] >= shared[:, None]
    keys[own] = np.frombuffer(raw, np.uint8, n_tails, 24 + 9 * n)
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(keys, source, axis=0), shared, least


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``; the keys have one width."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge of sorted runs (keys, prefix shared with the key before). Returns for
    each output the run, its place there, and the prefix shared with the output before.

    A player's shared length is to the last output. The longer one wins; at equal lengths
    the keys are compared from there on, and the loser's length to the winner is noted."""
    players = 1
    while players < len(runs):
        players *= 2
    total = sum(len(k) for k, _ in runs)
    keys: list = [k[0] if k else None for k, _ in runs] + [None] * (players - len(runs))
    shared = [0] * players
    place = [0] * players
    tree = [0] * players  # losers; the root's winner is kept apart

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); ties go to the first."""
        a, b = keys[i], keys[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        p, q = shared[i], shared[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        n = shared_prefix(a, b, p)
        if n == len(a) or a[n] < b[n]:
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    level = list(range(players))
    at = players
    while at > 1:
        at //= 2
        ahead = []
        for k in range(at):
            w, tree[at + k] = play(level[2 * k], level[2 * k + 1])
            ahead.append(w)
        level = ahead
    winner = level[0]
    out_run, out_place, out_shared = [], [], []
    for _ in range(total):
        w = winner
        out_run.append(w)
        out_place.append(place[w])
        out_shared.append(shared[w])
        own, prefix = runs[w]
        i = place[w] = place[w] + 1
        if i < len(own):
            keys[w], shared[w] = own[i], prefix[i]
        else:
            keys[w] = None
        node = (players + w) >> 1
        while node:
            j = tree[node]
            b = keys[j]
            if b is not None:  # play(), written out for the hot loop
                a = keys[w]
                if a is None:
                    tree[node], w = w, j
                else:
                    p, q = shared[w], shared[j]
                    if p < q:
                        tree[node], w = w, j
                    elif p == q:
                        n = shared_prefix(a, b, p)
                        if n == len(a) or a[n] < b[n]:
                            shared[j] = n
                        else:
                            shared[w] = n
                            tree[node], w = w, j
            node >>= 1
        winner = w
    return out_run, out_place, out_shared


def answers(keys: np.ndarray, ids: np.ndarray, shared: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key in merged order, the least doc_id of the stretch that starts 0, 1, ...
    bytes left of the anchor. ``one``: that id where it is the same for all, else -1 - row of
    ``many``. Keys are grouped by the anchor."""
    left = length - gram
    width = keys.shape[1]
    start = np.flatnonzero(np.concatenate([[True], shared[1:] < gram]))
    size = np.diff(np.append(start, len(keys)))
    group = np.repeat(np.arange(len(start)), size)
    alike = np.minimum.reduceat(np.concatenate([[width], shared[1:]]) + (np.arange(len(keys)) == start[group]) * width, start) >= width
    one = np.minimum.reduceat(ids, start)[group]
    odd = np.flatnonzero(~alike[group])
    if not len(odd):
        return one, np.zeros((0, left + 1), np.int64)
    place = np.full(len(keys), -1)
    place[odd] = np.arange(len(odd))
    one = one.copy()
    one[odd] = -1 - np.arange(len(odd))
    many = np.repeat(ids[odd][:, None], left + 1, axis=1)
    steps = np.arange(left + 1)
    large = size[group] > 8
    small = odd[~large[odd]]
    for k in range(1, 8):  # pairs k apart in a small group
        i = small[(small + k < len(keys))]
        i = i[group[i] == group[np.minimum(i + k, len(keys) - 1)]]
        if not len(i):
            continue
        j = i + k
        same = keys[i] == keys[j]
        right_n = np.minimum(np.where(same[:, :length].all(axis=1), length, (~same[:, :length]).argmax(axis=1)), np.minimum(keys[i, length], keys[j, length]))
        back = same[:, length + 1 : -1]
        left_n = np.minimum(np.where(back.all(axis=1), left, (~back).argmax(axis=1)), np.minimum(keys[i, -1], keys[j, -1]))
        meet = (steps <= left_n[:, None]) & (length - steps <= right_n[:, None])
        many[place[i]] = np.where(meet, np.minimum(many[place[i]], ids[j][:, None]), many[place[i]])
        many[place[j]] = np.where(meet, np.minimum(many[place[j]], ids[i][:, None]), many[place[j]])
    big = odd[large[odd]]
    for step in steps if len(big) else ():
        fits = (keys[big, -1] >= step) & (keys[big, length] >= length - step)
        rows = big[fits]
        if not len(rows):
            continue
        stretch = np.concatenate([keys[rows, length + 1 : length + 1 + step], keys[rows, : length - step]], axis=1)
        order = np.argsort(np.ascontiguousarray(stretch).view(f"S{length}").ravel(), kind="stable")
        s = stretch[order]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)]))
        low = np.repeat(np.minimum.reduceat(ids[rows[order]], first), np.diff(np.append(first, len(rows))))
        many[place[rows[order]], step] = low
    return one, many


# Spark


def _run_of(pdf: pd.DataFrame, length: int, gram: int) -> Run:
    return Run(pdf["d"].to_numpy(np.int64), list(pdf["t"]), length, gram)


def _chosen(run: Run, replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The anchors whose hash several documents have, from the buckets' bits in order: those
    that aren't hot, and those that are."""
    h, _, place = run.distinct_hashes()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[: 2 * n].reshape(2, n) for _, n, b in sorted(zip(replies["bucket"], replies["n"], replies["blob"]), key=lambda x: x[0])], axis=1).astype(bool)
    shared, hot = bits[0][place], bits[1][place]
    return np.flatnonzero(shared & ~hot), np.flatnonzero(shared & hot)


def _by_bucket(b: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
    return [(int(b[i]), int(i), int(j)) for i, j in zip(edge[:-1], edge[1:])]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, hot_keys: int = HOT_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row, from a stored table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(common.text_bytes(text_col), F.lit(b"")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_runs = max(parts, -(-total // max(run_bytes, math.isqrt(BLOB * total))))
    rows = rows.select(F.pmod(F.xxhash64("rid"), F.lit(n_runs)).cast("int").alias("run"), F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(NO_ID)).alias("d"), "t")
    name, limit = f"suffix_{uuid.uuid4().hex}", "spark.sql.sources.bucketing.maxBuckets"
    path = f"{common.shared_dir(spark)}/llm/{name}"
    was = spark.conf.get(limit)
    try:
        spark.conf.set(limit, max(n_runs, int(was)))
        rows.repartition(n_runs, "run").write.option("compression", "zstd").bucketBy(n_runs, "run").option("path", path).saveAsTable(name)
        found = common.written(_marked(spark.table(name), n_runs, length, gram, hot_keys), "suffix-found")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # from the catalog; its files are external
        spark.conf.set(limit, was)
    return found.select(F.when(~F.col("none"), F.col("d")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _marked(texts: DataFrame, buckets: int, length: int, gram: int, hot_keys: int) -> DataFrame:
    """d, none, n_bytes, n_removed, n_spans, kept_sha256. texts: run, none, d, t."""

    def send_hashes(pdf: pd.DataFrame) -> pd.DataFrame:
        h, weights, _ = _run_of(pdf, length, gram).distinct_hashes()
        cut = _by_bucket(bucket_of(h, buckets))
        return pd.DataFrame({"bucket": [b for b, _, _ in cut], "run": int(pdf["run"].iloc[0]), "blob": [packed_hashes(h[i:j], weights[i:j]) for _, i, j in cut]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked_hashes(b) for b in pdf["blob"]]
        h, weights = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h, kind="stable")
        s, w = h[order], weights[order]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        shared = (size > 1) | (np.maximum.reduceat(w & 1, start) > 0)
        hot = np.add.reduceat(2.0 ** (w >> 1), start) > hot_keys
        bits = np.empty((2, len(h)), bool)
        bits[:, order] = np.repeat(np.stack([shared, hot]), size, axis=1)
        cut = np.cumsum([0, *[len(g[0]) for g in got]])
        return pd.DataFrame({"run": pdf["run"], "bucket": pdf["bucket"], "n": [len(g[0]) for g in got], "blob": [np.packbits(bits[:, a:b].ravel()).tobytes() for a, b in zip(cut, cut[1:])]})

    sent = texts.groupBy("run").applyInPandas(send_hashes, "bucket int, run int, blob binary")
    bits = common.written(sent.groupBy("bucket").applyInPandas(meet, "run int, bucket int, n int, blob binary"), "suffix-bits")

    def send_suffixes(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"bucket": [], "run": [], "blob": []})
        run = _run_of(pdf, length, gram)
        keys, least, bucket, _ = run.suffixes(*_chosen(run, replies), buckets)
        cut = _by_bucket(bucket)
        return pd.DataFrame({"bucket": [b for b, _, _ in cut], "run": int(pdf["run"].iloc[0]), "blob": [front_coded(keys[i:j], least[i:j]) for _, i, j in cut]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [front_decoded(b) for b in pdf["blob"]]
        width = got[0][0].shape[1]
        runs = []
        for keys, shared, _ in got:
            raw = keys.tobytes()
            runs.append(([raw[i : i + width] for i in range(0, len(raw), width)], shared.tolist()))
        which, place, shared = (np.array(x, np.int64) for x in merged(runs))
        cut = np.cumsum([0, *[len(g[0]) for g in got]])
        at = cut[which] + place
        one, many = answers(np.concatenate([g[0] for g in got])[at], np.concatenate([g[2] for g in got])[at], shared, length, gram)
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        out = []
        for a, b in zip(cut, cut[1:]):
            own = one[back[a:b]]
            odd = own < 0
            extra = many[-1 - own[odd]]
            own = own.copy()
            own[odd] = -1 - np.arange(int(odd.sum()))
            out.append(own.astype(np.int64).tobytes() + extra.astype(np.int64).tobytes())
        import zstandard

        return pd.DataFrame({"run": pdf["run"], "bucket": pdf["bucket"] + buckets, "n": [len(g[0]) for g in got], "blob": [zstandard.ZstdCompressor(level=1).compress(b) for b in out]})

    sent = texts.groupBy("run").cogroup(bits.groupBy("run")).applyInPandas(send_suffixes, "bucket int, run int, blob binary")
    told = common.written(sent.groupBy("bucket").applyInPandas(merge, "run int, bucket int, n int, blob binary"), "suffix-answers")

    def apply(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("d", "none", "n_bytes", "n_removed", "n_spans", "kept_sha256")})
        run = _run_of(pdf, length, gram)
        chosen, hot = _chosen(run, replies[replies["bucket"] < buckets])
        _, _, _, place = run.suffixes(chosen, hot, buckets)
        mine = replies[replies["bucket"] >= buckets].sort_values("bucket")
        one, many, upto = [np.zeros(0, np.int64)], [np.zeros((0, length - gram + 1), np.int64)], 0
        for n, blob in zip(mine["n"], mine["blob"]):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
            own = raw[:n].copy()
            own[own < 0] -= upto
            one.append(own)
            many.append(raw[n:].reshape(-1, length - gram + 1))
            upto += len(many[-1])
        one, many = np.concatenate(one), np.concatenate(many)
        at, doc = run.at[chosen], run.doc[chosen]
        low = np.maximum(0, length - (run.first[doc + 1] - at))
        high = np.minimum(length - gram, at - run.first[doc])
        told_ = one[place[: len(chosen)]]
        start, start_doc = run.stretches(hot)
        place_hot = place[len(chosen) :]
        ids = run.ids[doc]
        change = np.zeros(len(run.raw) + 1, np.int32)
        whole = (told_ >= 0) & (told_ < ids) & (low <= high)
        np.add.at(change, at[whole] - high[whole], 1)
        np.add.at(change, at[whole] - low[whole] + length, -1)
        part = np.flatnonzero(told_ < 0)
        if len(part):
            steps = np.arange(length - gram + 1)
            hit = (many[-1 - told_[part]] < ids[part][:, None]) & (steps >= low[part][:, None]) & (steps <= high[part][:, None])
            i, step = np.nonzero(hit)
            np.add.at(change, at[part[i]] - step, 1)
            np.add.at(change, at[part[i]] - step + length, -1)
        if len(start):
            # a stretch's key has no left context, so its answer is that of step 0
            own = one[place_hot]
            own = np.where(own >= 0, own, many[np.where(own < 0, -1 - own, 0), 0]) if len(many) else own
            cut_ = start[own < run.ids[start_doc]]
            np.add.at(change, cut_, 1)
            np.add.at(change, cut_ + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for d in range(len(pdf)):
            a, b = run.first[d], run.first[d + 1]
            g = gone[a:b]
            kept = run.raw[a:b][~g].tobytes() if g.any() else run.raw[a:b].tobytes()
            out.append((int(b - a), int(g.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], g.view(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(d=pdf["d"].to_numpy(), none=pdf["none"].to_numpy())

    back = bits.unionAll(told)
    return texts.groupBy("run").cogroup(back.groupBy("run")).applyInPandas(apply, "d bigint, none boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
