"""MinHash near-dedup with sequential Bayesian verification.

Documents are compared as sets of five-word shingles (A-Z lowered). Equal sets form a class,
so copies are never paired. A class has a signature of 384 minhashes: 192 of them, in 32
bands of 6, make candidates, and 8 bits of each verify them. Candidates are pruned a batch of hashes at a time:
when the posterior chance that their similarity reaches the threshold (uniform prior) falls
below ``miss``, they go. Survivors are verified on their full shingle sets.

No bucket's pairs are all emitted. First each class is tried against the most connected
class of each bucket that it is in, which joins a group of near copies through its centre.
Then connected components are formed. A bucket whose members are still in different
components goes to tasks as blocks of up to ``BLOCK`` members and pairs of such blocks;
there the batches of hashes prune pairs of different components, and only survivors leave,
each from the first bucket that the pair shares. Classes of up to ``SMALL`` shingles carry
them all (32 bits each) to these blocks, so their pairs leave only if the sets agree.
A pair at the threshold shares no bucket with chance (1 - 0.85^6)^32 = 3e-7, at 0.9 with
less than 1e-9. No partners are capped.

Defined results: without words (null, empty, white space) a document is its own component;
fewer words than five are one shingle; a null doc_id never becomes a component's id unless
all its members' are null; a row is kept if its doc_id is the component's; repeated rows,
and rows of one doc_id with several texts, are rows each and get their own result; other columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

SIZE = 5
BANDS, ROWS = 32, 6
BANDED = BANDS * ROWS
HASHES = 2 * BANDED
BATCH = 32
BLOCK = 2048
SMALL = 256
_RANDOM = np.random.Generator(np.random.PCG64(77))
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ROW_TIMES = _RANDOM.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE_TIMES = _RANDOM.integers(0, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = wordhash.joined([t.lower() if t else t for t in texts])
    starts, ends = wordhash.words(raw)
    h = wordhash.word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, bounds)
    n = len(h)
    grams = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        grams += h[k : n - SIZE + 1 + k] * _SHINGLE_TIMES[k] if n >= SIZE else np.uint64(0)
    grams = wordhash.mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SIZE:
            out.append(np.unique(grams[a : b - SIZE + 1]))
        elif b > a:
            few = np.uint64(b - a)
            for k in range(a, b):
                few = wordhash.mix(np.array([few]) * _SHINGLE_TIMES[0] + h[k])[0]
            out.append(np.array([few], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (((x[at : at + 1024, None] ^ _XOR) * _TIMES)).min(axis=0), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = (sig[:BANDED].reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _ROW_TIMES
    return wordhash.mix(wordhash.mix(rows.sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def bits(sig: np.ndarray) -> bytes:
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each number of compared batches, the fewest matches at which the chance that the
    similarity is at least ``threshold`` is still ``miss``."""
    j = (np.arange(2000) + 0.5) / 2000
    c = j + (1 - j) / 256
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(k + 1)[:, None]
        log = m * np.log(c) + (k - m) * np.log1p(-c)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        chance = p[:, j >= threshold].sum(axis=1) / p.sum(axis=1)
        out.append(int(np.argmax(chance >= miss)))
    return np.array(out)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, g (hash of the text), tie (hash of the whole row), n_shingles, key (of the
    set), bands, sig, and the upper halves of the shingles of small sets."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            sets = shingle_sets(p["t"])
            sigs = [signature(s) if len(s) else None for s in sets]
            yield {
                "doc_id": p["doc_id"], "g": p["g"], "tie": p["tie"], "n_shingles": [len(s) for s in sets],
                "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [band_keys(s).tolist() if s is not None else None for s in sigs],
                "sig": [bits(s) if s is not None else None for s in sigs],
                "small": [(s >> np.uint64(32)).astype(np.uint32).tobytes() if 0 < len(s) <= SMALL else None for s in sets],
            }

    schema = common.schema_of(("doc_id", docs.schema["doc_id"].dataType), "g bigint, tie bigint, n_shingles bigint, key binary, bands array<bigint>, sig binary, small binary")
    return common.map_rows(docs.select("doc_id", *row_hashes(docs), common.text_bytes().alias("t")), rows, schema, batch=500)


def row_hashes(docs: DataFrame) -> list[F.Column]:
    """g of the text, and tie of all columns, which tells rows of one doc_id and text apart."""
    return [F.xxhash64("text").alias("g"), F.xxhash64(F.lit(2), *common.hashable(docs)).alias("tie")]


def pruned(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) that the batches of hashes leave."""
    sigs = classes.select("nid", "sig")
    both = pairs.join(sigs.select(F.col("nid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("nid").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        least = least_matches(threshold, miss)
        for p in parts:
            if not p["a"]:
                continue
            a, b = np.array(p["a"]), np.array(p["b"])
            sa, sb = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
            matches = np.zeros(len(a), np.int64)
            for k, m in enumerate(least):
                at = slice(k * BATCH, (k + 1) * BATCH)
                matches += (sa[:, at] == sb[:, at]).sum(axis=1)
                live = matches >= m
                a, b, sa, sb, matches = a[live], b[live], sa[live], sb[live], matches[live]
            yield {"a": a.tolist(), "b": b.tolist()}

    return common.map_rows(both, rows, "a bigint, b bigint", batch=5000)


def may_link(a: bytes | None, b: bytes | None, percent: int) -> bool:
    """Whether small sets can reach the threshold; others may. One shingle of slack for
    equal halves of different hashes."""
    if a is None or b is None:
        return True
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum()) + 1
    return 100 * same >= percent * (len(both) - same)


def open_pairs(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of different labels in one bucket that the batches of hashes leave.
    members: bk, nid, label, n (of the bucket), sig, bands, small. A bucket of over ``BLOCK`` members
    is dealt to blocks, and each member to every pair of blocks that has its own. A pair
    leaves from the first band that it shares, told by the upper halves of the band keys."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.col("bk")).otherwise(F.xxhash64("bk", F.least("own", "other"), F.greatest("own", "other")))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = m.withColumn("band", F.array_position("bands", F.col("bk")).cast("int") - 1).withColumn("halves", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")))
    dealt = m.select(key.alias("key"), (F.col("own") == F.greatest("own", "other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("alone"), "nid", "label", "sig", "band", "halves", "small").repartition(parts, "key").sortWithinPartitions("key")

    def survivors(group: list[tuple], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nid = np.array([g[3] for g in group])
        label = np.array([g[4] for g in group])
        side = np.array([g[1] for g in group])
        sig = np.frombuffer(b"".join([g[5] for g in group]), np.uint8).reshape(-1, HASHES)
        alone, band = group[0][2], group[0][6]
        halves = np.array([g[7][:band] for g in group], np.int32).reshape(len(group), band)
        out_a, out_b = [], []
        for at in range(0, len(nid), 256):
            rows = np.arange(at, min(at + 256, len(nid)))
            ok = label[rows, None] != label[None, :]
            ok &= (rows[:, None] < np.arange(len(nid))[None, :]) if alone else (side[rows, None] < side[None, :])
            i, j = np.nonzero(ok)
            i = rows[i]
            matches = np.zeros(len(i), np.int64)
            for k, least_k in enumerate(least):
                if not len(i):
                    break
                cols = slice(k * BATCH, (k + 1) * BATCH)
                part = np.ascontiguousarray(sig[:, cols])
                matches += (part[i] == part[j]).sum(axis=1)
                live = matches >= least_k
                i, j, matches = i[live], j[live], matches[live]
            if band and len(i):
                new = ~(halves[i] == halves[j]).any(axis=1)
                i, j = i[new], j[new]
            may = [may_link(group[x][8], group[y][8], percent) for x, y in zip(i, j)]
            may = np.array(may, bool)
            i, j = i[may], j[may]
            out_a.append(nid[i])
            out_b.append(nid[j])
        return np.concatenate(out_a), np.concatenate(out_b)

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        least = least_matches(percent / 100, miss)
        group: list[tuple] = []
        for p in parts:
            got_a, got_b = [], []
            for row in zip(p["key"], p["side"], p["alone"], p["nid"], p["label"], p["sig"], p["band"], p["halves"], p["small"]):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        a, b = survivors(group, least)
                        got_a.append(a)
                        got_b.append(b)
                    group = []
                group.append(row)
            if got_a:
                a, b = np.concatenate(got_a), np.concatenate(got_b)
                yield {"a": np.minimum(a, b).tolist(), "b": np.maximum(a, b).tolist()}
        if len(group) > 1:
            a, b = survivors(group, least)
            yield {"a": np.minimum(a, b).tolist(), "b": np.maximum(a, b).tolist()}

    return common.map_rows(dealt, rows, "a bigint, b bigint", batch=5000).distinct()


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold. Sets are made anew from the texts of the
    classes that pairs name; other texts are left out where they are read, by a bitmap of the
    hashes of those named, and aren't shuffled."""
    need = pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct()
    own = classes.join(need, "nid").select("nid", "key", F.col("row.doc_id").alias("own_id"), F.col("row.g").alias("own_g"), F.col("row.tie").alias("own_tie"))
    own = common.written(own, "near-named")
    texts = common.among(docs.select("doc_id", *row_hashes(docs), common.text_bytes().alias("t")), "g", own.select("own_g"))
    texts = texts.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("g") == F.col("own_g")) & (F.col("tie") == F.col("own_tie"))).select("nid", "key", "t")

    def sets(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            got = [(n, s.tobytes()) for n, k, s in zip(p["nid"], p["key"], shingle_sets(p["t"])) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k]
            yield {"nid": [n for n, _ in got], "set": [s for _, s in got]}

    whole = common.written(common.map_rows(texts, sets, "nid bigint, set binary", batch=500), "near-sets").dropDuplicates(["nid"])
    both = pairs.join(whole.select(F.col("nid").alias("a"), F.col("set").alias("sa")), "a").join(whole.select(F.col("nid").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            links = []
            for a, b, sa, sb in zip(p["a"], p["b"], p["sa"], p["sb"]):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    links.append((a, b))
            yield {"a": [x for x, _ in links], "b": [x for _, x in links]}

    return common.map_rows(both, rows, "a bigint, b bigint", batch=500)


def labels_of(links: DataFrame) -> DataFrame:
    """nid, label of every linked node: one label for each connected component. Each round
    draws an order of the labels anew and hooks each to the first that it or its own first
    one touches. Whatever the links, the labels that are left shrink by a constant factor a
    round in expectation, so the rounds are as the logarithm of a component's size, for a
    path in the order of its numbers too."""
    both = lambda e: e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    edges, labels, turn = links, None, 0
    while True:
        turn += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        hook = both(edges).groupBy("x").agg(F.min(place("y")).alias("to")).select("x", F.least("to", place("x"))["n"].alias("to"))
        hook = common.written(hook, "near-hook")
        hook = common.written(hook.alias("p").join(hook.alias("q"), F.col("p.to") == F.col("q.x")).select("p.x", F.col("q.to").alias("to")), "near-hook")
        if labels is None:
            labels = hook.select(F.col("x").alias("nid"), F.col("to").alias("label"))
        else:
            labels = labels.join(hook, labels["label"] == hook["x"], "left").select("nid", F.coalesce("to", "label").alias("label"))
        labels = common.written(labels, "near-labels")
        to = lambda c: hook.select(F.col("x").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct()
        edges = common.written(edges, "near-edges")
        if edges.isEmpty():
            return labels


def grouped(docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """doc_id, g, tie, n_shingles, component_id, label for each row. Rows of a component
    have its label; rows without words have none."""
    threshold = percent / 100
    rows = common.written(signatures(docs), "near-rows")
    # the row whose text stands for the class; min() of doc_id alone would pass over nulls
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "g", "tie")).alias("row")
    classes = rows.filter("key is not null").groupBy("key").agg(row, F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("small").alias("small"))
    classes = common.written(classes.withColumn("nid", F.monotonically_increasing_id()), "near-classes")

    banded = classes.select("nid", F.explode("bands").alias("bk"))
    counts = banded.groupBy("bk").agg(F.count("*").alias("n")).filter("n > 1")
    members = common.written(banded.join(counts, "bk"), "near-members")
    pop = members.groupBy("nid").agg(F.sum("n").alias("pop"))
    lead = members.join(pop, "nid").groupBy("bk").agg(F.max_by("nid", "pop").alias("lead"))
    tried = common.written(members.join(lead, "bk").filter("nid <> lead").select(F.least("nid", "lead").alias("a"), F.greatest("nid", "lead").alias("b")).distinct(), "near-pairs")
    links = common.written(verified(common.written(pruned(tried, classes, threshold, miss), "near-survivors"), classes, docs, percent), "near-links")

    label = labels_of(links)
    at = members.join(label, "nid", "left").select("bk", "nid", F.coalesce("label", "nid").alias("label"))
    split = at.groupBy("bk").agg(F.min("label").alias("u"), F.max("label").alias("v"), F.count("*").alias("n")).filter("u <> v").select("bk", "n")
    at = at.join(split, "bk").join(classes.select("nid", "sig", "bands", "small"), "nid")
    more = common.written(open_pairs(at, percent, miss), "near-survivors")
    again = common.written(verified(more, classes, docs, percent), "near-links")
    label = labels_of(links.unionByName(again)) if not again.isEmpty() else label

    known = classes.select("key", "row", "nid").join(label, "nid", "left").select("key", "row", F.coalesce("label", "nid").alias("label"))
    ids = known.groupBy("label").agg(F.min("row.doc_id").alias("component_id"))
    known = known.join(ids, "label").select("key", "component_id", "label")
    out = rows.select("doc_id", "g", "tie", "n_shingles", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "g", "tie", "n_shingles", component.alias("component_id"), "label")


def components(docs: DataFrame, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row. Links are pairs of documents
    with 100 * intersection >= percent * union."""
    return grouped(docs.select("doc_id", "text"), percent, miss).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row of each component: of the least doc_id (a null one last), then by hashes of
    the text and the row. Rows without words are linked with nothing and all stay."""
    cols = docs.columns
    names = [f"__k{i}" for i in range(len(cols))]
    own = docs.select(*[common.column(c).alias(n) for c, n in zip(cols, names)])
    at = dict(zip(cols, names))
    own = own.select("*", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"))
    found = grouped(own, percent, miss)
    alike = found.filter("label is not null").groupBy("label", "doc_id", "g", "tie").agg(F.count("*").alias("n"))
    best = alike.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "g", "tie", "n")).alias("x")).select("x.doc_id", "x.g", "x.tie", "x.n")
    bare = found.filter("label is null").select("doc_id", "g", "tie", F.lit(1).cast("long").alias("n")).distinct()
    keep = common.written(best.unionByName(bare).select(*[F.col(c).alias(f"__w{c}") for c in ("doc_id", "g", "tie", "n")]), "near-kept")
    hashed = own.select("*", *[h.alias(f"__h{n}") for h, n in zip(row_hashes(own), ("g", "tie"))])
    same = F.col("doc_id").eqNullSafe(F.col("__wdoc_id")) & (F.col("__hg") == F.col("__wg")) & (F.col("__htie") == F.col("__wtie"))
    out = hashed.join(keep.filter("__wn = 1"), same, "left_semi").select(*names)
    # rows alike in every column: one of them stays
    many = keep.filter("__wn > 1")
    if not many.isEmpty():
        out = out.unionByName(hashed.join(many, same, "left_semi").dropDuplicates(["doc_id", "__hg", "__htie"]).select(*names))
    return out.select(*[F.col(n).alias(c) for c, n in zip(cols, names)])
