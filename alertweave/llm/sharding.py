"""K-d tree sharding, with DataFrame operations only.

Equal texts form a group, which stays in one shard; only a group that no shard can hold is
split, by the number of its rows. A group has four coordinates: size, smallest doc_id, and checksums of its
smallest source and language. Groups of over 1/32 of a shard are placed first, the largest
first, on the emptiest shard. The others are split recursively: a node takes the dimension
in which it is widest (relative to the root) and cuts it at the weighted quantile that
fills the shards on either side, down to single shards, so sizes come out near equal.

The cut is found by distributed histograms: each pass sums bytes into bins of the current
key interval of every node of the level, and keeps the bin where the cut lies, until that
bin's bytes are negligible. The driver gets a row for each node and pass, and at most
``MOST_HEAVY`` of the largest heavy groups, or as many as there are shards; beyond that
number the smaller of them go through the tree like the others. Tables of these are broadcast only up to a checked size.

Defined results: a null text has size 1 and checksum 0; null metadata count as empty
strings, a null doc_id as 0; repeated rows are placed each, and many of them are split like
any group; an empty table gives no rows; other columns are ignored. Which of several rows
alike has which slot depends on how the table was read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

BINS = 512
HEAVY = 32  # a group of over 1/HEAVY of a shard is placed by itself
DIMS = 4
MOST_HEAVY = 200_000
ROWS_PER_BUCKET = 20_000


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("crc"),
        F.xxhash64(text, F.lit(1)).alias("g"),
        F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")).cast("long").alias("s"),
        F.crc32(F.coalesce(F.col("lang"), F.lit("")).cast("binary")).cast("long").alias("l"),
        F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("part"),
    )


def place_heavy(groups: list[tuple[int, int]], leaves: int, total: int) -> tuple[list[tuple[int, int, float, float]], list[float]]:
    """Largest first on the emptiest shard; a group beyond what is left there is split.
    Returns (group, shard, from, to) with shares of its rows, and each shard's room left."""
    room = [total / leaves] * leaves
    heap = [(-r, i) for i, r in enumerate(room)]
    heapq.heapify(heap)
    placed = []
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        left, at = float(size), 0.0
        whole = size <= total / leaves
        while left > 0:
            r, i = heapq.heappop(heap)
            part = left if whole or -r >= left or -r <= 0 else -r
            placed.append((g, i, at / size, 1.0 if part >= left else (at + part) / size))
            at, left = at + part, left - part
            room[i] -= part
            heapq.heappush(heap, (-room[i], i))
    return placed, [max(0.0, r) for r in room]


def light_shards(groups: DataFrame, room: list[float]) -> DataFrame:
    """(g, shard) of the groups that the tree places. groups: g, w (bytes), c0..c3."""
    spark = groups.sparkSession
    if len(room) == 1:
        return groups.select("g", F.lit(0).alias("shard"))
    lo_hi = [f(f"c{d}").alias(f"{n}{d}") for d in range(DIMS) for f, n in ((F.min, "a"), (F.max, "b"))]
    nodes = {0: (0, len(room))}  # leaves from, to
    cuts: list[tuple[int, int, int]] = []
    at = groups.withColumn("node", F.lit(0))
    level, ended = 0, {}
    root: dict[int, float] = {}
    while nodes:
        known = {r.node: r for r in at.groupBy("node").agg(F.sum("w").alias("w"), *lo_hi).collect()}
        if not known:
            break
        if not root:
            root = {d: max(1, known[0][f"b{d}"] - known[0][f"a{d}"]) for d in range(DIMS)}
        open_: dict[int, dict] = {}
        for n, (a, b) in nodes.items():
            if b - a > 1 and n in known:
                r = known[n]
                d = max(range(DIMS), key=lambda x: ((r[f"b{x}"] - r[f"a{x}"]) / root[x], -x))
                m = (a + b) // 2
                left, right = sum(room[a:m]), sum(room[m:b])
                # the key: the coordinate over its range in 30 bits, then 32 bits of the group
                open_[n] = {"d": d, "low": r[f"a{d}"], "span": max(1, r[f"b{d}"] - r[f"a{d}"]), "lo": 0, "width": 1 << 62, "want": r.w * (left / (left + right) if left + right else 0.5), "total": r.w, "below": 0}
        if not open_:
            break
        frame = _with_key(at, open_)
        frame = common.written(frame.select("g", "w", *[f"c{d}" for d in range(DIMS)], "node", "key"), f"kd-{level}")
        final: dict[int, int] = {}
        live = dict(open_)
        while live:
            step = {n: max(1, -(-o["width"] // BINS)) for n, o in live.items()}
            meta = spark.createDataFrame([(n, o["lo"], o["lo"] + o["width"], step[n], float(o["want"] - o["below"])) for n, o in live.items()], "node int, lo long, hi long, step long, want double")
            bins = frame.join(common.small(meta, len(live)), "node").filter("key >= lo and key < hi").groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("w").alias("w"), F.first("want").alias("want"))
            cum = bins.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
            hit = {r.node: r for r in cum.filter("upto >= want").groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x")).collect()}
            for n in list(live):
                o = live[n]
                x = hit[n].x if n in hit else None
                if x is None:  # nothing at or beyond the wanted weight
                    final[n] = o["lo"] + o["width"]
                    del live[n]
                    continue
                o["below"] += x.upto - x.w
                o["lo"], o["width"] = o["lo"] + x.bin * step[n], step[n]
                if o["width"] == 1 or x.w <= o["total"] / 2000:
                    near = o["want"] - o["below"]
                    final[n] = o["lo"] + (o["width"] if near > x.w / 2 else 0)
                    del live[n]
        cut = spark.createDataFrame([(n, final[n]) for n in final], "node int, cut long")
        ahead = {}
        for n, (a, b) in nodes.items():
            if n in final:
                ahead[2 * n + 1], ahead[2 * n + 2] = (a, (a + b) // 2), ((a + b) // 2, b)
            else:
                ahead[n] = (a, b)  # a single leaf, or empty
        at = frame.join(common.small(cut, len(final)), "node", "left").select("g", "w", *[f"c{d}" for d in range(DIMS)], F.expr("case when cut is null then node when key < cut then 2 * node + 1 else 2 * node + 2 end").alias("node"))
        nodes, level = ahead, level + 1
        if all(b - a == 1 for a, b in nodes.values()):
            break
    leaf = spark.createDataFrame([(n, a) for n, (a, _) in nodes.items()], "node int, shard int")
    return at.join(common.small(leaf, len(nodes)), "node").select("g", "shard")


def _with_key(at: DataFrame, open_: dict[int, dict]) -> DataFrame:
    meta = at.sparkSession.createDataFrame([(n, o["d"], o["low"], float(o["span"])) for n, o in open_.items()], "node int, d int, low long, span double")
    value = F.element_at(F.array(*[f"c{i}" for i in range(DIMS)]), F.col("d") + 1)
    coarse = F.least(F.floor((value - F.col("low")) / F.col("span") * F.lit(float(1 << 30))), F.lit((1 << 30) - 1)).cast("long")
    fine = F.col("g").bitwiseAND(F.lit(0xFFFFFFFF))
    return at.join(common.small(meta, len(open_)), "node", "left").withColumn("key", F.coalesce(F.shiftleft(coarse, 32).bitwiseOR(fine), F.lit(0).cast("long")))


def shards(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, crc, shard, slot of every row, in ``leaves`` shards or as many as
    ``target_bytes`` asks for."""
    rows = common.written(sized(docs), "kd-rows")
    spark = docs.sparkSession
    groups = common.written(
        rows.groupBy("g").agg(F.sum("size").alias("w"), F.max("size").alias("c0"), F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("c1"), F.min("s").alias("c2"), F.min("l").alias("c3"), F.count("*").alias("n")),
        "kd-groups",
    )
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = leaves or max(1, -(-total // (target_bytes or 128 << 20)))
    # never past one shard: what no shard can hold must be split, and there are at most ``leaves``
    heavy_bytes = total / leaves / HEAVY
    while heavy_bytes < total / leaves and groups.filter(F.col("w") > heavy_bytes).count() > MOST_HEAVY:
        heavy_bytes = min(2 * heavy_bytes, total / leaves)
    heavy = [(r.g, r.w) for r in groups.filter(F.col("w") > heavy_bytes).select("g", "w").toLocalIterator()]
    placed, room = place_heavy(heavy, leaves, total)
    light = light_shards(groups.filter(F.col("w") <= heavy_bytes).drop("n"), room)
    cols = ["doc_id", "size", "crc", "g", "rid", "shard"]
    known = rows.drop("s", "l")
    whole = [(g, shard) for g, shard, a, b in placed if a == 0.0 and b == 1.0]
    cut = [p for p in placed if not (p[2] == 0.0 and p[3] == 1.0)]
    of = lambda data, schema: common.small(spark.createDataFrame(data, schema), len(data))
    out = known.join(light.unionByName(spark.createDataFrame(whole, "g long, shard int")), "g").select(*cols)
    if cut:
        # the shares of a split group's rows, as ranges of its row numbers
        parted = known.join(of([(g,) for g in sorted({p[0] for p in cut})], "g long"), "g")
        parted = parted.join(common.numbered(parted.select("g", "part", "rid"), "g"), "rid").join(groups.select("g", "n"), "g")
        ranges = of(cut, "g long, shard int, a double, b double")
        at = (F.col("rn") + 0.5) / F.col("n")
        out = out.unionByName(parted.join(ranges, "g").filter((at >= F.col("a")) & (at < F.col("b"))).select(*cols))
    return slotted(out, max(16, n_rows // leaves // ROWS_PER_BUCKET))


def slotted(df: DataFrame, buckets: int) -> DataFrame:
    """Adds gapless slots for each shard: a hash bucket's offset plus the row's place in it,
    so no task gets a whole shard."""
    df = common.written(df.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int")), "kd-placed")
    sums = df.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = sums.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "g", "rid")) - 1
    return df.withColumn("within", within).join(offsets, ["shard", "bucket"]).select("doc_id", "size", "crc", "shard", (F.col("offset") + F.col("within")).alias("slot"))
