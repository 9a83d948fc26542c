"""Mixing sources to target weights, with DataFrame operations only.

A source's documents, in a fixed order, are one stream of words, packed into blocks of a
fixed length. A source's target says how many slots it fills: full passes over its blocks,
then part of one. Output shards have equally many slots, give or take one. Shard by shard,
the counts of its slots by source are drawn: a multinomial draw of as many slots as it has,
from what the shards before it have left, so that each source meets its target and not only
its expectation, and the last shard takes the rest (``counts``). A source's slots are then
numbered shard by shard, numbers map to blocks through a pseudorandom permutation of the
source's block numbers (swap-or-not rounds), and blocks are joined by number. So the counts
decide which blocks a shard holds.

Counts are drawn, never counted: a number for each source and shard, from a normal variate
if its variance is ``LARGE`` or more, else by inverting the binomial distribution, and held
to what both margins allow. ``FAN`` sources at a time are one row; with more, groups of them
are drawn first, then the sources inside each group, and so on.

The last slot of a source takes only the words still missing, so a source's taken words
are its target, rounded.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its
own, last in order; sources without words have target 0; repeated rows are documents each;
other columns are ignored. The same rows give the same result in any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 64
WEIGHTS = (5, 2, 1)
SHARDS = 64
ROUNDS = 8
SLOT_CHUNK = 4096
ROWS_PER_CHUNK, LEAST_CHUNKS = 20_000, 256
COPIES = 1_000
#: Sources in one row of a draw; the variance from which a count is drawn as a normal
#: variate, and the steps by which a smaller one is searched.
FAN, LARGE, STEPS = 256, 16.0, 96


def sized(docs: DataFrame, rid: F.Column | None = None, tie: F.Column | None = None) -> DataFrame:
    """doc_id, source, size, g (hash of the text), tie (orders rows that agree so far), rid."""
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("text")).alias("g"),
        (F.lit(0).cast("long") if tie is None else tie).alias("tie"),
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.spark_partition_id().alias("part"),
    )


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], limit: float) -> DataFrame:
    """source, source_size, sid, target. sizes: source, source_size, a row for each source.

    Water filling: targets are weight times one level, or ``limit`` times the size where
    that is less; the level is where they sum to ``share`` of all words. Sources are
    numbered and summed up in ranges, so no task gets them all."""
    named = common.running(sizes, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long")}, "mix-named")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = named.withColumn("w", w).withColumn("cap", limit * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    ranked = common.running(ranked, [F.col("ratio"), F.col("sid")], {"cap_before": F.col("cap"), "w_before": F.col("w")}, "mix-ratios")
    sums = ranked.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    level = (share * F.lit(float(sums.n or 0)) - F.col("cap_before")) / (F.lit(float(sums.w or 0)) - F.col("w_before"))
    fits = (level * F.col("w") <= F.col("cap")) & (F.col("source_size") > 0)
    chosen = ranked.filter(fits).agg(F.min(F.struct("ratio", "sid", level.alias("level"))).alias("x")).first().x
    target = F.col("cap") if chosen is None else F.least("cap", F.col("w") * F.lit(chosen.level))
    return ranked.select("source", "source_size", "sid", target.alias("target"))


def permuted(index: F.Column, n: F.Column, *keys: F.Column, back: bool = False) -> F.Column:
    """``index`` through a pseudorandom permutation of 0..n-1 that ``keys`` choose. Each
    round swaps x with (key - x) mod n or not, by a hash of the larger of the two, so every
    round undoes itself; ``back`` inverts."""

    def swapped(x: F.Column, r: F.Column) -> F.Column:
        other = F.pmod(F.pmod(F.xxhash64(r, n, *keys), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r + ROUNDS, F.greatest(x, other), *keys), F.lit(2)) == 1, other).otherwise(x)

    order = (ROUNDS - 1, 0) if back else (0, ROUNDS - 1)
    return F.aggregate(F.sequence(*map(F.lit, order)), index, swapped)


def each_of(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row of ``df`` for each of 0..n-1, in column ``name``. Numbers are dealt to tasks in
    chunks, themselves made from chunks of chunks, so no row holds a long array."""
    coarse = SLOT_CHUNK * SLOT_CHUNK
    zero = F.lit(0).cast("long")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.columns
    df = df.filter(F.col(n) > 0).select("*", F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / coarse))).alias("i"))
    within = F.least(F.lit(coarse), F.col(n) - F.col("i") * coarse)
    df = df.select("*", F.explode(F.sequence(zero, F.floor((within - 1) / SLOT_CHUNK))).alias("j"))
    first = F.col("i") * coarse + F.col("j") * SLOT_CHUNK
    return df.repartition(parts, *keys, "i", "j").select(*keys, F.explode(F.sequence(first, F.least(first + SLOT_CHUNK, F.col(n)) - 1)).alias(name))


def uniform(*keys: F.Column) -> F.Column:
    """A number strictly between 0 and 1 that the keys choose."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def binomial(n: F.Column, p: F.Column, u: F.Column) -> F.Column:
    """The least x whose cumulative binomial chance reaches ``u``, by ascending from 0."""
    odds = p / (1 - p)

    def step(a: F.Column, x: F.Column) -> F.Column:
        chance = a["chance"] * (n - x) / (x + 1) * odds
        more = a["sum"] < u
        return F.struct(F.when(more, x + 1).otherwise(a["x"]).alias("x"), chance.alias("chance"), F.when(more, a["sum"] + chance).otherwise(a["sum"]).alias("sum"))

    none = F.exp(n * F.log1p(-p))
    first = F.struct(F.lit(0).cast("long").alias("x"), none.alias("chance"), none.alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(STEPS - 1).cast("long")), first, step)["x"]


def drawn(own: F.Column, m: F.Column, all_: F.Column, *keys: F.Column) -> F.Column:
    """How many of ``m`` slots, drawn from ``all_``, are among ``own`` of them."""
    p = own / all_
    mean = m * p
    variance = mean * (1 - p) * (all_ - m) / F.greatest(all_ - 1, F.lit(1))
    u = uniform(F.lit(1), *keys)
    normal = F.round(mean + F.sqrt(variance) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(F.lit(2), *keys)))
    few = F.when(p <= 0.5, binomial(m, p, u)).otherwise(m - binomial(m, 1 - p, u))
    x = F.when(variance >= LARGE, normal.cast("long")).otherwise(few)
    held = F.least(F.greatest(x, m - (all_ - own), F.lit(0).cast("long")), own, m)
    return F.when((m <= 0) | (own <= 0), F.lit(0).cast("long")).when(own >= all_, m).otherwise(held)


def table_of_draws(own: F.Column, each: F.Column, *keys: F.Column) -> F.Column:
    """For each shard an array of counts, one for each entry of ``own``. A shard k has
    ``each[k]`` slots; the sums of ``own`` and ``each`` agree, and so do the table's."""
    long = lambda x: F.lit(x).cast("long")
    none = F.array().cast("array<bigint>")

    def shard(a: F.Column, k: F.Column) -> F.Column:
        def source(b: F.Column, i: F.Column) -> F.Column:
            here = F.get(a["left"], i)
            x = drawn(here, b["m"], b["all"], k, i, *keys)
            return F.struct((b["m"] - x).alias("m"), (b["all"] - here).alias("all"), F.concat(b["out"], F.array(x)).alias("out"))

        first = F.struct(F.get(each, k).alias("m"), F.aggregate(a["left"], long(0), lambda s, x: s + x).alias("all"), none.alias("out"))
        got = F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), first, source)["out"]
        # a lambda, so that what is drawn is drawn once
        both = F.transform(F.array(got), lambda g: F.struct(F.zip_with(a["left"], g, lambda x, y: x - y).alias("left"), F.concat(a["out"], F.array(g)).alias("out")))
        return F.get(both, F.lit(0))

    start = F.struct(own.alias("left"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(each) - 1), start, shard)["out"]


def shard_draws(sources: DataFrame, n_sources: int, total: int, shards: int, seed: int) -> DataFrame:
    """sid, shard, n over 0 of the sources (sid, slots), numbered from 0: a draw for each
    output shard of an equal part of all slots. Rows hold at most ``FAN`` sources or groups."""
    levels = [sources.select(F.col("sid").alias("id"), F.col("slots").alias("n"))]
    while n_sources > FAN:
        levels.append(levels[-1].groupBy(F.floor(F.col("id") / FAN).cast("long").alias("id")).agg(F.sum("n").alias("n")))
        n_sources = -(-n_sources // FAN)
    each = F.array(*[F.lit(total // shards + (k < total % shards)).cast("long") for k in range(shards)])
    above = None
    for depth, level in reversed(list(enumerate(levels))):
        packed = level.groupBy(F.floor(F.col("id") / FAN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("own"))
        packed = packed.withColumn("each", each) if above is None else packed.join(above, "up")
        table = table_of_draws(F.col("own.n"), F.col("each"), F.col("up"), F.lit(depth), F.lit(seed))
        rows = packed.withColumn("table", table).select("table", F.posexplode("own").alias("i", "x"))
        above = rows.select(F.col("x.id").alias("up"), F.transform("table", lambda t: F.get(t, F.col("i"))).alias("each"))
    return above.select(F.col("up").alias("sid"), F.posexplode("each").alias("shard", "n")).filter("n > 0")


def copy_groups(rows: DataFrame) -> DataFrame:
    """Adds k: the thousand that a row belongs to among rows alike in doc_id, text and tie.
    Only where such rows pass a thousand are they numbered: within the part in which they
    were stored, plus the counts of the parts before."""
    rows = rows.withColumn("alike", F.xxhash64("doc_id", "g", "tie"))
    heavy = rows.groupBy("alike").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("alike")
    k = common.numbered(rows.select("alike", "part", "rid").join(heavy, "alike"), "alike").select("rid", F.floor(F.col("rn") / COPIES).alias("k"))
    return rows.drop("alike", "part").join(k, "rid", "left").withColumn("k", F.coalesce("k", F.lit(0)))


class Mixture:
    """The parts of a mix: ``rows`` (documents with their place in the source's stream),
    ``sources``, ``counts`` (slots of each source and output shard, as drawn), ``slots``
    (shard, slot, sid, pass, block; ``cut``: only that many of its words) and ``pieces``
    (blocks' overlaps with documents)."""

    def __init__(self, docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, limit: float = 2.0, block: int = BLOCK, shards: int = SHARDS, seed: int = 1, rid: F.Column | None = None, tie: F.Column | None = None):
        rows = common.written(sized(docs, rid, tie), "mix-rows")
        self.block = block
        sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        total = F.col("source_size")
        sources = targets(sizes, share, weights, limit)
        wanted = F.round("target").cast("long")
        sources = sources.withColumn("blocks", F.ceil(total / block).cast("long")).withColumn("passes", F.when(total > 0, F.floor(wanted / total)).otherwise(0).cast("long"))
        sources = sources.withColumn("rest", wanted - F.col("passes") * total)
        # the short last block's slot in the last pass, and the slots before the words are full
        short = total - (F.col("blocks") - 1) * block
        sources = sources.withColumn("at", F.when(total > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.col("sid"), F.col("passes"), F.lit(seed), back=True)))
        least = F.ceil(F.col("rest") / block).cast("long")
        holds = least * block - F.when(F.col("at") < least, block - short).otherwise(0)
        sources = sources.withColumn("last", F.when(holds < F.col("rest"), least + 1).otherwise(least))
        before = (F.col("last") - 1) * block - F.when(F.col("at") < F.col("last") - 1, block - short).otherwise(0)
        sources = sources.withColumn("cut", F.when(F.col("rest") > 0, F.col("rest") - before))
        self.sources = common.written(sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("last")), "mix-sources")

        placed = copy_groups(rows).withColumn("c", F.pmod(F.xxhash64("doc_id", "g", "k"), F.lit(max(LEAST_CHUNKS, rows.count() // ROWS_PER_CHUNK))).cast("int"))
        order = W.partitionBy("source", "c").orderBy("doc_id", "g", "tie", "rid")
        placed = common.written(placed.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("k", "tie"), "mix-placed")
        offsets = placed.groupBy("source", "c").agg(F.sum("size").alias("n"))
        offsets = offsets.withColumn("offset", F.sum("n").over(W.partitionBy("source").orderBy("c")) - F.col("n"))
        o = offsets.join(self.sources, offsets["source"].eqNullSafe(self.sources["source"])).select("sid", "source_size", "target", offsets["source"].alias("o_source"), F.col("c").alias("o_c"), "offset")
        joined = placed.join(o, placed["source"].eqNullSafe(o["o_source"]) & (placed["c"] == o["o_c"]))
        self.rows = joined.select("doc_id", "rid", "sid", "size", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))

        known = self.sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
        self.counts = common.written(shard_draws(self.sources, known.n, known.slots, shards, seed), "mix-counts")
        first = F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")
        known = self.counts.withColumn("first", first).join(self.sources.select("sid", "blocks", "slots", "cut"), "sid")
        each = each_of(known, "n", "j").withColumn("slot", F.col("first") + F.col("j"))
        each = each.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("long")).withColumn("block", F.col("slot") % F.col("blocks"))
        self.slots = each.select("shard", "slot", "sid", "pass", permuted(F.col("block"), F.col("blocks"), F.col("sid"), F.col("pass"), F.lit(seed)).alias("block"), F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).alias("cut"))
        b = F.lit(block)
        piece = self.rows.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))).alias("block"))
        inside = F.greatest(F.col("block") * b, F.col("start"))
        self.pieces = piece.withColumn("offset", inside - F.col("block") * b).withColumn("first", inside - F.col("start")).withColumn("end", F.least((F.col("block") + 1) * b, F.col("start") + F.col("size")) - F.col("start"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken and shards (the taken words by output
        shard) for every row."""
        # a block has a slot in each pass at most, so these lists are as short as ``limit``;
        # the exploded slots grow with the input, which Spark's estimate of them doesn't show
        takes = self.slots.groupBy("sid", "block").agg(F.collect_list(F.struct("shard", "cut")).alias("takes"))
        met = self.pieces.join(takes.hint("merge"), ["sid", "block"], "left").withColumn("take", F.explode_outer("takes"))
        words = F.col("end") - F.col("first")
        each = F.when(F.col("take").isNull(), 0).when(F.col("take.cut").isNull(), words).otherwise(F.greatest(F.least(words, F.col("take.cut") - F.col("offset")), F.lit(0)))
        keys = ["rid", "doc_id", "size", "source_size", "target"]
        by_shard = met.groupBy(*keys, F.col("take.shard").alias("shard")).agg(F.sum(each.cast("long")).alias("words"))
        held = F.array_sort(F.collect_list(F.when(F.col("words") > 0, F.struct("shard", "words"))))
        return by_shard.groupBy(*keys).agg(F.sum("words").alias("taken"), held.alias("shards")).drop("rid")

    def shard_counts(self) -> DataFrame:
        """source, shard, n: how many blocks of the source the shard drew."""
        return self.counts.join(self.sources.select("sid", "source"), "sid").select("source", "shard", "n")


def mixed(docs: DataFrame, shard_col: str | None = None, **options) -> DataFrame:
    """Rows like ``docs`` whose texts hold the words that the mix takes, in order: a row for
    what it takes of a document in a pass. With ``shard_col``, the name of a column to add,
    a row for what each output shard takes. Repeated rows are documents each."""
    columns = docs.columns
    names = [f"__k{i}" for i in range(len(columns))]
    at = dict(zip(columns, names))
    named = docs.select(*[common.column(c).alias(n) for c, n in at.items()])
    named = common.written(named.withColumn("__rid", F.monotonically_increasing_id()).withColumn("__tie", F.xxhash64(*common.hashable(named))), "mix-docs")
    own = named.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "text", "source")], "__rid", "__tie")
    m = Mixture(own, rid=F.col("__rid"), tie=F.col("__tie"), **options)
    met = m.pieces.filter("size > 0").join(m.slots.select("shard", "sid", "pass", "block", "cut").hint("merge"), ["sid", "block"])
    met = met.withColumn("end", F.least("end", F.col("first") + F.coalesce(F.col("cut"), F.lit(m.block)) - F.col("offset"))).filter("end > first")
    shard = F.col("shard") if shard_col else F.lit(None).cast("int")
    takes = met.groupBy("rid", "pass", shard.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("takes"))
    each = takes.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "takes"))).alias("all"))
    out = named.join(each.hint("merge"), F.col("__rid") == F.col("rid"))
    words = F.regexp_extract_all(at["text"], F.lit(WORDS + r"[\x20\x09-\x0D]*"), F.lit(0))
    text = lambda w, t: F.array_join(F.flatten(F.transform(t["takes"], lambda x: F.slice(w, (x["first"] + 1).cast("int"), (x["end"] - x["first"]).cast("int")))), "")
    whole = lambda w, t: F.aggregate(t["takes"], F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"]) == F.size(w)
    cut = F.get(F.transform(F.array(words), lambda w: F.transform("all", lambda t: F.struct(t["shard"].alias("shard"), F.when(~whole(w, t), text(w, t)).alias("text")))), F.lit(0))
    out = out.withColumn("__cut", cut).withColumn("__take", F.explode("__cut")).withColumn("__text", F.coalesce("__take.text", at["text"]))
    made = {"text": F.col("__text"), "n_chars": F.char_length("__text")}
    shown = [(made[c].cast(docs.schema[c].dataType) if c in made else F.col(n)).alias(c) for c, n in at.items()]
    return out.select(*shown, *([F.col("__take.shard").alias(shard_col)] if shard_col else []))
