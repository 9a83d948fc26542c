"""Secret scans, with DataFrame operations only.

Three stated patterns give the base spans. The method adds unlabelled stretches that look
random: for each candidate the encoding is inferred from the characters it uses, and a
battery of three tests compares it with random draws from that alphabet: chi-squared
uniformity, runs above and below the alphabet's middle, and serial correlation of neighbours.
One that no test rejects is held against the opposite, that it is written text or a name, by
the same three properties: how evenly the characters are used, how often the kind of
character (lower case, upper case, digit, mark) changes, and how vowels and consonants follow
each other. Each gives a likelihood ratio of the random draw to text; their product is the
evidence, and its inverse bounds the p-value under text (Markov's inequality), at any length
and without a normal approximation. Evidence adds up with every character, so short stretches
need to look more random to count as much. Benjamini-Hochberg over all candidates of the
corpus, which is valid for such bounds whatever their dependence, limits the share of false
discoveries; p-values are rounded up to tenths of a decade, so a histogram of bounded size
decides.

A run with '+' or '/' and also '_' or '-' fits no alphabet; its parts in either alphabet are
candidates instead. Of accepted parts, one inside another is not reported.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no
spans; repeated rows are scanned each and count as candidates each; other columns are
ignored; a candidate that overlaps a base span is not added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The patterns, and the least length of what they must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that pass
MARK = "\x01"  # stands for what base spans cover
CANDIDATE = r"[A-Za-z0-9+/_\x01-]{20,}={0,2}"  # '=' only as padding: a name before it is no part
MIXED = r"[+/].*[_-]|[_-].*[+/]"  # runs that no alphabet holds as a whole, and their parts
PARTS = (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: The alphabets that encodings draw from, in code order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", DIGITS + UPPER + LOWER + "_-"),
]
#: How often the letters a to z stand in written text, in thousandths; the
#: chances of the kind of character after lower case, upper case, a digit, a mark, and at the
#: start, in names; and how much oftener than by chance a consonant or a vowel follows a
#: consonant, and a consonant or a vowel a vowel.
LETTER_SHARES = [80, 15, 28, 42, 120, 22, 20, 50, 70, 2, 8, 42, 26, 72, 75, 19, 1, 62, 64, 90, 32, 10, 22, 2, 20, 1]
KIND_SHARES = [[0.74, 0.16, 0.03, 0.07], [0.62, 0.30, 0.03, 0.05], [0.06, 0.06, 0.80, 0.08], [0.50, 0.25, 0.20, 0.05], [0.60, 0.30, 0.05, 0.05]]
SERIAL_RATIOS = [0.45 / 0.61, 0.55 / 0.39, 0.85 / 0.61, 0.15 / 0.39]
#: Of each letter's share so much is spread over all, for other languages and abbreviations.
SPREAD = 0.15
Z_BATTERY = 3.29
FALSE_SHARE = 0.01
DECADES = 40


def let(value: F.Column, body) -> F.Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: F.Column, start: F.Column, step: int = 256) -> F.Column:
    """The sum before each value. An array that grows element by element is copied each time,
    so values are summed in blocks, and blocks by their sums."""
    empty = F.array().cast("array<bigint>")

    def of(xs: F.Column, at: F.Column) -> F.Column:
        add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(xs, F.struct(at.alias("at"), empty.alias("out")), add)["out"]

    def whole(v: F.Column) -> F.Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda k: F.slice(v, k * step + 1, F.lit(step)))
        return let(blocks, lambda b: F.flatten(F.zip_with(of(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)), start), b, lambda at, x: of(x, at))))

    return F.when(F.size(values) == 0, empty).otherwise(let(values, whole))


def pieces(text: F.Column, pattern: str) -> F.Column:
    """array<struct<gap, found>>: what stands before each match, and the match; the last has
    no match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def matches(text: F.Column, pattern: str, keep=None) -> F.Column:
    """array<struct<first, end, found>> of the leftmost non-overlapping matches. The stretches
    between matches and the matches themselves give the offsets. ``keep`` takes a match."""
    kind = "array<struct<first:bigint,end:bigint,found:string>>"
    size = lambda s: F.coalesce(F.char_length(s), F.lit(0)).cast("bigint")

    def placed(z: F.Column) -> F.Column:
        ends = running_sums(F.transform(z, lambda x: size(x["gap"]) + size(x["found"])), F.lit(0).cast("bigint"))
        each = F.zip_with(z, ends, lambda x, at: F.struct((at + size(x["gap"])).alias("first"), (at + size(x["gap"]) + size(x["found"])).alias("end"), x["found"].alias("found")))
        return F.filter(each, lambda x: x["found"].isNotNull() if keep is None else x["found"].isNotNull() & keep(x["found"]))

    return F.when(text.rlike(pattern), let(pieces(text, pattern), placed).cast(kind)).otherwise(F.array().cast(kind))


def masked(df: DataFrame, column: str, pattern: str, keep=None) -> DataFrame:
    """``column`` with each match replaced by as many marks. A step of its own: expressions
    that are nested in one another would be computed again wherever they are named."""
    fine = lambda s: F.lit(True) if keep is None else keep(s)
    each = lambda x: F.concat(x["gap"], F.when(x["found"].isNull(), "").when(fine(x["found"]), F.repeat(F.lit(MARK), F.char_length(x["found"]))).otherwise(x["found"]))
    return df.withColumn(column, F.when(F.col(column).rlike(pattern), F.array_join(F.transform(pieces(F.col(column), pattern), each), "")).otherwise(F.col(column)))


def letter_costs() -> list[float]:
    """The logarithm of each letter's share in text, negated."""
    return [-math.log((1 - SPREAD) * x / sum(LETTER_SHARES) + SPREAD / 26) for x in LETTER_SHARES]


def evidence(core: F.Column, size: F.Column) -> F.Column:
    """The logarithm of how much likelier a random draw from an alphabet of ``size`` gives the
    string than written text does."""
    table = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    letters, kinds = table(letter_costs()), table(-math.log(x) for row in KIND_SHARES for x in row)
    serial = table(-math.log(x) for x in SERIAL_RATIOS)

    def step(a: F.Column, c: F.Column) -> F.Column:
        low = F.lower(c)
        kind = F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
        vowel = F.when(~low.between("a", "z"), -1).when(F.instr(F.lit("aeiou"), low) > 0, 1).otherwise(0)
        uniform = F.when(kind < 2, F.get(letters, F.instr(F.lit(LOWER), low) - 1)).when(kind == 2, math.log(10)).otherwise(math.log(2))
        follows = F.when((a["vowel"] >= 0) & (vowel >= 0), F.get(serial, 2 * a["vowel"] + vowel)).otherwise(0.0)
        return F.struct(kind.alias("kind"), vowel.alias("vowel"), (a["sum"] + uniform + F.get(kinds, 4 * a["kind"] + kind) + follows - F.log(size)).alias("sum"))

    return F.aggregate(F.split(core, ""), F.struct(F.lit(4).alias("kind"), F.lit(-1).alias("vowel"), F.lit(0.0).alias("sum")), step)["sum"]


def battery(s: F.Column) -> F.Column:
    """A string's p-value as text, in tenths of a decade rounded down (so p is rounded up);
    null if a test rejects randomness or no encoding fits."""
    core = F.rtrim(s, F.lit("="))
    enc = F.lit(None).cast("int")
    for k in range(len(ALPHABETS) - 1, -1, -1):
        enc = F.when(core.rlike(ALPHABETS[k][1]), F.lit(k)).otherwise(enc)
    letters = F.array(*[F.lit(a) for _, _, a in ALPHABETS])

    def of(x: F.Column) -> F.Column:
        n = F.char_length(x["core"]).cast("double")
        m = F.char_length(x["letters"]).cast("double")
        index = F.transform(F.split(x["core"], ""), lambda c: F.instr(x["letters"], c).cast("double"))

        def scores(i: F.Column) -> F.Column:
            counts = F.transform(F.array_distinct(i), lambda v: F.pow(F.size(F.filter(i, lambda w: w == v)).cast("double"), F.lit(2.0)))
            squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
            chi = m / n * squares - n
            z_chi = (chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
            half = (m + 1) / 2
            high = F.aggregate(i, F.lit(0.0), lambda a, v: a + F.when(v > half, 1.0).otherwise(0.0))
            low = n - high
            runs = F.aggregate(i, F.struct(F.lit(0.0).alias("runs"), F.lit(-1.0).alias("was")), lambda a, v: F.struct(F.when(F.when(v > half, 1.0).otherwise(0.0) == a["was"], a["runs"]).otherwise(a["runs"] + 1.0).alias("runs"), F.when(v > half, 1.0).otherwise(0.0).alias("was")))["runs"]
            mean_runs = 1 + 2 * high * low / n
            var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
            z_runs = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0))
            sums = F.aggregate(
                i, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("cross"), F.lit(None).cast("double").alias("was")),
                lambda a, v: F.struct((a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["cross"] + F.coalesce(a["was"] * v, F.lit(0.0))).alias("cross"), v.alias("was")),
            )
            return F.struct(z_chi.alias("z_chi"), z_runs.alias("z_runs"), sums.alias("sums"))

        def verdict(t: F.Column) -> F.Column:
            mean = t["sums"]["s"] / n
            var = t["sums"]["ss"] / n - mean * mean
            ends = F.instr(x["letters"], F.substring(x["core"], 1, 1)).cast("double") + F.instr(x["letters"], F.substring(x["core"], -1, 1)).cast("double")
            cov = (t["sums"]["cross"] - mean * (2 * t["sums"]["s"] - ends) + (n - 1) * mean * mean) / n
            z_serial = F.when(var > 0, cov / var * F.sqrt(n)).otherwise(F.lit(99.0))
            fine = (t["z_chi"] < Z_BATTERY) & (F.abs(t["z_runs"]) < Z_BATTERY) & (F.abs(z_serial) < Z_BATTERY)
            tenths = F.floor(evidence(x["core"], m) * (10 / math.log(10)))
            return F.when(fine, F.greatest(F.least(tenths, F.lit(10 * DECADES)), F.lit(0)).cast("int"))

        return F.when(n >= 16, let(let(index, scores), verdict))

    both = F.struct(core.alias("core"), F.get(letters, enc).alias("letters"))
    return F.when(enc.isNull(), F.lit(None).cast("int")).otherwise(let(both, of))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and candidates with their p-value's tenth of a decade."""
    group2 = lambda s: F.char_length(F.regexp_extract(s, ASSIGN, 2)) >= ASSIGN_LEAST
    access = lambda s: F.char_length(s) >= ACCESS_LEAST
    text = F.col("text")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", matches(text, ASSIGN, group2).alias("assign"), matches(text, ACCESS, access).alias("access"), matches(text, HEX).alias("hex"), F.replace("text", F.lit(MARK), F.lit(" ")).alias("left"))
    # a run that base spans touch holds marks, and is no candidate
    for pattern, keep in ((ASSIGN, group2), (ACCESS, access), (HEX, None)):
        own = masked(own, "left", pattern, keep)
    base = own.select("doc_id", "assign", "access", "hex", matches(F.col("left"), CANDIDATE, lambda s: ~s.contains(MARK)).alias("candidates"))
    runs = "array<struct<first:bigint,end:bigint,found:string,part:boolean>>"
    shifted = lambda c, pattern: F.transform(matches(c["found"], pattern), lambda s: F.struct((c["first"] + s["first"]).alias("first"), (c["first"] + s["end"]).alias("end"), s["found"].alias("found"), F.lit(True).alias("part")))
    alone = lambda c: F.array(F.struct(c["first"].alias("first"), c["end"].alias("end"), c["found"].alias("found"), F.lit(False).alias("part")))
    parts = F.flatten(F.transform("candidates", lambda c: F.when(c["found"].rlike(MIXED), F.array_distinct(F.concat(*[shifted(c, p) for p in PARTS])).cast(runs)).otherwise(alone(c).cast(runs))))
    thin = lambda c: F.transform(c, lambda s: F.struct(s["first"], s["end"]))
    return base.select("doc_id", thin("assign").alias("assign"), thin("access").alias("access"), thin("hex").alias("hex"), F.transform(parts, lambda c: F.struct(c["first"].alias("first"), c["end"].alias("end"), battery(c["found"]).alias("p"), c["part"].alias("part"))).alias("candidates"))


def threshold(histogram: list[tuple[int | None, int]], share: float) -> int | None:
    """The least tenth of a decade that Benjamini-Hochberg accepts. A null p is a candidate
    that the battery rejected; it counts among the tests."""
    total, upto, least = sum(n for _, n in histogram), 0, None
    for p, n in sorted(((p, n) for p, n in histogram if p is not None), reverse=True):
        upto += n
        if 10 ** (-p / 10) * total <= share * upto:
            least = p
    return least


def secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = common.written(scanned(docs), "secrets")
    hist = found.select(F.explode("candidates").alias("c")).groupBy("c.p").agg(F.count("*").alias("n")).collect()
    least = threshold([(r.p, r.n) for r in hist], share)
    added = F.filter("candidates", lambda c: c["p"] >= F.lit(least)) if least is not None else F.filter("candidates", lambda c: F.lit(False))

    inside = lambda c, d: (d["first"] <= c["first"]) & (c["end"] <= d["end"]) & (c["end"] - c["first"] < d["end"] - d["first"])
    # only parts of mixed runs can stand inside one another
    found = found.withColumn("added", added).withColumn("parts", F.filter("added", lambda c: c["part"]))
    added = F.filter("added", lambda c: ~c["part"] | ~F.exists("parts", lambda d: inside(c, d)))

    def joined(*columns: F.Column) -> F.Column:
        def named(c: F.Column, k: int) -> F.Column:
            return F.transform(c, lambda s: F.struct(s["first"].alias("first"), F.lit(k).alias("kind"), F.concat_ws(":", F.lit(KINDS[k]), s["first"], s["end"]).alias("said")))

        each = [named(c, k) for k, c in enumerate(columns)]
        return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: s["said"]), ",")

    a, b, h = (F.col(k) for k in KINDS[:3])
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", size(a).alias("n_assign"), size(b).alias("n_access"), size(h).alias("n_hex"), F.sha2(joined(a, b, h), 256).alias("base_sha256"), joined(a, b, h, added).alias("spans"), size(added).alias("n_random"))
