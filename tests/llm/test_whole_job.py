"""Whole jobs of the corpus operators, where a narrower one would pass unnoticed."""

import math
import random
import re
import time

import corpus_pipeline
from alertweave.llm import secret_scan

from . import util
from .test_near_dedup import brute, edited, family


def test_near_duplicates_stage_links_at_080(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words), " ".join(words[:40] + ["x"] + words[41:120] + ["y"] + words[121:160] + ["z"] + words[161:180] + ["u"] + words[181:])]
    texts += [edited([f"v{k}" for k in range(200)], rng, n) for n in (1, 2, 2, 3, 4)] + family(rng, 40)
    docs = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    kept = lambda percent: {int(d) for d, _, _, k in brute(docs, percent) if k}
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, util.docs(spark, docs), "").collect())
    assert got == sorted(kept(80)) and 1 in kept(85) - kept(80)


def test_secrets_after_names_and_in_mixed_runs(spark):
    rng = random.Random(8)
    draw = lambda k, n: "".join(rng.choice(secret_scan.ALPHABETS[k][2]) for _ in range(n))
    values = {100: draw(5, 64), 101: draw(5, 64), 102: draw(6, 64), 103: draw(5, 64), 104: draw(5, 64)}
    texts = {
        100: f"see session={values[100]} here",
        101: f"GET https://a.example/p?sig={values[101]}&n=1",
        102: f"auth={values[102]}== end",
        103: f"\U0001f600 my-app_key/{values[103]}",
        104: f"no name {values[104]} at all",
        105: "a-long-kebab-name/of-many-parts/with-words-only and_so_on+that_is_no_secret=plain",
    }
    docs = [(d, t, "en", "a", 1) for d, t in texts.items()]
    got = {r.doc_id: r for r in secret_scan.secrets(util.docs(spark, docs)).collect()}
    for d, v in values.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[d].spans.split(",") if s.startswith("random:")]
        found = [texts[d][a:b].rstrip("=") for a, b in spans]
        assert found in ([v], ["key/" + v]), d  # the widest accepted part of a mixed run
    assert got[105].n_random == 0


def test_candidates_against_brute_force(spark):
    """Places of all candidates: whole runs, or of mixed ones the parts."""
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice(["a", "Bc9", "+", "/", "_", "-", "=", " ", "word" * 6, "é", "x" * 21]) for _ in range(60)), "en", "a", 1) for i in range(60)]

    def places(text):
        for run in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
            if set(run[0]) & set("+/") and set(run[0]) & set("_-"):
                for p in ("+/", "_-"):
                    yield from {(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(rf"[A-Za-z0-9{p}]{{20,}}={{0,2}}", run[0])}
            else:
                yield run.span()

    got = {r.doc_id: sorted((c["first"], c["end"]) for c in r.candidates) for r in secret_scan.scanned(util.docs(spark, docs)).collect()}
    assert got == {d: sorted(set(places(t))) for d, t, *_ in docs}


def evidence(core, m):
    """The log likelihood ratio of a uniform draw to text, character by character."""
    shares = [0.85 * x / sum(secret_scan.LETTER_SHARES) + 0.15 / 26 for x in secret_scan.LETTER_SHARES]
    total, kind, vowel = 0.0, 4, None
    for c in core:
        k = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
        v = int(c.lower() in "aeiou") if k < 2 else None
        text = secret_scan.KIND_SHARES[kind][k] * (shares[ord(c.lower()) - 97] if k < 2 else 0.1 if k == 2 else 0.5)
        if vowel is not None and v is not None:
            text *= secret_scan.SERIAL_RATIOS[2 * vowel + v]
        total, kind, vowel = total - math.log(m) - math.log(text), k, v
    return total


def battery(text):
    """The tests on one string, in plain arithmetic: tenths of a decade of p, or None."""
    core = text.rstrip("=")
    fits = [a for _, rx, a in secret_scan.ALPHABETS if re.search(rx, core)]
    n = len(core)
    if not fits or n < 16:
        return None
    letters, m = fits[0], len(fits[0])
    i = [letters.index(c) + 1.0 for c in core]
    chi = m / n * sum(i.count(v) ** 2 for v in set(i)) - n
    z_chi = (chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n)
    high = [v > (m + 1) / 2 for v in i]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    h = sum(high)
    mean_runs = 1 + 2 * h * (n - h) / n
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = (runs - mean_runs) / math.sqrt(var_runs) if var_runs > 0 else 99.0
    mean = sum(i) / n
    var = sum(v * v for v in i) / n - mean * mean
    cov = sum((a - mean) * (b - mean) for a, b in zip(i, i[1:])) / n
    z_serial = cov / var * math.sqrt(n) if var > 1e-12 else 99.0
    if z_chi >= 3.29 or abs(z_runs) >= 3.29 or abs(z_serial) >= 3.29:
        return None
    return max(0, min(math.floor(10 * evidence(core, m) / math.log(10)), 400))


def accepted(ps, share):
    """Benjamini-Hochberg, p-value by p-value."""
    order = sorted((10 ** (-p / 10) if p is not None else 1.0) for p in ps)
    cut = max((q for k, q in enumerate(order, 1) if q * len(order) <= share * k and q < 1.0), default=None)
    return [p is not None and cut is not None and 10 ** (-p / 10) <= cut * (1 + 1e-12) for p in ps]


def strings(rng, n):
    draw = lambda k, m: "".join(rng.choice(secret_scan.ALPHABETS[k][2]) for _ in range(m))
    word = lambda: "".join(rng.choice("eeeetttaaoinshrdlucmfwypvbgk") for _ in range(rng.randint(3, 9)))
    for i in range(n):
        k = i % 4
        if k == 0:
            yield draw(rng.choice([2, 3, 4, 5, 6, 7]), rng.randint(20, 80))
        elif k == 1:
            yield "".join(word().title() for _ in range(8))
        elif k == 2:
            yield "_".join(word() for _ in range(6))
        else:
            yield rng.choice(["a" * 30, "ab" * 20, "0123456789" * 3, "abcdefghijklmnopqrstuvwxyz", draw(5, 12) * 3, "A1b2" * 9])


def test_battery_and_false_discovery_against_plain_arithmetic(spark):
    rng = random.Random(10)
    texts = list(strings(rng, 800))
    docs = [(i, f"x {t} y", "en", "a", 1) for i, t in enumerate(texts)]
    found = {r.doc_id: r.candidates for r in secret_scan.scanned(util.docs(spark, docs)).collect()}
    got, want = [], []
    for i, t in enumerate(texts):
        if len(found[i]) == 1 and (found[i][0]["first"], found[i][0]["end"]) == (2, 2 + len(t)):
            got.append(found[i][0]["p"])
            want.append(battery(t))
    assert len(got) > 600 and sum(g != w for g, w in zip(got, want)) <= 2  # rounding at an edge of a tenth
    hist = [(p, got.count(p)) for p in set(got)]
    least = secret_scan.threshold(hist, 0.01)
    assert [p is not None and least is not None and p >= least for p in got] == accepted(got, 0.01)


NOUNS = "account admin audit backup batch buffer cache client cluster config context count customer date default delete detail device domain error event export factory field filter folder group handler header history import index input invoice item layer level limit local login manager member memory message method metric module monitor number object offset option order output owner packet parser partner password payment policy process product profile project query queue record region remote report request resource response result router schema search secret server service session setting shard signal source status storage stream string student summary supplier support system table target template tenant thread ticket token topic tracker traffic transfer update upload user value vendor version view volume warehouse window worker writer".split()


def harmless(rng):
    """A name as code and paths have it, of 20 to 60 characters."""
    while True:
        words = [rng.choice(NOUNS) for _ in range(rng.randint(2, 7))]
        number = str(rng.choice([rng.randint(1, 99), rng.randint(2000, 20_301_231)]))
        name = rng.choice(["".join(w.title() for w in words), "_".join(words), "-".join(words), "/".join(words), "".join(w.title() for w in words) + number, "_".join(words) + "_" + number, "".join(words), "-".join([*words, number[:4], number[4:]]), "_".join(words).upper()])[:60]
        if len(name) >= 20:
            return name


def test_power_and_false_share_on_planted_secrets(spark):
    """At one and at four secrets among a hundred names, by length."""
    for names, each in ((4000, 10), (3000, 30)):
        rng = random.Random(12 + names)
        draw = lambda m: "".join(rng.choice(secret_scan.ALPHABETS[5][2]) for _ in range(m))  # noqa: B023, E731
        real = {100 * n + i: draw(n) for n in (20, 24, 32, 40) for i in range(each)}
        text = {100_000 + i: harmless(rng) for i in range(names)} | {200_000 + i: t for i, t in enumerate(strings(rng, 400)) if i % 4 in (1, 2)}
        docs = [(i, f"see {t} here", "en", "a", 1) for i, t in (real | text).items()]
        got = {r.doc_id: r.n_random for r in secret_scan.secrets(util.docs(spark, docs)).collect()}
        power = {n: sum(got[100 * n + i] == 1 for i in range(each)) / each for n in (20, 24, 32, 40)}
        false = sum(got[i] for i in text) / max(1, sum(got.values()))
        print("secrets", 4 * each, "of", names, "power", power, "false share", false)
        assert min(power[32], power[40]) >= 0.9 and min(power[20], power[24]) >= 0.6 and false <= 0.02


def test_long_texts_of_many_matches(spark):
    docs = [(1, "token=abcdef " * 30_000, "en", "a", 1), (2, "x" * 400_000 + " " + "0a" * 200_000, "en", "a", 1), (3, " ".join(f"{i:024x}z{i:030d}" for i in range(8_000)), "en", "a", 1)]
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.secrets(util.docs(spark, docs)).collect()}
    assert got[1].n_assign == 30_000 and got[2].n_hex == 1 and got[3].n_hex == 16_000
    assert got[1].spans.startswith("assign:0:12,assign:13:25") and got[1].spans.endswith("assign:389987:389999")
    assert time.time() - began < 120
