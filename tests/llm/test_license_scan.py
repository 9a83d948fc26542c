import random
import re
from collections import Counter

from alertweave.llm.license_scan import FURTHER, LOOKALIKES, NOTICES, Scanner, budget, license_scan

from . import util


def brute(text):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, lab) for p, lab in NOTICES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({lab for _, lab in places}))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = license_scan(docs).collect()
    assert any(r.n_base for r in got)
    for r in got:
        assert base(r) == brute(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_edits_are_found_and_other_licenses_left_alone():
    scan = Scanner(NOTICES, FURTHER, LOOKALIKES)
    for text, labels in [
        ("released Under the MTI License.", "mit"),
        ("see apache licence version 2", "apache-2"),
        ("see apache licnse versoin 2", ""),
        ("under the bsd license", ""),
        ("apache license version 1", ""),
        ("cc by nd", "cc-by-nd"),
        ("cc by n", ""),
        ("ccby nc 4.0", "cc-by-nc"),
        ("CC BV-NC", "cc-by-nc"),
        ("cc by", ""),
        ("under the mpl license", "mpl-2"),
        ("under the GNU General Pubilc License, version 3.", "gpl-3"),
        ("gnu general public license version 4", ""),
        ("under the gpl license", ""),
        ("mit under the mit licensex under the mit license", "mit"),
        ("CC-BY-NC and under\nthe mit license", "cc-by-nc,mit"),
        ("thereunder the mit license", ""),
        ("under the mit licenses", "mit"),
    ]:
        assert scan(text.encode())["labels"] == labels, text
    assert scan(b"x under the mitt license y")["spans"] == [{"label": "mit", "first": 1, "words": 4, "edits": 1}]


def test_awkward_rows(spark):
    docs = util.doc_rows() + [(20, "under the mit license under the MIT license", "en", "a", 1)]
    got = license_scan(util.clashing(util.docs(spark, docs))).collect()
    assert sorted(map(str, map(base, got))) == sorted(str(brute(t)) for _, t, *_ in docs)
    assert license_scan(util.docs(spark, [])).collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            was, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, was + (x != y))
    return row[-1]


def apart(a, b):
    x, y = Counter(a), Counter(b)
    return distance(a, b), sum((x - y).values()) + sum((y - x).values())


def nearest(text):
    """All stretches of whole words within the budget, by edit distance alone."""
    words = text.split()
    every = [*NOTICES, *FURTHER]
    out = set()
    for phrase, label in every:
        k = budget(phrase)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                own = " ".join(words[i:j])
                if abs(len(own) - len(phrase)) > k or re.findall(r"\d", own) != re.findall(r"\d", phrase):
                    continue
                d = distance(own, phrase)
                others = [p for p, lab in every if lab != label] + LOOKALIKES
                if d <= k and (d == 0 or all(apart(own, o) > apart(own, phrase) for o in others)):
                    out.add((label, i, j - i, d))
    return out


def damaged(phrase, rng, n):
    for _ in range(n):
        i = rng.randrange(len(phrase))
        if phrase[i].isdigit():
            continue
        phrase = rng.choice([phrase[:i] + phrase[i + 1 :], phrase[:i] + rng.choice("aeiost ") + phrase[i:], phrase[:i] + rng.choice("aeiost") + phrase[i + 1 :]])
    return " ".join(phrase.split())


def test_fuzzy_matches_against_edit_distance():
    rng = random.Random(6)
    scan = Scanner(NOTICES, FURTHER, LOOKALIKES)
    fill = "the of license under version 2 3 public apache cc by nc mit gnu general thelicense".split()
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += [rng.choice(fill) for _ in range(rng.randint(0, 3))]
            phrase = rng.choice([*NOTICES, *FURTHER])[0]
            parts.append(damaged(phrase, rng, rng.randint(0, budget(phrase) + 1)))
        text = " ".join(" ".join(parts).split())
        spans = {(s["label"], s["first"], s["words"], s["edits"]) for s in scan(text.encode())["spans"]}
        want = nearest(text)
        assert spans <= want, (text, spans - want)
        for label, i, n, d in want - spans:  # only what overlaps a better or earlier one
            assert any(lab == label and a < i + n and i < a + m and (e, a) <= (d, i + n) for lab, a, m, e in spans), (text, label, i, n, d)


def test_recall_on_planted_edits(spark):
    rng = random.Random(7)
    docs, want = [], {}
    for i in range(600):
        phrase, label = rng.choice(NOTICES)
        text = damaged(phrase, rng, rng.randint(1, budget(phrase)))
        docs.append((i, f"some words before, {text}; and after", "en", "a", 1))
        want[i] = label
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan(util.docs(spark, docs)).collect()}
    assert sum(want[i] in got[i] for i in want) >= 0.9 * len(want)
