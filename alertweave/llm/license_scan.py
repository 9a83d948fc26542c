"""License scans: fuzzy short-notice search.

Each notice phrase is split into (edits + 1) pieces, so a stretch within ``edits``
insertions, deletions or substitutions of it holds one piece unchanged (pigeonhole). The
pieces are searched exactly; around each hit the regex library matches each stretch of whole
words that lies within reach against the whole phrase with bounded errors, and gives the
edits. So every stretch of whole words within ``edits`` is found. Of overlapping ones of a
label the one with the fewest edits is reported.

Every phrase may have an edit for each ten characters that it has, and one at least, digits
excepted: another number
names another license. A stretch that is as near to another license's notice as to the
phrase is left alone; of equal edits the one decides whose letters differ less, in any order.

Texts are compared as words ``[0-9a-z]`` or non-ASCII, A-Z lowered, joined by single
spaces. Defined results: null and empty texts have no words, no labels and score 0; ties
between overlapping approximate matches go to fewer edits, then to the earlier start;
repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Another number names another license, so digits are no typing errors.
DIGITS = re.compile(rb"[0-9]")

#: The base notice phrases and their labels.
NOTICES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Notices that the method labels besides.
FURTHER = [
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("bsd 2 clause license", "bsd-2"),
    ("bsd 3 clause license", "bsd-3"),
    ("boost software license", "boost"),
    ("eclipse public license", "epl"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("under the isc license", "isc"),
    ("under the mpl license", "mpl-2"),
]
#: Notices of other licenses that are within reach of a phrase, and words of everyday use.
LOOKALIKES = ["under the bsd license", "under the gpl license", "under the epl license", "under the ms license", "under the it license", "apache license version", "gnu general public license version", "cc by", "cc by ncsa"]


def budget(phrase: str) -> int:
    """Edits allowed: one for each ten characters that the phrase has, and one at least."""
    return max(1, len(phrase) // 10)


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 stretches of near equal length that cover the phrase."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def fuzzily(phrase: bytes, edits: int) -> regex.Pattern:
    """Matches whole stretches within ``edits`` of the phrase, with the fewest edits."""
    return regex.compile(b"(?be)(?:" + regex.escape(phrase) + b"){e<=%d}" % edits)


def letters_apart(a: bytes, b: bytes) -> int:
    x, y = Counter(a), Counter(b)
    return sum((x - y).values()) + sum((y - x).values())


class Scanner:
    def __init__(self, notices: list[tuple[str, str]], further: list[tuple[str, str]], lookalikes: list[str]):
        self.plans = []
        every = [p for p, _ in [*notices, *further]] + lookalikes
        for at, (phrase, label) in enumerate([*notices, *further]):
            k = budget(phrase)
            seeds = [(a, s.encode()) for a, s in pieces(phrase, k)]
            labels = {p: lab for p, lab in [*notices, *further]}
            others = [(p.encode(), fuzzily(p.encode(), k)) for p in every if labels.get(p) != label and abs(len(p) - len(phrase)) <= 2 * k]
            self.plans.append((phrase.encode(), label, k, seeds, fuzzily(phrase.encode(), k), others, at < len(notices)))
        #: One exact search tells whether a text can hold anything at all.
        self.any = re.compile(b"|".join(re.escape(s) for s in sorted({s for p in self.plans for _, s in p[3]})))

    def base(self, line: bytes) -> list[tuple[int, str]]:
        """(first byte, label) of each place where a phrase's words stand consecutively in
        the space-joined ``line``."""
        out = []
        for phrase, label, *_ in (p for p in self.plans if p[-1]):
            at = line.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (at == 0 or line[at - 1] == 32) and (end == len(line) or line[end] == 32):
                    out.append((at, label))
                at = line.find(phrase, at + 1)
        return out

    @staticmethod
    def nearer(stretch: bytes, phrase: bytes, edits: int, others: list[tuple[bytes, regex.Pattern]]) -> bool:
        """Whether the stretch is nearer to the phrase than to each of the others."""
        own = (edits, letters_apart(stretch, phrase))
        return all((m := o.fullmatch(stretch)) is None or (sum(m.fuzzy_counts), letters_apart(stretch, p)) > own for p, o in others)

    def fuzzy(self, line: bytes) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, phrase length) of matches within the budget, of whole
        words."""
        found: dict[str, dict[tuple[int, int], tuple[int, int]]] = {}
        for phrase, label, k, seeds, pattern, others, _ in self.plans:
            own = found.setdefault(label, {})
            digits = DIGITS.findall(phrase)
            tried = set()
            for at, seed in seeds:
                hit = line.find(seed)
                while hit >= 0:
                    start = hit - at  # of the phrase, give or take k
                    for s in range(max(0, start - k), start + k + 1):
                        if s in tried or (s and line[s - 1] != 32):
                            continue
                        tried.add(s)
                        for e in range(max(s + 1, s + len(phrase) - k), min(len(line), s + len(phrase) + k) + 1):
                            if e < len(line) and line[e] != 32 or line[s] == 32 or line[e - 1] == 32:
                                continue
                            m = pattern.fullmatch(line, s, e)
                            if not m or DIGITS.findall(line, s, e) != digits:
                                continue
                            edits = sum(m.fuzzy_counts)
                            if not edits or self.nearer(line[s:e], phrase, edits, others):
                                own[s, e] = min((edits, len(phrase)), own.get((s, e), (edits, len(phrase))))
                    hit = line.find(seed, hit + 1)
        out = []
        for label, own in found.items():
            took: list[tuple[int, int]] = []
            for (s, e), (edits, n) in sorted(own.items(), key=lambda x: (x[1][0], x[0])):
                at = bisect.bisect(took, (s, e))
                if (at and took[at - 1][1] > s) or (at < len(took) and took[at][0] < e):
                    continue
                took.insert(at, (s, e))
                out.append((s, e, label, edits, n))
        return sorted(out)

    def __call__(self, text: bytes | None) -> dict:
        words = WORD.findall(text.lower()) if text else []
        row = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        if not words:
            return row
        line = b" ".join(words)
        if not self.any.search(line):
            return row
        base = self.base(line)
        if base:
            starts = [line.count(b" ", 0, at) for at in (min(a for a, _ in base), max(a for a, _ in base))]
            row |= {"n_base": len(base), "first_word": min(starts), "last_word": max(starts)}
        near = self.fuzzy(line)
        word = upto = 0
        for s, e, lab, d, _ in near:  # by start
            word, upto = word + line.count(b" ", upto, s), s
            row["spans"].append({"label": lab, "first": word, "words": line.count(b" ", s, e) + 1, "edits": d})
        row["base_labels"] = ",".join(sorted({lab for _, lab in base}))
        row["labels"] = ",".join(sorted({lab for _, lab in base} | {x[2] for x in near}))
        row["score"] = 1.0 if base else max((1 - d / n for _, _, _, d, n in near), default=0.0)
        return row


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, further: list[tuple[str, str]] = FURTHER, lookalikes: list[str] = LOOKALIKES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: n_words, n_base (exact places), first_word and last_word of them,
    base_labels, labels (exact and approximate, of ``further`` notices too), score, and the
    spans of what is within the budget (label, first word, words, edits). One pass, no
    shuffle."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        scan = Scanner(notices, further, lookalikes)
        for p in parts:
            found = [scan(t) for t in p["text"]]
            yield {"id": p["id"]} | {k: [f[k] for f in found] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

    schema = common.schema_of(("id", docs.schema[id_col].dataType), "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label string, first bigint, words bigint, edits bigint>>")
    return common.map_rows(docs.select(F.col(id_col).alias("id"), common.text_bytes(text_col).alias("text")), rows, schema).withColumnRenamed("id", id_col)
