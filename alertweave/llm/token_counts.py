"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of byte symbols, the last one marked as the word's
end. A heap holds the adjacent pairs that have a merge rank; the lowest rank (then the
leftmost) is popped and merged until none is left. A word's count is its number of symbols
less its merges; no identifier is looked up.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special token's string
inside a text counts as one token, as the library does by default; texts are never cut;
repeated rows are counted each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct white-space-free chunks whose counts a worker remembers, and the longest of them.
MEMO, MEMO_LENGTH = 200_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    live = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        live -= 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        right[j] = -1
        if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return live


class Counting:
    """Counts texts as the vocabulary file at ``path`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ranks = {(m[0], m[1]) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.odd = regex.compile("[\x1c-\x1f]")
        self.memo: dict[str, int] = {}
        self.mapped: dict[str, int] = {}

    def of_symbols(self, mapped: str) -> int:
        if (n := self.mapped.get(mapped)) is None:
            n = merge_count([*mapped[:-1], mapped[-1] + self.suffix], self.ranks)
            if len(mapped) <= MEMO_LENGTH:
                if len(self.mapped) >= MEMO:
                    self.mapped.clear()
                self.mapped[mapped] = n
        return n

    def of_chunk(self, chunk: str) -> int:
        letters = self.alphabet
        return sum(self.of_symbols("".join([letters[b] for b in w.encode()])) for w in self.words.findall(chunk))

    def of_plain(self, text: str) -> int:
        """A stretch without special tokens. Characters up to U+00FF are composed already
        and have simple lower case; anything else goes through the library's normalizer
        and splitter."""
        try:
            text.encode("latin-1")
            simple = not self.odd.search(text)
        except UnicodeEncodeError:
            simple = False
        if not simple:
            return sum(self.of_symbols(w) for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text)))
        total, memo = 0, self.memo
        for chunk, times in Counter(text.lower().split()).items():
            if (n := memo.get(chunk)) is None:
                n = self.of_chunk(chunk)
                if len(chunk) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[chunk] = n
            total += n * times
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.of_plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.of_plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.of_plain(text[at:])


@cache
def counting(path: str) -> Counting:
    """One per worker process."""
    return Counting(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for each row of ``docs``.

    ``vocabulary`` is the path of a tokenizers .json file that every executor has. One
    pass, no shuffle; a worker holds the merge ranks and a bounded memo of chunk counts."""

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        count = counting(vocabulary)
        for p in parts:
            n = [count(t) for t in p["text"]]
            yield {"id": p["id"], "n_bytes": [len(t.encode()) if t else 0 for t in p["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    out = common.map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, common.schema_of(("id", docs.schema[id_col].dataType), "n_bytes bigint, n_tokens bigint, over_limit boolean"))
    return out.withColumnRenamed("id", id_col)
