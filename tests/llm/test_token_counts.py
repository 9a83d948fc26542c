import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from alertweave.llm.token_counts import counting, token_counts

from . import util

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id].n_tokens == by_library(r.text)
        assert got[r.doc_id].n_bytes == len(r.text.encode())


def test_awkward_rows(spark):
    rows = token_counts(util.clashing(util.docs(spark)), PATH, limit=100).collect()
    assert len(rows) == len(util.doc_rows())
    want = sorted((str(d), by_library(t), by_library(t) > 100) for d, t, *_ in util.doc_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts(util.docs(spark, []), PATH).collect() == []


def test_special_strings_and_odd_characters():
    for text in ("a<|endoftext|>b", "<|startoftext|>", "x <|y|> it's We'Ll", "ΑΣ Σ İstanbul", "a\x1cb\x1fc", "é̂ ﬁ ①", "ª²¼ _-_ 1234", "q" * 3000, "  x"):
        assert counting(PATH)(text) == by_library(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert counting(PATH)(text) == by_library(text)


def test_very_long_words():
    """Words of hundreds of thousands of characters; the memo keeps none of them."""
    rng = random.Random(3)
    for text in ("ab" * 150_000, "".join(rng.choice("etaoin") for _ in range(200_000)), "!?" * 100_000, "é" * 50_000):
        count = counting(PATH)
        assert count(text) == by_library(text)
        assert max(map(len, [*count.memo, *count.mapped]), default=0) <= 64
