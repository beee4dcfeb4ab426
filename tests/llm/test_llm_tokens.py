from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["<|endoftext|>", " the", "'s", "'ll", "  ", "\n\n", "\t", "\x1c", "\x85", " ", " ", "​",
         "՘", "\U00010940", "\U0001e6c0", "漢字", "½", "²", "é", "1", "!", "don't", "'", " '", "\U0001f600"]
TEXT = st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=12).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@given(TEXT)
@settings(max_examples=500, deadline=None)
def test_counts_are_the_librarys(text):
    library = Tokenizer.from_file(PATH) if not hasattr(tokens, "_test") else tokens._test
    tokens._test = library
    assert tokens.counted(PATH).count(text) == wanted(library, text)


def test_proven_strings_are_one_token(library):
    whole = tokens.counted(PATH).whole
    assert len(whole) > 45_000
    for text in sorted(whole)[::97]:
        assert wanted(library, text) == 1


def test_pieces_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.Counted(PATH)
    for text in ("word  other\n\n x" * 50, "a" * 500, " " * 300 + "zzqx vvkj qqxz kkwq jjjj" * 9, "x<|endoftext|> y" * 30):
        assert counter.count(text) == wanted(library, text)


def test_table(spark, make_docs, library):
    texts = [None, "", "Hello world", "Hello world", "<|endoftext|>" * 3, "é" * 600, "long text " * 50_000]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "x", "s"), (2, "Hello world", None)]
    got = tokens.token_counts(make_docs(rows), PATH).collect()
    by_id = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        n = wanted(library, by_id[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((by_id[r.doc_id] or "").encode()), n, n > 512)
    assert tokens.token_counts(make_docs([]), PATH).count() == 0
