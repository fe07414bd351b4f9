import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palaver.llm import bpe

PATH = bpe.default_vocabulary()
MODEL = bpe.BpeModel(bpe.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", " ", "Hello World's don't", "ΑΣ ΣΑΣ İx", "a\x1cb\x85c d　e", "x<|endoftext|>Y <|startoftext|>", "é ́a", "𝟙½Ⅷ 12 ''s !!'re", "日本語 ñandú", "a" * 3000, "​﻿᠎", "café's"]


def same(text):
    ids, decoded = MODEL.encode(text)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert [x[0] for x in struct.iter_unpack("<I", ids)] == want
    assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_matches_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_matches_the_library_on_any_text(text):
    same(text)


def test_documents(spark):
    rows = [(1, "One two"), (2, None), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens")
    out = sorted(bpe.encode_documents(df, bpe.read_vocabulary(PATH), digests=True).collect(), key=str)
    assert len(out) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out if r.doc_id == 2] == [(0, empty, empty)] * 2
    full = {r.doc_id: r for r in bpe.encode_documents(df, bpe.read_vocabulary(PATH)).collect()}
    assert full[1].decoded == "one</w> two</w>" and len(full[1].ids) == full[1].n_tokens == 2
    assert bpe.encode_documents(df.limit(0), bpe.read_vocabulary(PATH)).count() == 0


def test_kept_words_are_bounded():
    model = bpe.BpeModel(bpe.read_vocabulary(PATH))
    model._words, model._pieces = bpe.Recent(200_000), bpe.Recent(100_000)
    text = " ".join(f"w{k}x" for k in range(20_000))
    assert model.encode(text) == MODEL.encode(text)
    for kept in (model._words, model._pieces):
        assert 0 < len(kept) + len(kept.old) < 200_000 / bpe.ENTRY_BYTES + 2
    long = "日本語テキスト" * 5000
    assert model.encode(long) == MODEL.encode(long) and long not in model._words and long not in model._words.old
    known = model.encode("w1x w19999x")
    assert known == MODEL.encode("w1x w19999x")


def test_long_texts_without_spaces(spark):
    text = "".join(chr(0x4E00 + k % 300) for k in range(60_000))
    df = spark.createDataFrame([(k, text + str(k)) for k in range(3)], "doc_id bigint, text string")
    want = {k: len(LIBRARY.encode(text + str(k), add_special_tokens=False).ids) for k in range(3)}
    assert {r.doc_id: r.n_tokens for r in bpe.encode_documents(df, bpe.read_vocabulary(PATH), digests=True).collect()} == want


def test_short_pieces_merge_as_long_ones_without_a_heap(monkeypatch):
    model = bpe.BpeModel(bpe.read_vocabulary(bpe.default_vocabulary()))
    draw = random.Random(7)
    pieces = ["".join(draw.choice("aaabbelnst" if k % 3 else "aéß0中z") for _ in range(draw.randrange(1, 90))) for k in range(400)] + ["a" * 47, "a" * 48, "a" * 49]
    with monkeypatch.context() as m:
        m.setattr(bpe, "SHORT", 0)
        want = [model.encode_piece(p) for p in pieces]
    assert [model.encode_piece(p) for p in pieces] == want

    def refused(*_):
        raise AssertionError("a heap for a short piece")

    monkeypatch.setattr(bpe, "heapify", refused)
    assert model.encode_piece("thinestouble") and len(model.encode_piece("abcdefgh" * 6)) > 0
