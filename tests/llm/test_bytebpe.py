import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palaver.llm import bytebpe
from palaver.llm.bpe import read_vocabulary

SOURCE = read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
MODEL = bytebpe.ByteBpe(SOURCE, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=MODEL.machine.ranks, special_tokens={})
CASES = ["", " ", "  ", "a  b", "a \t b\n", "x \n y ", "it's  'tis I'll", "a\n\n b ", "日本語 テキスト", "𝟙½Ⅷ 12 ''s", "🎉🎉 é", "<|endoftext|>", "a" * 3000, "\x1c\x85 　", "ab" * 50 + " .", "՘ Ᲊ"]


def same(text, model=MODEL):
    raw = model.encode(text)
    assert [x[0] for x in struct.iter_unpack("<I", raw)] == LIBRARY.encode_ordinary(text)
    assert model.decode(raw) == text


@pytest.mark.parametrize("text", CASES)
def test_matches_the_library(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_matches_the_library_on_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text("theroinsadl ", max_size=60))
def test_matches_the_library_on_words(text):
    same(text)


def test_every_byte_string(monkeypatch):
    """Whatever is kept, read by branches or made anew."""
    import random

    draw = random.Random(4)
    monkeypatch.setattr(bytebpe, "REST", 3)
    monkeypatch.setattr(bytebpe, "MOVES", 50)
    machine = bytebpe.Transducer(MODEL.machine.ranks)
    for k in range(400):
        raw = bytes(draw.choice(b"theroins ,\xc3\xa9\xe6\x97") for _ in range(draw.randrange(1, 400 if k % 20 == 0 else 30)))
        assert [x[0] for x in struct.iter_unpack("<I", machine.encode(raw))] == LIBRARY._encode_single_piece(raw)
        assert len(machine.moves) <= 160


def test_neighbours_by_definition():
    """Two tokens may be neighbours if and only if merging their bytes gives the two."""

    def merged(raw):
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], MODEL.machine.ranks
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    import random

    draw = random.Random(2)
    ids = [i for i in MODEL.machine.right if i < 3000]
    for _ in range(3000):
        a, b = draw.choice(ids), draw.choice(ids)
        assert MODEL.machine._neighbours(a, b) == (merged(MODEL.machine.bytes_of[a] + MODEL.machine.bytes_of[b]) == [a, b])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=12), st.integers(1, 5))
def test_streaming_decoder(data, size):
    """Any bytes, in parts of any size, as Python decodes the whole."""
    machine = MODEL.machine
    ids = [machine.ranks[bytes([b])] for b in data]
    decoder = bytebpe.StreamingDecoder(machine.bytes_of, {})
    parts = [decoder.feed(ids[k : k + size]) for k in range(0, len(ids), size)]
    assert "".join(parts) + decoder.close() == bytes(data).decode("utf-8", "replace")


def test_streaming_decoder_gives_whole_characters():
    decoder = bytebpe.StreamingDecoder(MODEL.machine.bytes_of, {})
    ids = [MODEL.machine.ranks[bytes([b])] for b in "é🎉".encode()]
    assert [decoder.feed([i]) for i in ids] == ["", "é", "", "", "", "🎉"]
    assert decoder.close() == ""


def test_documents(spark):
    long = "".join(chr(0x4E00 + k % 900) for k in range(400_000))
    rows = [(1, "One two  three"), (2, None), (2, None), (3, ""), (None, "x"), (4, long), (5, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "named_struct('a b', 1) as `ids``x`")
    out = bytebpe.encode_documents(df, SOURCE, public_tokenizers.PATTERN, digests=True).collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for i, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode())))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    full = bytebpe.encode_documents(df, SOURCE, public_tokenizers.PATTERN)
    assert {r.doc_id: r.decoded for r in full.collect()} == {i: t or "" for i, t in rows}
    assert {r.doc_id: r.decoded for r in bytebpe.decode_documents(full, SOURCE).collect()} == {i: t or "" for i, t in rows}
    assert full.limit(0).count() == 0 and bytebpe.encode_documents(df.limit(0), SOURCE, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 0])], "doc_id bigint, ids array<bigint>")
    assert [r.decoded for r in bytebpe.decode_documents(odd, SOURCE).orderBy("doc_id").collect()] == ["", "", MODEL.machine.bytes_of[0].decode()]
    with pytest.raises(ValueError):
        bytebpe.read_ranks("YQ== 0")
