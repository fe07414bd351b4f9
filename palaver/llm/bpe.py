"""Operator 7: byte-pair encoding and decoding.

``encode_documents`` tokenises whole texts with a vocabulary file of the ``tokenizers`` library (BPE with word
ends) and decodes the ids again.  A word is encoded by a priority queue of merge ranks over a doubly linked list
of symbols; entries whose pair has changed meanwhile are stale and skipped.  Decoding concatenates vocabulary
strings, parted by the spaces that the library puts where a file names no decoder.

Cases: null and empty texts have no tokens and decode to the empty text; a text of white space only, too.
Special tokens that stand in a text become their own ids.  Repeated rows give repeated results, columns other
than the id and the text are not looked at, an empty table gives an empty table.  Memory: texts are encoded one at a
time; each Python worker keeps what it has encoded last, at most ``CACHE_BYTES`` of it, and nothing of words that are
longer than ``LONGEST_KEPT``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from palaver.llm.shared import table, worker_state

#: Bytes of the words and pieces kept with their ids in each worker, about; it bounds memory only.
CACHE_BYTES = 64 << 20
#: What an entry takes besides the characters of its word and its ids.
ENTRY_BYTES = 170
#: Characters of the longest word or piece that is kept.
LONGEST_KEPT = 64

#: Symbols of the longest piece whose queue is a plain list.
SHORT = 48
NO_RANK = 1 << 62

_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and digits of Unicode 17 that the library's tables (Unicode 16) do not have yet.
_LATER = regex.compile(
    "["
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    "]"
)
# Capitals of Unicode 16 and 17 that the library lower-cases and Python's tables may not know yet.
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _CAPITALS)) + "]")
_NOT_ONIG_SPACE = regex.compile("[\x1c-\x1f]")
_SPLIT_SPACE = regex.compile(f"[^{_SPACES}]+")
SCHEMA_TOKENS = "doc_id bigint, ids array<bigint>, n_tokens bigint, decoded string"
SCHEMA_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 is itself, the rest follow from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class Recent(dict):
    """Ids of what was looked up last, in two generations that together hold about ``most`` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.room = self.half = most // 2
        self.old: dict[str, bytes] = {}

    def older(self, key: str) -> bytes | None:
        """The value of a key that is not in the younger generation; it joins that generation."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(key) > LONGEST_KEPT:
            return
        self.room -= ENTRY_BYTES + len(key) + len(value)
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = self.half
        self[key] = value


class BpeModel:
    """A BPE vocabulary with word ends, read from the JSON text of a ``tokenizers`` file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("this reader knows BPE files with NFC, white-space and lower-case steps and no decoder")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", _SPACES))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # every symbol by rank of the merge that makes it; pairs are keyed by left << 32 | right
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(self.vocab[left] << 32 | self.vocab[right], rank)
            self.made.append(self.vocab[left + right])
        chars = byte_characters()
        self.inner = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]
        self._pieces, self._words = Recent(CACHE_BYTES // 8), Recent(CACHE_BYTES * 7 // 8)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n = len(symbols)
        ranks = self.ranks
        if n <= SHORT:
            return self._merge_short(symbols)
        # an entry is rank << 32 | place of the left symbol: the lowest rank first, the leftmost of equal ranks
        queue = []
        left = -1
        for i, right in enumerate(symbols):
            if left >= 0 and (rank := ranks.get(left << 32 | right)) is not None:
                queue.append(rank << 32 | (i - 1))
            left = right
        if not queue:
            return symbols
        heapify(queue)
        made = self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: one of its two symbols has been merged away
            symbols[i] = new = made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(new << 32 | symbols[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := ranks.get(symbols[h] << 32 | new)) is not None:
                heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """The same merges for few symbols: the queue is the list of the neighbours' ranks, its least and leftmost found by a scan."""
        get, made = self.ranks.get, self.made
        queue = [get(left << 32 | right, NO_RANK) for left, right in zip(symbols, symbols[1:])]
        while queue and (rank := min(queue)) < NO_RANK:
            i = queue.index(rank)
            symbols[i] = new = made[rank]
            del symbols[i + 1], queue[i]
            if i < len(queue):
                queue[i] = get(new << 32 | symbols[i + 1], NO_RANK)
            if i:
                queue[i - 1] = get(symbols[i - 1] << 32 | new, NO_RANK)
        return symbols

    def _split(self, word: str) -> list[str]:
        """Pre-tokens; what the library's older Unicode tables don't hold is no letter or digit."""
        if word.isascii() or not _LATER.search(word):
            return self.pieces.findall(word)
        return [word[m.start() : m.end()] for m in self.pieces.finditer(_LATER.sub("\u0378", word))]

    def _packed(self, piece: str) -> bytes:
        ids = self.encode_piece(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        kept = self._pieces
        found = kept.get(piece)
        if found is None and (found := kept.older(piece)) is None:
            found = self._packed(piece)
            kept.keep(piece, found)
        return found

    def _word(self, word: str) -> bytes:
        """Ids, four little-endian bytes each, of what stands between two white spaces."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            if _CAPITAL.search(word):
                word = word.translate(_CAPITALS)
        low = word.lower()
        if low.isalpha() and (low.isascii() or not _LATER.search(low)):
            return self._packed(low)
        return b"".join(map(self._piece, self._split(low)))

    def decode(self, raw: bytes) -> str:
        """The vocabulary strings of packed ids, parted by spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(raw, "<u4").tolist()))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        parts = _SPLIT_SPACE.findall(text) if _NOT_ONIG_SPACE.search(text) else text.split()
        kept = self._words
        found = list(map(kept.get, parts))
        if None in found:
            for k, raw in enumerate(found):
                if raw is None:
                    word = parts[k]
                    raw = kept.get(word)
                    if raw is None and (raw := kept.older(word)) is None:
                        raw = self._word(word)
                        kept.keep(word, raw)
                    found[k] = raw
        return b"".join(found)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, and the decoded text."""
        ids: list[bytes] = []
        if text:
            special = self.special
            if self.cut is not None and any(s in text for s in special):
                for part in self.cut.split(text):
                    if part in special:
                        ids.append(struct.pack("<I", special[part]))
                    elif part:
                        ids.append(self._plain(part))
            else:
                ids.append(self._plain(text))
        raw = b"".join(ids)
        return raw, self.decode(raw)


def read_vocabulary(path: str, max_bytes: int = 64 << 20) -> str:
    """The vocabulary file's text; files above ``max_bytes`` are refused because it is sent to every worker."""
    with open(path, encoding="utf-8") as f:
        text = f.read(max_bytes + 1)
    if len(text) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return text


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, ids, number of tokens and decoded text; or with ``digests`` their SHA-256 in place of both."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = worker_state("bpe", hash(source.value), lambda: BpeModel(source.value))
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                raw, words = model.encode(text.as_py())
                counts.append(len(raw) // 4)
                if digests:
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(words.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
                    decoded.append(words)
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA_DIGESTS if digests else SCHEMA_TOKENS)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), read_vocabulary(default_vocabulary()), digests=True)
