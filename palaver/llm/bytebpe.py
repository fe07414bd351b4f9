"""Operator 13: byte-level BPE encoding and decoding by a lazily determinised transducer.

A text is cut into pieces by the vocabulary's pattern, and each piece is read byte by byte.  A sequence of tokens is the BPE
encoding of its bytes if and only if each two neighbours are the encoding of the two together: the first merge across a
border would also be made in that pair alone.  So the merges compile into a transducer without any queue:

* the nondeterministic machine guesses where the token being read ends: a branch is the tokens read so far and a
  node of the trie of all tokens, and it goes back to the root at each token that may follow its last one;
* of the branches at the root exactly one is left at each byte, the encoding of what has been read; the others still read a
  longer token.  A state of the deterministic machine is that set of branches, without what they have in common: tokens at
  which all branches agree are emitted.  A branch lives no longer than the longest token, which bounds the lookahead;
* states and their transitions are made when texts need them a second time and kept, up to ``MOVES`` of them, for the worker's
  texts; what is needed once is read by the branches.  Beyond that number the worker starts anew, which costs time and
  changes no result.

Decoding is a stream: a machine over (bytes of an unfinished character, id) emits whole characters only, whatever the
ids are cut into; bytes that are no UTF-8 become U+FFFD as in Python's decoder, one for each maximal part.

Cases: null and empty texts have no tokens and decode to the empty text; texts of any length are read in one pass, at a time one;
a piece that is a token by itself is that token; repeated rows give repeated results; rows without an id keep a null
id; columns other than the id and the text are not looked at, whatever their names; an empty table gives an empty table.
No order is involved, so there are no ties: of equal pairs in a piece the leftmost is merged first.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.bpe import _LATER, Recent, read_vocabulary
from palaver.llm.shared import table, worker_state

#: Transitions kept in a worker, and pairs of tokens of which it is known whether they may be neighbours.
MOVES, PAIRS = 1_000_000, 1_000_000
#: Bytes that are read by the branches themselves where a transition is not known yet.
REST = 64
#: Tokens that a state or the rest of a piece may have open, at most: the longest token and the rest.
REST_TOKENS = 4096
#: Bytes of the pieces and words kept with their ids in each worker, about; it bounds memory only.
CACHE_BYTES = 160 << 20
#: Ids decoded at a time.
STEP = 1 << 16
SCHEMA_TOKENS = "doc_id bigint, ids array<bigint>, n_tokens bigint, decoded string"
SCHEMA_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
# White space, a space, and white space again or the end: the only places where a text may not be cut before the space.
_UNCUT = re.compile(r"\s (?:\s|\Z)")
_MARKS = frozenset(".,;:!?")
#: Of a transition: the next state, eight bits up; what is emitted stands above it.
_STATE = (1 << 40) - 1
_PACK = [struct.Struct(f"<{n}I").pack for n in range(REST_TOKENS + 1)]


def read_ranks(source: str) -> dict[bytes, int]:
    """Ranks of a vocabulary in the text form of ``tiktoken``: a token in base 64 and its rank on each line."""
    ranks = {}
    for line in source.split("\n"):
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
    return ranks


class Transducer:
    """Bytes to ids.  States are numbers; a transition is kept under state << 8 | byte as the next state and the number of what it emits."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # the trie of the tokens that merges reach: children by node << 8 | byte, and the token that ends at a node
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        # what stands at the right and at the left edge of a token while it is merged, each with the rank of the merge that ends it
        self.right: dict[int, list[tuple[bytes, int]]] = {}
        self.left: dict[int, list[tuple[bytes, int]]] = {}
        for i, token in sorted(self.bytes_of.items()):
            parts = self._parts(token)
            if parts is None:
                continue  # no merges end in it: it stands for a whole piece only
            a, b = parts if len(parts) == 2 else (None, None)
            if a is not None and max(a, b) >= i:
                raise ValueError("the parts of a token have lower ranks than the token")
            self.right[i] = [(token, 1 << 62), *([] if b is None else [(self.right[b][0][0], i), *self.right[b][1:]])]
            self.left[i] = [(token, 1 << 62), *([] if a is None else [(self.left[a][0][0], i), *self.left[a][1:]])]
            node = 0
            for byte in token:
                at = node << 8 | byte
                node = self.child.get(at, 0)
                if not node:
                    node = self.child[at] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i
        self.inner = {at >> 8 for at in self.child}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.branches: list[tuple] = []
        self.final: list[bytes] = []
        self.moves: dict[int, int] = {}
        self.emitted: dict[bytes, int] = {b"": 0}
        self.emits: list[bytes] = [b""]
        self.pairs: dict[int, bool] = {}
        self.start = self._state((-1, (((), 0),)))

    def _state(self, key: tuple) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.branches)
            self.branches.append(key)
            tail = key[1][-1][0]
            self.final.append(struct.pack(f"<{len(tail)}I", *tail))
        return found

    def _parts(self, token: bytes) -> list[int] | None:
        """The one or two ids that a token is last made of, by the definition: merge the leftmost of the pairs with the lowest rank."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(found)
            if least == 1 << 62:
                return None
            k = found.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes: no merge across their border comes before those that end its sides."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            rank, found = self.ranks.get, True
            for x, x_ends in self.right[left]:
                for y, y_ends in self.left[right]:
                    r = rank(x + y)
                    if r is not None and r < x_ends and r <= y_ends:
                        found = False
            self.pairs[key] = found
        return found

    def _advance(self, last: int, branches: list, byte: int) -> list:
        """The branches after one more byte; the last of them is the one at the root."""
        child, ends, inner, pairs = self.child.get, self.ends, self.inner, self.pairs.get
        after, root = [], None
        for branch in branches:
            tail, node = branch
            node = child(node << 8 | byte)
            if node is not None:
                token = ends[node]
                if root is None and token >= 0:
                    before = tail[-1] if tail else last
                    fits = before < 0 or pairs(before << 32 | token)
                    if fits is None:
                        fits = self._neighbours(before, token)
                    if fits:
                        root = (*tail, token)
                if node in inner:
                    after.append((tail, node))
        after.append((root, 0))
        return after

    def _step(self, state: int, byte: int) -> int:
        """The transition of a state by a byte, made now and kept."""
        last, branches = self.branches[state]
        after = self._advance(last, branches, byte)
        root, common, out = after[-1][0], 0, 0
        while len(root) > common and all(len(tail) > common and tail[common] == root[common] for tail, _ in after):
            common += 1
        if common:
            last, raw = root[common - 1], struct.pack(f"<{common}I", *root[:common])
            after = [(tail[common:], node) for tail, node in after]
            out = self.emitted.setdefault(raw, len(self.emits))
            if out == len(self.emits):
                self.emits.append(raw)
        made = self.moves[state << 8 | byte] = out << 40 | self._state((last, tuple(after))) << 8
        return made

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece, four little-endian bytes each."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return struct.pack("<I", whole)
        if len(self.moves) > MOVES or len(self.pairs) > PAIRS:
            self._restart()
        at, out, get = self.start << 8, [], self.moves.get
        for k, b in enumerate(piece):
            move = get(at | b, -2)
            if move < 0:
                if move == -2:  # most transitions are wanted once only: the first time the rest of the piece is read by the branches
                    self.moves[at | b] = -1
                    if len(piece) - k < REST:
                        last, branches = self.branches[at >> 8]
                        for b in piece[k:]:
                            branches = self._advance(last, branches, b)
                        tail = branches[-1][0]
                        out.append(_PACK[len(tail)](*tail))
                        return b"".join(out)
                if len(self.moves) > 2 * MOVES or len(self.pairs) > 2 * PAIRS:  # a very long piece
                    kept = self.branches[at >> 8]
                    self._restart()
                    at, get = self._state(kept) << 8, self.moves.get
                move = self._step(at >> 8, b)
            at = move & _STATE
            if move > _STATE:
                out.append(self.emits[move >> 40])
        out.append(self.final[at >> 8])
        return b"".join(out)


class StreamingDecoder:
    """Ids to text, in parts of any size: what is returned holds whole characters; ``close`` gives what is left over."""

    def __init__(self, bytes_of: dict[int, bytes], moves: dict[bytes | None, dict]):
        self.bytes_of, self.moves, self.pending = bytes_of, moves, b""

    def _step(self, pending: bytes, i: int) -> tuple[str, bytes]:
        """Characters that end in the bytes of an id, and the bytes of an unfinished character after them."""
        raw = pending + self.bytes_of[i]
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):  # the lead byte of an unfinished character is one of the last three
            b = raw[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) and raw[-back:].decode("utf-8", "replace") == "�":
                    cut = len(raw) - back
                break
            if b < 0x80:
                break
        return raw[:cut].decode("utf-8", "replace"), raw[cut:]

    def feed(self, ids: list[int]) -> str:
        """The characters that these ids complete."""
        moves = self.moves
        whole = moves.setdefault(None, {})  # ids of whole characters, where nothing is pending
        if not self.pending:
            text = list(map(whole.get, ids))
            if None not in text:
                return "".join(text)
        out, pending = [], self.pending
        for i in ids:
            chars = None if pending else whole.get(i)
            if chars is None:
                here = moves.setdefault(pending, {})
                made = here.get(i)
                if made is None:
                    made = here[i] = self._step(pending, i)
                    if not pending and not made[1]:
                        whole[i] = made[0]
                chars, pending = made
            out.append(chars)
        self.pending = pending
        return "".join(out)

    def close(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class ByteBpe:
    """Encoder and decoder of one vocabulary, with what a worker keeps of them."""

    def __init__(self, source: str, pattern: str):
        self.machine = Transducer(read_ranks(source))
        self.pattern = regex.compile(pattern)
        self.pieces, self.words = Recent(CACHE_BYTES // 4), Recent(CACHE_BYTES * 3 // 4)
        self.moves: dict[bytes | None, dict] = {}

    def split(self, text: str) -> list[str]:
        """Pieces; characters that the library's Unicode tables don't hold yet are no letters or digits."""
        if text.isascii() or not _LATER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_LATER.sub("͸", text))]

    def _word(self, word: str) -> bytes:
        """Ids of a stretch of text that starts and ends where pieces do."""
        kept, out = self.pieces, []
        for piece in self.split(word):
            raw = kept.get(piece)
            if raw is None and (raw := kept.older(piece)) is None:
                raw = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
                kept.keep(piece, raw)
            out.append(raw)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, four little-endian bytes each.

        No piece holds a space after another character, so a text may be cut before its spaces, unless white space stands on both sides.
        """
        if not text:
            return b""
        if _UNCUT.search(text):
            return self._word(text)
        first, *parts = text.split(" ")
        found = list(map(self.words.get, parts))
        if None in found:
            for k, raw in enumerate(found):
                if raw is None:
                    found[k] = self.spaced(parts[k])
        return (self._word(first) if first else b"") + b"".join(found)

    def spaced(self, word: str) -> bytes:
        """Ids of a space and what stands between it and the next, kept for later."""
        kept = self.words
        raw = kept.get(word)
        if raw is None and (raw := kept.older(word)) is None:
            plain = word.isascii() or not _LATER.search(word)
            if plain and word.isalpha():
                raw = self.machine.encode((" " + word).encode())
            elif plain and word[:-1].isalpha() and word[-1] in _MARKS:
                raw = self.spaced(word[:-1]) + self.machine.encode(word[-1].encode())
            else:
                raw = self._word(" " + word)
            kept.keep(word, raw)
        return raw

    def decode(self, raw: bytes) -> str:
        """The text of packed ids."""
        decoder = StreamingDecoder(self.machine.bytes_of, self.moves)
        parts = [decoder.feed(np.frombuffer(raw, "<u4", min(STEP, len(raw) // 4 - at), 4 * at).tolist()) for at in range(0, len(raw) // 4, STEP)]
        parts.append(decoder.close())
        return "".join(parts)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: doc_id, ids, n_tokens, decoded; or with ``digests`` the SHA-256 of the ids and of the decoded bytes in place of both."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        model = worker_state("bytebpe", (hash(source.value), pattern), lambda: ByteBpe(source.value, pattern))
        gc.disable()  # nothing here makes cycles; looking for them among what is kept takes a third of the time
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column(1):
                raw = model.encode(text.as_py())
                back = model.decode(raw)
                counts.append(len(raw) // 4)
                if digests:
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
                    decoded.append(back)
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SCHEMA_DIGESTS if digests else SCHEMA_TOKENS)


def decode_documents(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, decoded; null lists and null ids in a list decode to nothing, an id that is not in the vocabulary is an error."""
    source = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        bytes_of = worker_state("bytebpe-decode", hash(source.value), lambda: {i: t for t, i in read_ranks(source.value).items()})
        moves: dict[bytes | None, dict] = {}
        for batch in batches:
            out = []
            for ids in batch.column(1):
                decoder = StreamingDecoder(bytes_of, moves)
                out.append(decoder.feed([i for i in ids.as_py() or [] if i is not None]) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<bigint>").alias("ids")).mapInArrow(run, "doc_id bigint, decoded string")


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), read_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, digests=True)
