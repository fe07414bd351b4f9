"""Operator 5: substring dedup by content-defined chunking.

What repeats are windows of ``WORDS`` + 1 words, one from each word on, named by digest.  Each points at its first place,
the smallest (doc_id, start), which holds all of it; the texts of both documents are then compared byte by byte around
it, and the whole equal stretch counts if it has more than ``WORDS`` words.  A stretch of so many words that are whole in
both documents is a union of its windows, so each of its bytes is reported with some earlier document.

Chunks only spare windows.  A gear rolling hash runs over each text's bytes (its upper 32 bits see the last 32 bytes), a
chunk ends where the hash is the least within ``REACH`` bytes on both sides, so equal bytes have equal boundaries but
near their ends.  A window that holds a chunk, with all that its boundaries depend on, whose digest occurs in no other
document cannot repeat and is not made.  Text without boundaries (with a short period, say) spares none.

Cases: null and empty texts have no chunks; rows without a doc_id and repeats inside one document are not reported;
different texts under one doc_id are compared each; texts of at most ``WORDS`` words have no windows; an empty table gives an empty table; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import U64, KeyBits, discard, materialize, mix, powers_down, prefix_sums, table, text_runs

REACH = 24
WORDS = 50
_GEAR = np.random.default_rng(4242).integers(0, 1 << 32, 256, dtype=np.uint32)
_BYTES = np.random.default_rng(777).integers(0, 1 << 64, 256, dtype=U64)
SPANS = "doc_id bigint, first_doc_id bigint, start bigint, end bigint, first_start bigint, n_words bigint"
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True
#: A boundary depends on fewer bytes than these before and after it: the reach, and before that what the hash sees.
BEFORE, AFTER = REACH + 40, REACH + 8


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i - 1] << 1) + gear[data[i]] in 32 bits, for all places at once by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    return h


def _least(h: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of each window h[i : i + reach]."""
    out, have = h.copy(), 1
    while have < reach:
        step = min(have, reach - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends: strictly less than what precedes, at most what follows, within reach."""
    n = len(data)
    if n <= 2 * REACH:
        return np.zeros(0, np.int64)
    h = gear(data)
    window = _least(h, REACH)
    middle = h[REACH : n - REACH]
    before = window[: n - 2 * REACH]
    after = window[REACH + 1 : n - REACH + 1]
    return np.flatnonzero((middle < before) & (middle <= after)) + REACH + 1


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it."""
    edge = np.diff(np.concatenate(([False], ~_IS_SPACE[data], [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _texts(batches):
    """(doc_id, bytes, words, digests of pieces as a function of their ends) of each text that has a window."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        null = np.asarray(batch.column(0).is_null())
        for first, offsets, data in text_runs(batch.column(1)):
            total = prefix_sums(_BYTES[data])
            for r in range(len(offsets) - 1):
                a, b = int(offsets[r]), int(offsets[r + 1])
                if b - a <= 2 * WORDS or null[first + r]:
                    continue
                words = _words(data[a:b])
                if len(words[0]) > WORDS:
                    yield int(ids[first + r]), data[a:b], words, lambda x, y, a=a: mix((total[a + y] - total[a + x]) * powers_down(a + x) + (y - x).astype(U64)).view(np.int64)
        yield None


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.concatenate(([0], boundaries(data), [len(data)]))
    return cuts[:-1], cuts[1:]


def _batches(rows, names: list[str], most: int = 1 << 17):
    """Record batches of tuples of arrays, which come with None where a batch of texts ends."""
    held, n = [], 0
    for row in rows:
        if row is not None:
            held.append(row)
            n += len(row[0])
        if held and (row is None or n >= most):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, n = [], 0


def _chunk(batches):
    def rows():
        for found in _texts(batches):
            if found is not None:
                doc, data, _, digests = found
                chunks = np.unique(digests(*_cut(data)))
                yield np.full(len(chunks), doc, np.int64), chunks
            else:
                yield None

    yield from _batches(rows(), ["doc_id", "digest"])


def _alone(data: np.ndarray, words: tuple[np.ndarray, np.ndarray], again) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the windows that hold no chunk of which ``again(first bytes, ends)`` says that no other document has it."""
    begin, end = _cut(data)
    alone = ~again(begin, end)
    low, high = begin[alone] - BEFORE, np.append(end[alone] + AFTER, np.iinfo(np.int64).max)
    start, stop = words[0][:-WORDS], words[1][WORDS:]
    # the first such chunk that begins in a window is also the first to end
    kept = high[np.searchsorted(low, start)] > stop
    return start[kept], stop[kept]


def _thin(batches):
    """Of windows that overlap on one diagonal one is enough: all are in the same stretch."""
    for batch in batches:
        seeds = batch.column(2)
        lengths = np.diff(seeds.offsets.to_numpy())
        flat = seeds.flatten()
        start, there = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((start, start - there, row))
        start, there, row = start[order], there[order], row[order]
        # a window has at least WORDS + 1 letters and WORDS spaces
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (start[1:] - there[1:] != start[:-1] - there[:-1]) | (start[1:] - start[:-1] > 2 * WORDS)
        kept = np.bincount(row[first], minlength=len(lengths))
        ends = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[first].astype(np.int32))) for x in (start, there)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "first_doc_id", "starts", "theres"])


def stretch(a: np.ndarray, b: np.ndarray, i: int, j: int, size: int) -> tuple[int, int] | None:
    """The longest equal stretch around a[i : i + size] and b[j : j + size], as its ends in ``a``; None if they differ."""
    if not np.array_equal(a[i : i + size], b[j : j + size]) or i + size > len(a) or j + size > len(b):
        return None
    left, step = 0, 256
    room = min(i, j)
    while left < room:
        k = min(step, room - left)
        x = a[i - left - k : i - left] != b[j - left - k : j - left]
        if x.any():
            left += k - 1 - int(np.flatnonzero(x)[-1])
            break
        left += k
        step *= 2
    right, step = size, 256
    room = min(len(a) - i, len(b) - j)
    while right < room:
        k = min(step, room - right)
        x = a[i + right : i + right + k] != b[j + right : j + right + k]
        if x.any():
            right += int(np.flatnonzero(x)[0])
            break
        right += k
        step *= 2
    return i - left, i + right


def whole_words(a: np.ndarray, start: int, end: int) -> tuple[int, int, int]:
    """The part of a stretch made of whole words, and their number."""
    raw = a.tobytes()
    while start < end and start > 0 and raw[start] not in _SPACE and raw[start - 1] not in _SPACE:
        start += 1
    while end > start and end < len(raw) and raw[end - 1] not in _SPACE and raw[end] not in _SPACE:
        end -= 1
    return start, end, len(raw[start:end].split())


def _extend(batches):
    for batch in batches:
        rows = []
        for doc, first, starts, theres, text, other in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            a, b = (np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8) for x in (text, other))
            reached: dict[int, int] = {}
            for i, j in sorted(zip(starts, theres, strict=True)):
                if reached.get(i - j, -1) > i:
                    continue
                # rows may share a doc_id, so the place may be outside this text
                found = stretch(a, b, i, j, 1) if i < len(a) and j < len(b) else None
                if found is None:
                    continue
                reached[i - j] = found[1]
                start, end, words = whole_words(a, *found)
                if words > WORDS:
                    rows.append((doc, first, start, end, start - i + j, words))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in SPANS.split(", ")])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of bytes [start, end) of a document that an earlier document (first_doc_id) holds too."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chunks = docs.mapInArrow(_chunk, "doc_id bigint, digest bigint").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest")
    chunks = materialize(chunks, "repeated-chunks")
    bits = KeyBits(chunks, "digest", hashed=True)
    sent, mask = bits.sent, bits.bits - 1
    discard(chunks)

    def windows(batches):
        table = sent.value

        def rows():
            for found in _texts(batches):
                if found is None:
                    yield None
                    continue
                doc, data, words, digests = found

                def again(x, y):
                    at = digests(x, y) & mask
                    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

                start, stop = _alone(data, words, again)
                if len(start):
                    yield np.full(len(start), doc, np.int64), start.astype(np.int32), digests(start, stop)

        yield from _batches(rows(), ["doc_id", "start", "digest"])

    found = materialize(docs.mapInArrow(windows, "doc_id bigint, start int, digest bigint"), "windows")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("there"))
    first = materialize(first, "first-windows")
    again = KeyBits(first, "digest", hashed=True).maybe(found, "digest")
    seeds = materialize(again.join(first, "digest").where("doc_id <> first_doc_id").select("doc_id", "first_doc_id", "start", "there"), "seeds")
    discard(found)
    discard(first)
    # one row per pair of documents; its seeds are windows of the one document
    pairs = seeds.groupBy("doc_id", "first_doc_id").agg(F.collect_list(F.struct("start", "there")).alias("seeds"))
    pairs = materialize(pairs.mapInArrow(_thin, "doc_id bigint, first_doc_id bigint, starts array<int>, theres array<int>"), "pairs")
    discard(seeds)
    later = KeyBits(pairs.select("doc_id").distinct(), "doc_id").maybe(docs, "doc_id")
    earlier = KeyBits(pairs.select("first_doc_id").distinct(), "first_doc_id").maybe(docs.select(F.col("doc_id").alias("first_doc_id"), F.col("text").alias("other")), "first_doc_id")
    held = pairs.join(later, "doc_id").join(earlier, "first_doc_id")
    return held.select("doc_id", "first_doc_id", "starts", "theres", "text", "other").mapInArrow(_extend, SPANS).distinct()


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the bytes of ``spans``; what a cut through a character leaves is dropped."""
    names, at = docs.columns, docs.columns.index("text")
    cuts = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_cuts"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text and spans:
                    raw, keep = text.encode("utf-8", "surrogatepass"), 0
                    parts = []
                    for s in sorted(spans, key=lambda s: s["start"]):
                        parts.append(raw[keep : max(keep, s["start"])])
                        keep = max(keep, s["end"])
                    text = b"".join([*parts, raw[keep:]]).decode("utf-8", "ignore")
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.join(cuts, "doc_id", "left").select(*names, "_cuts").mapInArrow(run, docs.schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
