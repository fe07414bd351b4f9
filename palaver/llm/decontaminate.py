"""Operator 4: benchmark decontamination by the q-gram lemma.

Passages and documents are compared as letters and digits, lower-cased, with one space for everything between.  A
passage of m characters that occurs with at most k edits shares at least m + 1 - q(k + 1) q-grams with the place
where it occurs, all of them on k + 1 neighbouring diagonals.  Shared q-grams are counted in cells of k + 1
diagonals; two neighbouring cells make a band, so that bands overlap and no occurrence falls between two.  Bands that
meet the bound are verified by banded alignment: the whole passage against any part of the region, at most k edits.

The passages travel to the workers in slices of about ``SLICE_CHARS`` characters, by a hash; of a larger benchmark one slice
at a time is collected, searched for in all documents, its findings stored, and then dropped.  So neither the driver nor
a worker ever holds more than a slice; the documents are read once a slice.

Cases: null and empty documents and passages match nothing; passages that have less than ``MIN_CHARS`` characters
after normalisation are ignored, since they occur by chance; an item_id with several passages matches by each, and a null
item_id is reported as null; rows that repeat a doc_id, null ones too, are searched each; of overlapping occurrences of a
passage the one with the fewest edits, then the first, is reported; very long texts are a block of their own; empty
tables give an empty table; further columns don't matter to ``leaks`` and stay in ``decontaminate``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import U64, KeyBits, materialize, mix, table, worker_state

Q = 8
EDIT_SHARE = 0.10
MIN_CHARS = 24
SLICE_CHARS = 8 << 20
#: Normalised characters handled at once by a worker; bounds memory only.
BLOCK = 1 << 20
FOUND = "doc_id bigint, item_id bigint, start_char bigint, end_char bigint, edits int, passage_chars int"

_TABLES: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower-case letter or digit of each code point, and a space for any other."""
    if not _TABLES:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalnum():
                low = x.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(fold)
    return _TABLES[0]


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters without repeated or leading spaces, and each one's place in the text."""
    points = _fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    out = points[at]
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams that begin at each place (q is 8: three doublings)."""
    h = x.astype(U64) * U64(0x9E3779B97F4A7C15)
    for step, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (4, 0x27D4EB2F165667C5)):
        h = h[:-step] * U64(factor) + h[step:] if len(h) > step else h[:0]
    return mix(h)


class Index:
    """Q-grams of a slice of passages with their postings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.passages = [], []
        for item, text in items:
            x, _ = normalise(text)
            if len(x) >= MIN_CHARS:
                self.ids.append(item)
                self.passages.append(x)
        size = np.array([len(p) for p in self.passages], np.int64)
        # the edit budget; short passages get less, so that the lemma's bound stays at q or above
        self.edits = np.minimum((size * EDIT_SHARE).astype(np.int64), (size + 1) // Q - 2)
        self.bound = size + 1 - Q * (self.edits + 1)
        codes = [grams(p) for p in self.passages]
        flat = np.concatenate([*codes, np.zeros(0, U64)])
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.codes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << 24, bool)
        self.bitmap[(self.codes >> U64(40)).astype(np.int64)] = True
        self.least = int(self.bound.min()) if len(size) else 0

    def regions(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(text, passage, lowest and highest diagonal) of bands that meet the bound."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not self.passages or sizes.sum() < Q:
            return []
        starts = np.cumsum(sizes) - sizes
        codes = grams(np.concatenate(texts))
        hit = np.flatnonzero(self.bitmap[(codes >> U64(40)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
        right = self.codes[at] == codes[hit]
        hit, at = hit[right], at[right]
        text = np.searchsorted(starts, hit, "right") - 1
        inside = hit + Q <= starts[text] + sizes[text]
        # texts with fewer shared q-grams than the least bound have no occurrence
        inside &= np.bincount(text[inside], minlength=len(texts))[text] >= self.least
        hit, at, text = hit[inside], at[inside], text[inside]
        out: list[tuple[int, int, int, int]] = []
        for i, j in _spans(np.cumsum(self.count[at]), text):
            out += self._bands(hit[i:j], at[i:j], text[i:j], starts)
        return out

    def _bands(self, hit, at, text, starts) -> list[tuple[int, int, int, int]]:
        # a key has 29 bits for text and passage: more of both are taken some texts at a time
        low, high, most = int(text.min()), int(text.max()), max(1, ((1 << 29) - 1) // len(self.passages))
        if high - low >= most:
            cuts = np.unique(np.append(np.searchsorted(text, np.arange(low, high + 1, most)), len(text)))
            return [x for i, j in zip(cuts[:-1], cuts[1:], strict=True) for x in self._bands(hit[i:j], at[i:j], text[i:j], starts)]
        many = self.count[at]
        each = np.repeat(np.arange(len(at)), many)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        posting = self.first[at][each] + nth
        passage = self.owner[posting]
        diagonal = hit[each] - starts[text[each]] - self.place[posting]
        width = self.edits[passage] + 1
        cell = (diagonal + (1 << 31)) // width
        key = ((text[each] - low) * len(self.passages) + passage) * (1 << 33) + cell
        cells, counts = np.unique(key, return_counts=True)
        following = np.zeros_like(counts)
        following[:-1] = np.where(cells[1:] == cells[:-1] + 1, counts[1:], 0)
        group = cells >> 33
        passage = group % len(self.passages)
        good = counts + following >= self.bound[passage]
        # a band may begin in an empty cell: then all its grams are in the next, which is held against the bound itself
        out = []
        for g, c in zip(group[good].tolist(), (cells[good] & ((1 << 33) - 1)).tolist(), strict=True):
            t, p = divmod(g, len(self.passages))
            w = int(self.edits[p]) + 1
            first = c * w - (1 << 31)
            out.append((t + low, p, first, first + 2 * w - 1))
        return out


def _spans(total: np.ndarray, text: np.ndarray, most: int = 1 << 21):
    """Cut hits, at borders between texts, into spans of about ``most`` postings."""
    n = len(total)
    i = 0
    while i < n:
        base = total[i - 1] if i else 0
        j = max(int(np.searchsorted(total, base + most, "right")), i + 1)
        if j < n:
            j = int(np.searchsorted(text, text[j], "left")) if text[j] != text[i] else int(np.searchsorted(text, text[i], "right"))
        yield i, j
        i = j


def align(jobs: list[tuple[np.ndarray, np.ndarray, int, int, int]]) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best occurrence of a whole passage, for jobs (passage, text, low, high, most).

    The passage is aligned on the text's diagonals low - most .. high + most; None where more than ``most`` edits are
    needed.  Row i holds the edits of passage[:i] against a part of the text that ends on each diagonal.  All jobs go
    through their rows together; those past their budget drop out.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(jobs)
    if not jobs:
        return out
    sizes = np.array([len(j[0]) for j in jobs])
    low = np.array([j[2] - j[4] for j in jobs])
    widths = np.array([j[3] - j[2] + 2 * j[4] + 1 for j in jobs])
    most = np.array([j[4] for j in jobs])
    lengths = np.array([len(j[1]) for j in jobs])
    rows, width = int(sizes.max()), int(widths.max())
    far = rows + width + int(most.max()) + 1
    passages = np.full((len(jobs), rows), 0xFFFFFFFE, np.uint32)
    windows = np.full((len(jobs), width + rows + 1), 0xFFFFFFFF, np.uint32)
    for k, (p, t, _, _, _) in enumerate(jobs):
        passages[k, : len(p)] = p
        lo, hi = max(int(low[k]), 0), min(int(low[k]) + width + rows, len(t))
        if hi > lo:
            windows[k, lo - low[k] : hi - low[k]] = t[lo:hi]
    steps = np.arange(width)
    ends = low[:, None] + steps[None, :]
    inside = steps[None, :] < widths[:, None]
    best = np.where(inside & (ends >= 0) & (ends <= lengths[:, None]), 0, far)
    begin = ends.copy()
    job = np.arange(len(jobs))
    for i in range(1, rows + 1):
        # diagonal d: the text's character before place i + d
        cost = best + (windows[:, i - 1 : i - 1 + width] != passages[:, i - 1, None])
        # a passage character that the text lacks comes from the diagonal to the right
        take = best[:, 1:] + 1 < cost[:, :-1]
        start = begin.copy()
        cost[:, :-1][take] = best[:, 1:][take] + 1
        start[:, :-1][take] = begin[:, 1:][take]
        place = ends + i
        cost[~inside | (place < 0) | (place > lengths[:, None])] = far
        # a run of text characters that the passage lacks: the least cost to the left plus the distance
        slope = cost - steps
        reach = np.minimum.accumulate(slope, axis=1)
        source = np.maximum.accumulate(np.where(slope == reach, steps, 0), axis=1)
        best = reach + steps
        best[~inside] = far
        begin = np.take_along_axis(start, source, axis=1)
        least = best.min(axis=1)
        for k in np.flatnonzero(sizes[job] == i):
            if least[k] <= most[job[k]]:
                d = int(np.argmin(best[k]))
                out[job[k]] = (int(best[k, d]), int(begin[k, d]), int(ends[k, d]) + i)
        live = (least <= most[job]) & (sizes[job] > i)
        if not live.all():
            if not live.any():
                break
            if live.sum() < 0.8 * len(live):
                job, best, begin, ends, inside, passages, windows, lengths = (x[live] for x in (job, best, begin, ends, inside, passages, windows, lengths))
    return out


def occurrences(index: Index, texts: list[np.ndarray], batch: int = 256):
    """(text, passage, edits, start, end) of each verified occurrence; of overlapping ones of a passage the best."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    jobs: list[tuple[int, int, int, int]] = []
    for t, p, low, high in index.regions(texts):
        text, passage = texts[t], index.passages[p]
        for d in range(max(low, 0), min(high, len(text) - len(passage)) + 1):
            if text[d] == passage[0] and np.array_equal(text[d : d + len(passage)], passage):
                found.setdefault((t, p), []).append((0, d, d + len(passage)))
                break
        else:
            jobs.append((t, p, low, high))
    jobs.sort(key=lambda j: len(index.passages[j[1]]))
    for i in range(0, len(jobs), batch):
        part = jobs[i : i + batch]
        for (t, p, _, _), hit in zip(part, align([(index.passages[p], texts[t], low, high, int(index.edits[p])) for t, p, low, high in part]), strict=True):
            if hit is not None:
                found.setdefault((t, p), []).append(hit)
    for (t, p), hits in found.items():
        kept: list[tuple[int, int, int]] = []
        for hit in sorted(hits):
            if all(hit[2] <= k[1] or hit[1] >= k[2] for k in kept):
                kept.append(hit)
                yield (t, p, *hit)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Occurrences of benchmark passages in documents: ids, place in the text's code points, edits, passage length."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    slices = max(1, -(-total // slice_chars))
    if slices == 1:
        return _leaks_of(docs, items, total)[0]
    # one slice at a time is in the driver and the workers
    out = None
    for k in range(slices):
        found, sent = _leaks_of(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k), total)
        part = materialize(found, "leaks")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of(docs: DataFrame, items: DataFrame, total: int):
    """Occurrences of a slice of passages, and the broadcast that holds them."""
    rows = items.collect() if total else []
    sent = docs.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
    name = uuid.uuid4().hex

    def run(batches):
        index = worker_state("decontaminate", name, lambda: Index(sent.value))
        for batch in batches:
            n = batch.num_rows
            i = 0
            while i < n:
                texts, places, held, j = [], [], 0, i
                while j < n and held < BLOCK:
                    x, at = normalise(batch.column(1)[j].as_py())
                    texts.append(x)
                    places.append(at)
                    held += len(x)
                    j += 1
                rows = []
                for t, p, edits, start, end in occurrences(index, texts):
                    at = places[t]
                    rows.append((batch.column(0)[i + t].as_py(), index.ids[p], int(at[start]) if start < len(at) else 0, int(at[end - 1]) + 1 if end else 0, edits, len(index.passages[p])))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])
                i = j

    return docs.mapInArrow(run, FOUND), sent


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; rows without a doc_id stay."""
    bad = materialize(leaks(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "leaking")
    return without(docs, bad)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``bad`` (doc_id); only rows that may be in it are shuffled."""
    bits = KeyBits(bad, "doc_id")
    return bits.maybe(docs, "doc_id", present=False).unionByName(bits.maybe(docs, "doc_id").join(bad, "doc_id", "left_anti").select(*docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
