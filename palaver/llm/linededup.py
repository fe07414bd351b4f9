"""Operator 10: line dedup by content-defined chunks of lines.

A text's lines are hashed; a rolling hash over ``WINDOW`` line hashes ends a chunk where it is 0 modulo ``DIVISOR``, so
that boundaries follow the content and come back in step after lines were added or dropped.  A chunk has at least
``LEAST_LINES`` lines (a single last line joins the chunk before it).  Chunks of at least two lines with letters or
digits in them that occur more than once in the whole table are removed everywhere but at their first place, the
smallest (doc_id, chunk), after their bytes were compared.

Chunks that are parted by sparse boundaries cannot give right results alone: a repeated passage of a few lines mostly
shares its chunk with lines that are not repeated.  So with ``whole`` (the query and the pipeline) there is a boundary at
every line, and chunks overlap: one from each line with letters or digits to the next such line.  Every equal stretch of lines
that begins and ends with such lines is a union of these chunks, so a line goes exactly if some such stretch around it
stands at an earlier place (doc_id, line).  Where a stretch overlaps its own first place, the lines of that place stay.

Only digests are shuffled for all chunks.  Bytes are read again for repeated chunks alone and compared by aggregates (the
least and the greatest of a digest), so that each task sends one copy of a chunk, however many it holds; chunks whose
digests are equal and bytes are not are told apart by their bytes.  Digests of more than a thousandth of all repeated
chunks are broadcast to where their rows are.

Cases: null texts stay null, empty ones empty; lines are parted by ``\\n`` alone and compared byte by byte; a text of
which every line goes becomes empty; rows without a doc_id are left as they are; rows that repeat a doc_id lose lines of
their own text only, and equal places of equal texts under one id are the same place, so these rows all keep them; ties
don't arise, a place is unique but for that; very long texts take memory in proportion to their length; further columns
are kept by ``dedup``, but for ``n_lines`` and ``n_removed`` where these are asked for; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import KeyBits, discard, look_up, materialize, table, worker_state

WINDOW, DIVISOR, LEAST_LINES = 2, 4, 2
_CONTENT = frozenset(range(48, 58)) | frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))


def chunks(text: str) -> list[tuple[int, int, int, bytes]]:
    """(first line, line after the last, lines with content, bytes) of each chunk of a text."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    n = len(lines)
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    cuts, last = [0], 0
    for i, h in enumerate(hashes):
        roll = (hashes[i - 1] * 3 + h) & 0xFFFFFFFFFFFFFFFF if i else h
        if i - last + 1 >= LEAST_LINES and i - last >= WINDOW - 1 and _boundary(roll) and n - i - 1 != 1:
            last = i + 1
            cuts.append(last)
    if cuts[-1] != n:
        cuts.append(n)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = lines[a:b]
        out.append((a, b, sum(not _CONTENT.isdisjoint(x) for x in part), b"\n".join(part)))
    return out


def _boundary(roll: int) -> bool:
    """Whether the rolled line hashes end a chunk; the product spreads both hashes over the upper bits."""
    return ((roll * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) % DIVISOR == 0


def windows(text: str) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The lines of a text and (first line, line after the last, bytes) of its overlapping chunks, in order."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    content = [i for i, x in enumerate(lines) if not _CONTENT.isdisjoint(x)]
    return lines, [(p, q + 1, b"\n".join(lines[p : q + 1])) for p, q in zip(content[:-1], content[1:], strict=True)]


def _pieces(text: str, whole: bool) -> list[tuple[int, bytes]]:
    """(number, bytes) of the pieces of a text that are looked up."""
    if whole:
        return [(k, raw) for k, (_, _, raw) in enumerate(windows(text)[1])]
    return [(k, raw) for k, (_, _, content, raw) in enumerate(chunks(text)) if content >= 2]


def _halves(raw: bytes, mask: int = -1) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(raw)
    return ((both >> 64) - (1 << 63)) & mask, ((both & 0xFFFFFFFFFFFFFFFF) - (1 << 63)) & mask


def _slices(batches, most: int = 1000):
    """Batches in pieces, so that what Python makes of a piece stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def _looked_up(batches, whole: bool, mask: int):
    """For each piece of a batch of texts a list of (doc_id, number, h1, h2, bytes)."""
    for batch in _slices(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if doc is not None and text and "\n" in text:
                rows += [(doc, k, *_halves(raw, mask), raw) for k, raw in _pieces(text, whole)]
        if rows:
            yield rows


_PLACE = "doc_id bigint, chunk int, h1 bigint, h2 bigint"
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _record_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(names)], _TYPES, strict=False)], names)


def repeated_chunks(docs: DataFrame, whole: bool = False, mask: int = -1) -> DataFrame:
    """(doc_id, chunk, h1, first_doc_id, first_chunk) of chunks to be removed, for ``docs`` (doc_id, text).

    ``mask`` weakens the digests, for tests.
    """
    key = ["h1", "h2"]

    def digests(batches):
        worker_state("linededup", 0, dict)
        for rows in _looked_up(batches, whole, mask):
            yield _record_batch(rows, ["doc_id", "chunk", *key])

    found = materialize(docs.mapInArrow(digests, _PLACE), "line-chunks")
    first = found.groupBy(*key).agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "n", F.col("first.doc_id").alias("first_doc_id"), F.col("first.chunk").alias("first_chunk"))
    first = materialize(first, "line-first")
    # a second scan brings the bytes of chunks whose digest may be repeated; digests are random, so they are their own hash
    bits = KeyBits(first, "h1", hashed=True)
    sent, at_most = bits.sent, bits.bits - 1

    def fetch(batches):
        table = sent.value
        for rows in _looked_up(batches, whole, mask):
            rows = [r for r in rows if table[(r[2] & at_most) >> 3] >> (r[2] & at_most & 7) & 1]
            if rows:
                yield _record_batch(rows, ["doc_id", "chunk", *key, "raw"])

    raw = docs.mapInArrow(fetch, _PLACE + ", raw binary")
    least = raw.groupBy(*key).agg(F.min("raw").alias("least"), F.max("raw").alias("greatest")).select(*key, (F.col("least") == F.col("greatest")).alias("same"))
    checked = materialize(first.join(least, key), "line-checked")
    hits = materialize(bits.maybe(found, "h1"), "line-hits")
    discard(found)
    discard(first)
    out = look_up(hits, checked.where("same").drop("same"), key, "n").where("doc_id <> first_doc_id or chunk <> first_chunk").select("doc_id", "chunk", "h1", "first_doc_id", "first_chunk")
    if not checked.where("not same").isEmpty():
        # one digest, different bytes
        rows = raw.join(checked.where("not same").select(*key), key)
        each = rows.groupBy(*key, "raw").agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "raw", F.col("first.doc_id").alias("first_doc_id"), F.col("first.chunk").alias("first_chunk"))
        out = out.unionByName(rows.join(each, [*key, "raw"]).where("doc_id <> first_doc_id or chunk <> first_chunk").select("doc_id", "chunk", "h1", "first_doc_id", "first_chunk"))
    out = materialize(out.distinct(), "line-same")
    for done in (checked, hits):
        discard(done)
    return out


def _without(text: str, numbers: list, mask: int = -1) -> tuple[str, int]:
    """A text without the windows of (number, h1, number of its first place where that is in the text too)."""
    lines, found = windows(text)
    out: set[int] = set()
    for k, h1, first in numbers:
        # rows may share a doc_id, the window of that number is then another text's
        if k < len(found) and _halves(found[k][2], mask)[0] == h1:
            stay = range(*found[first][:2]) if first is not None and first < len(found) and found[first][2] == found[k][2] else ()
            out.update(i for i in range(*found[k][:2]) if i not in stay)
    return b"\n".join(x for i, x in enumerate(lines) if i not in out).decode("utf-8", "surrogatepass"), len(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, whole: bool = False, mask: int = -1) -> DataFrame:
    """``docs`` with repeated chunks of lines removed from the text; with ``counts`` also n_lines, n_removed.

    With ``whole`` every repeated stretch of lines goes, whatever stands around it.
    """
    if counts:
        docs = docs.drop(*({"n_lines", "n_removed"} - {id_col, text_col}))
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    same = repeated_chunks(narrow, whole, mask)
    number = F.struct("chunk", "h1", F.when(F.col("doc_id") == F.col("first_doc_id"), F.col("first_chunk")).alias("first")) if whole else F.col("chunk")
    gone = same.groupBy("doc_id").agg(F.collect_set(number).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    names = docs.columns
    # only texts that may lose lines meet their lists; the others go straight from the scan to the result
    bits = KeyBits(same.select("doc_id").distinct(), "doc_id")
    keyed = docs.withColumn("_key", F.col(id_col).cast("bigint"))
    at = names.index(text_col)
    kinds = {f.name: "string" if f.name == text_col else f.dataType.simpleString() for f in docs.schema}
    out_schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + (", n_lines bigint, n_removed bigint" if counts else "")
    packed_schema = ", ".join(f"`{n}` {'binary' if n == text_col else k}" for n, k in kinds.items()) + ", _key bigint"

    def pack(batches):
        """Texts on their way to their lists, packed to halve the shuffle."""
        for batch in _slices(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, [*names, "_key"])

    def finish(batch, texts, lines, removed):
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(texts, pa.string())
        if counts:
            columns += [pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names + ["n_lines", "n_removed"] * counts)

    def rewrite(batches):
        for batch in _slices(batches):
            texts, lines, removed = [], [], []
            for raw, numbers in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                text = None if raw is None else zlib.decompress(raw).decode("utf-8", "surrogatepass")
                lines.append(text.count("\n") + 1 if text else 0)
                dropped = 0
                if numbers and text and whole:
                    text, dropped = _without(text, [(x["chunk"], x["h1"], x["first"]) for x in numbers], mask)
                elif numbers and text:
                    out = set(numbers)
                    parts = chunks(text)
                    dropped = sum(b - a for k, (a, b, _, _) in enumerate(parts) if k in out)
                    text = b"\n".join(raw for k, (_, _, _, raw) in enumerate(parts) if k not in out).decode("utf-8", "surrogatepass")
                texts.append(text)
                removed.append(dropped)
            yield finish(batch, texts, lines, removed)

    def untouched(batches):
        for batch in _slices(batches):
            texts = batch.column(at).to_pylist()
            yield finish(batch, texts, [t.count("\n") + 1 if t else 0 for t in texts], [0] * len(texts))

    touched = bits.maybe(keyed, "_key", then=pack, schema=packed_schema).join(gone, F.col("_key") == F.col("_gone_id"), "left").select(*names, "_gone")
    return touched.mapInArrow(rewrite, out_schema).unionByName(bits.maybe(keyed, "_key", present=False, then=untouched, schema=out_schema))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True, whole=True)
