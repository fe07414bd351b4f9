"""Operator 3: WARC archives, written and read through Spark's own file layer.

Writing: each record is one gzip member; Spark's text sink writes the members' bytes, so every store that Spark
writes to will do and a lost task's file never counts.  Between members stands an empty gzip member (the sink's line
separator), which keeps the files valid.  Of records with equal payloads of at least ``REVISIT_BYTES`` the one with
the smallest page_id is a response, the others are revisits of it without a payload.

Reading is splittable: tasks scan byte ranges for the gzip magic (Spark's text source with the magic as separator,
which gives each piece to the range in which it starts).  A candidate is a member only if its header decodes and
its content begins as a WARC record; the magic inside a member's compressed bytes fails that and its piece goes back
to the member around it.  A range owns the records that start in it.  Where a false magic stands at the edge of two
ranges, the pieces meet again by file in a second small step.

Archives to be read must not have a name that ends in ``.gz``, or else Hadoop unpacks them unsplit.

Cases: a null page is the empty payload; null urls leave the header out; a null page_id has a record id made of the
digest and is read as null; rows that repeat the smallest page_id are all responses; damaged members are skipped;
an empty table gives no archive records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import KeyBits, materialize, new_path, table

REVISIT_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:palaver:page:"
_SHA256 = re.compile("sha256:([0-9a-fA-F]{64})")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    clean = [f"{k}: {' '.join(v.split())}" for k, v in headers]
    return _member("\r\n".join(["WARC/1.1", *clean, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record of each row of ``pages`` to archives in the folder ``path``."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256))
    same = rows.where(f"size >= {REVISIT_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.select("page_id", "url", "payload", "size", "digest")

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:palaver:info>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: palaver\r\nformat: WARC File Format 1.1\r\n")], pa.binary())], ["value"])
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for page, url, payload, size, digest, first in zip(*columns[:5], columns[5] if len(columns) > 5 else [None] * batch.num_rows, strict=True):
                revisit = first is not None and page != first
                name = f"<{_ID}{page}>" if page is not None else f"<urn:sha256:{digest}>"
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if url is not None:
                    headers.append(("WARC-Target-URI", url))
                if revisit:
                    headers += [("WARC-Refers-To", f"<{_ID}{first}>"), ("WARC-Profile", _PROFILE), ("Palaver-Payload-Length", str(size))]
                out.append(_record(headers, _HTTP + (b"" if revisit else payload)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # only pages whose payload may be repeated are shuffled; the others go straight from the scan to the archive
    bits = KeyBits(same, "digest")
    single = bits.maybe(rows, "digest", present=False, then=run, schema="value binary")
    again = bits.maybe(rows, "digest").join(same, "digest", "left").select("page_id", "url", "payload", "size", "digest", "first").mapInArrow(run, "value binary")
    single.unionByName(again).select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class _Damaged(Exception):
    pass


class _Member:
    """A gzip member that is being unpacked."""

    def __init__(self, data: bytes):
        self.raw, self.out, self.unpack = [], [], zlib.decompressobj(31)
        self.feed(data)
        if not self.looks_right():
            raise _Damaged

    def feed(self, data: bytes) -> None:
        self.raw.append(data)
        try:
            self.out.append(self.unpack.decompress(data))
        except zlib.error as e:
            raise _Damaged from e

    def confirmed(self) -> bool:
        return b"".join(self.out[:4])[:5] == b"WARC/"

    def looks_right(self) -> bool:
        head = b"".join(self.out)[:5]
        return head == b"WARC/" or (self.unpack.eof and not head) or (not self.unpack.eof and b"WARC/".startswith(head))


def parse_record(data: bytes) -> dict | None:
    """A WARC record of unpacked bytes; None if it is another type than response or revisit, or damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        body = rest[: int(fields["content-length"])]
    except (KeyError, ValueError):
        return None
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit") or len(body) != int(fields["content-length"]):
        return None
    payload = body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body

    def page(name: str) -> int | None:
        value = fields.get(name, "").strip("<>")
        return int(value[len(_ID) :]) if value.startswith(_ID) and value[len(_ID) :].lstrip("-").isdigit() else None

    if kind == "revisit":
        # archives of others may have no length, and digests of other kinds: both are unknown then
        size, kept, payload = fields.get("palaver-payload-length", ""), _SHA256.fullmatch(fields.get("warc-payload-digest", "")), None
        size, digest = int(size) if size.isdigit() else None, kept[1].lower() if kept else None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def scan_range(pieces, first: bool, final: bool = False):
    """Records of one byte range, and what its edges leave: ("record", dict), ("head", bytes) or ("tail", bytes).

    ``pieces`` are the bytes between magics; at the start of a file the first piece stands before any magic.  Pieces
    that a member had taken up before it proved damaged are looked at again, without its first one.  ``final``: nothing
    follows, so an unfinished member is damaged.
    """
    member, ready = None, not first
    source = iter(pieces)
    if first:
        next(source, None)
    again: deque[bytes] = deque()
    while True:
        piece = again.popleft() if again else next(source, None)
        if piece is None:
            if member is None or not final:
                break
            lost, member = member, None
            again.extendleft(x[len(MAGIC) :] for x in reversed(lost.raw[1:]))
            continue
        data = MAGIC + piece
        if member is None:
            try:
                member = _Member(data)
            except _Damaged:
                if ready:
                    yield "head", data
                continue
        else:
            try:
                member.feed(data)  # the magic was inside the member
            except _Damaged:
                lost, member = member, None
                if ready and not lost.confirmed():
                    yield "head", lost.raw[0]
                again.extendleft(x[len(MAGIC) :] for x in reversed(lost.raw[1:]))  # the last of them is ``data``
                continue
        if member.confirmed() or member.unpack.eof:
            ready = False
        if member.unpack.eof:
            if (found := parse_record(b"".join(member.out))) is not None:
                yield "record", found
            member = None
    if member is not None:
        yield "tail", b"".join(member.raw)


def _rows(found: list[dict], keep: bool) -> list[pa.Array]:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    return [pa.array([r[k] for r in found], t) for k, t in kinds] + [pa.array([r["payload"] if keep else None for r in found], pa.binary())]


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Response and revisit records of the archives in ``path``; without ``payload`` that column is null."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))

    def run(batches):
        def flush(file, start, held):
            found, edges = [], []
            for kind, x in scan_range(held, start == 0):
                found.append(x) if kind == "record" else edges.append((kind, x))
            for i in range(0, len(found), 256):
                part = found[i : i + 256]
                yield pa.RecordBatch.from_arrays([*_rows(part, payload), *(pa.nulls(len(part), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], [*names, "kind", "file", "start", "nth", "piece"])
            if edges:
                n = len(edges)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, x.type) for x in _rows([], payload)), pa.array([k for k, _ in edges]), pa.array([file] * n), pa.array([start] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([x for _, x in edges], pa.binary())], [*names, "kind", "file", "start", "nth", "piece"])

        yield from _by_range(batches, flush)

    found = materialize(pieces.mapInArrow(run, RECORD + ", kind string, file string, start bigint, nth bigint, piece binary"), "warc-read")
    edges = found.where("kind is not null").select("file", "start", "nth", "kind", "piece")

    def meet(table: pa.Table) -> pa.Table:
        held = b"".join(row["piece"] for row in sorted(table.to_pylist(), key=lambda r: (r["start"], r["nth"])))
        out = [x for kind, x in scan_range(held.split(MAGIC)[1:], False, True) if kind == "record"]
        return pa.Table.from_arrays(_rows(out, payload), names)

    return found.where("kind is null").select(*names).unionByName(edges.groupBy("file").applyInArrow(meet, RECORD))


def _by_range(batches, flush):
    """Call ``flush(file, start, pieces)`` for each byte range of a task, holding one member's pieces at a time at most.

    A range's pieces arrive in order; they are handed on lazily, so memory holds one batch and one record.
    """
    rows = ((f.as_py(), s.as_py(), p.as_py()) for b in batches for f, s, p in zip(b.column(0), b.column(1), b.column(2), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[:2]

        def pieces(first=ahead, key=key):
            nonlocal ahead
            yield first[2]
            for row in rows:
                if row[:2] != key:
                    ahead = row
                    return
                yield row[2]
            ahead = None

        yield from flush(*key, pieces())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
