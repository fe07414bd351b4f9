import glob
import gzip
import hashlib
import os
import random
import zlib

from palaver.llm import warc


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        again = f is not None and f != i
        out.append((i, u, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/b", "x" * 100), (3, "http://é/c", "x" * 100), (4, None, "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""), (9, "u", "é\r\n\r\nWARC/1.1" * 40), (3, "http://é/c", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(df, path)
    assert got(warc.read_warc(spark, path)) == expected(rows)
    kept = {r.page_id: r.payload for r in warc.read_warc(spark, path).collect() if r.record_type == "response"}
    assert bytes(kept[9]).decode() == rows[6][2]
    for f in glob.glob(path + "/part-*"):
        assert gzip.decompress(open(f, "rb").read()).startswith(b"WARC/1.1")  # valid for any gzip reader
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def scan(data, cuts):
    """What ranges that begin at ``cuts`` find, and what a second look at their edges finds."""
    pieces, at, out, edges = data.split(warc.MAGIC), 0, [], []
    groups = [[] for _ in range(len(cuts) + 1)]
    for k, p in enumerate(pieces):
        groups[sum(at >= c for c in cuts)].append(p)
        at += len(p) + (3 if k or True else 0)
    for k, g in enumerate(groups):
        for kind, x in warc.scan_range(g, k == 0):
            out.append(x) if kind == "record" else edges.append(x)
    held = b"".join(edges)
    return out + [x for kind, x in warc.scan_range(held.split(warc.MAGIC)[1:], False, True) if kind == "record"]


def test_any_cut():
    rnd = random.Random(8)
    for _ in range(150):
        records, want = [], []
        for i in range(6):
            body = b"".join(rnd.choice((warc.MAGIC, warc.MAGIC + b"\x00" * 7, warc.MAGIC + b"\x08", b"abc", rnd.randbytes(4))) for _ in range(rnd.randint(0, 60)))
            head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:palaver:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            pack = zlib.compressobj(rnd.choice((0, 6)), zlib.DEFLATED, 31)
            records.append(pack.compress(head + body + b"\r\n\r\n") + pack.flush())
            want.append((i, len(body)))
        data = b"".join(records)
        cuts = sorted(rnd.randrange(1, len(data)) for _ in range(rnd.randint(0, 5)))
        assert sorted((r["page_id"], r["payload_bytes"]) for r in scan(data, cuts)) == want


def test_false_magics_and_small_ranges(spark, tmp_path):
    """Stored members whose bytes hold the magic again and again, over ranges that cut through them."""
    rnd = random.Random(2)
    records, rows = [], []
    for i in range(40):
        body = b"".join(rnd.choice((warc.MAGIC, warc.MAGIC + b"\x00" * 7, b"abc", rnd.randbytes(9))) for _ in range(rnd.choice((3, 40, 300))))
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:palaver:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        pack = zlib.compressobj(rnd.choice((0, 6)), zlib.DEFLATED, 31)
        records.append(pack.compress(head + body + b"\r\n\r\n") + pack.flush())
        rows.append((i, len(body), hashlib.sha256(body).hexdigest()))
    damaged = records[:20] + [records[5][: len(records[5]) // 2]] + [b"garbage" + warc.MAGIC] + records[20:]
    os.makedirs(tmp_path / "z")
    (tmp_path / "z/a.warc").write_bytes(b"".join(damaged))
    (tmp_path / "z/b.warc").write_bytes(records[0])
    want = sorted([*rows, rows[0]])
    for size in ("2500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "z")).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert found == want, size


def test_revisits_of_other_archives_may_lack_size_and_digest():
    head = "WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n"
    for line, digest in (("", None), ("WARC-Payload-Digest: sha1:ABCDEF\r\n", None), (f"WARC-Payload-Digest: sha256:{'AB' * 32}\r\n", "ab" * 32)):
        found = warc.parse_record(f"{head}{line}\r\n".encode())
        assert (found["payload_bytes"], found["payload_digest"], found["page_id"]) == (None, digest, None)


def test_one_payload_on_a_third_of_the_pages(spark, tmp_path):
    rows = [(k, f"u{k}", "hot" * 50 if k % 3 == 0 else f"page {k} " * 20) for k in range(300)]
    path = str(tmp_path / "hot")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4), path)
    found = warc.read_warc(spark, path, payload=False).collect()
    assert len(found) == 300 and {r.page_id for r in found if r.record_type == "revisit" and r.refers_to == 0} == set(range(3, 300, 3))
