import random

from palaver.llm import linededup as ld


def brute(rows):
    """Remove all but the first place of each repeated chunk, by dictionary."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        parts = ld.chunks(text) if text else []
        kept = []
        for k, (_, _, content, raw) in enumerate(parts):
            if content >= 2 and "\n" in text and seen.setdefault(raw, (doc, k)) != (doc, k):
                continue
            kept.append(raw)
        out[doc] = b"\n".join(kept).decode() if text else text
    return out


def fixture():
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(3, 15))] for _ in range(8)]
    rows = []
    for i in range(120):
        lines = [f"{rnd.random()}" for _ in range(rnd.randint(0, 6))] + rnd.choice(passages) + [f"{rnd.random()}" for _ in range(rnd.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "\n\n\n\n"), (504, "one line"), (505, "one line"), (506, rows[3][1]), (507, rows[3][1])]


def test_chunks_cover_the_text():
    for _, text in fixture():
        if text:
            parts = ld.chunks(text)
            assert b"\n".join(p[3] for p in parts).decode() == text
            assert all(b - a >= 2 for a, b, _, _ in parts) or len(parts) == 1


def test_boundaries_resist_shifts():
    rnd = random.Random(1)
    lines = [str(rnd.random()) for _ in range(200)]
    a = {p[3] for p in ld.chunks("\n".join(lines))}
    b = {p[3] for p in ld.chunks("\n".join(["new", *lines[:100], "other", *lines[100:]]))}
    assert len(a & b) >= 0.8 * len(a)


def test_against_dictionary(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as chunk", "3 as h1").repartition(3)
    out = ld.dedup(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)
    assert {r.n_removed for r in ld.dedup(df, counts=True).where("doc_id = 507").collect()} == {rows[3][1].count("\n") + 1}
    assert ld.dedup(df.limit(0)).count() == 0


def stretches(rows):
    """Rows without lines that are in an equal stretch, from one line of letters or digits to another, that begins earlier.

    By comparing all pairs of places.
    """
    texts = {i: t.encode().split(b"\n") for i, t in rows if t}
    full = {i: [bool(ld._CONTENT & set(x)) for x in lines] for i, lines in texts.items()}
    places = [(i, k) for i in sorted(texts) for k in range(len(texts[i])) if full[i][k]]
    by_line = {}
    gone = {i: set() for i in texts}
    for i, k in places:
        for j, m in by_line.setdefault(texts[i][k], []):
            n, seen = 0, 0
            while k + n < len(texts[i]) and m + n < len(texts[j]) and texts[i][k + n] == texts[j][m + n]:
                n += 1
                seen += full[i][k + n - 1]
                if full[i][k + n - 1] and seen >= 2:
                    gone[i].update(x for x in range(k, k + n) if i != j or x >= m + n)
        by_line[texts[i][k]].append((i, k))
    return {i: "\n".join(x.decode() for k, x in enumerate(texts[i]) if k not in gone[i]) if t else t for i, t in rows}


def test_whole_stretches_of_any_place(spark):
    rnd = random.Random(8)
    passages = [[rnd.choice(("", "", "--", f"p{rnd.random()}")) for _ in range(n)] for n in (2, 3, 4, 5, 6, 8, 12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 3)):
            lines += [rnd.choice(("", "--", f"{rnd.random()}")) for _ in range(rnd.randint(0, 4))] + rnd.choice(passages)
        rows.append((i, "\n".join(lines)))
    rows += [(70, "x\nx\nx\nx\nx"), (71, "a\nb\n\na\nb\n\na\nb\n"), (72, "one\ntwo\nthree"), (73, "zero\ntwo\nthree\nfour"), (74, None), (75, ""), (76, "\n\n"), (77, "\n\n"), (78, rows[3][1])]
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), counts=True, whole=True).collect()}
    assert {i: t for i, (t, _) in got.items()} == stretches(rows)
    assert got[72] == ("one\ntwo\nthree", 0) and got[73] == ("zero\nfour", 2) and got[70] == ("x\nx", 3)


def test_the_query_removes_whole_stretches(spark, tmp_path):
    rows = [(i, "\n".join([f"before {i}", *(f"line {k} of {n}" for k in range(n)), f"after {i}"])) for n in (2, 3, 5, 8) for i in (2 * n, 2 * n + 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.op10_linededup(spark, str(tmp_path)).collect()}
    assert all(got[2 * n + 1] == (f"before {2 * n + 1}\nafter {2 * n + 1}", n) and got[2 * n][1] == 0 for n in (2, 3, 5, 8))


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(1, "a\nb"), (2, "a\nb"), (2, "c\nd")]
    out = ld.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), whole=True).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "a\nb"), (2, ""), (2, "c\nd")]


def test_equal_digests_of_different_bytes(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.text for r in ld.dedup(df, whole=True, mask=7).collect()} == stretches(rows)
    assert {r.doc_id: r.text for r in ld.dedup(df, mask=7).collect()} == brute(rows)


def test_cases_of_rows(spark):
    long = "\n".join(f"line {k}" if k % 1000 == 0 else "-=" [k % 2] for k in range(20_000))
    rows = [(None, "a\nb"), (None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (2, "a\nb\n"), (3, long), (4, long), (5, "é" * 100_000 + "\nx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as n_lines", "'y' as raw")
    out = ld.dedup(df, counts=True, whole=True)
    assert out.columns == ["doc_id", "text", "raw", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    rest = "\n".join("-="[k % 2] for k in range(19_001, 20_000))
    assert got == sorted([(None, "a\nb", 0)] * 2 + [(1, "a\nb", 0)] * 2 + [(2, "", 2), (3, long, 0), (4, rest, 19_001), (5, rows[-1][1], 0)], key=str)
