import random

import numpy as np

from palaver.llm import substring as sub


def test_gear_is_the_recurrence():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(sub._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert sub.gear(data).tolist() == want


def test_boundaries_are_local():
    rnd = np.random.default_rng(2)
    data = rnd.integers(97, 105, 3000).astype(np.uint8)
    a = sub.boundaries(data)
    b = sub.boundaries(np.concatenate([data[:1000], rnd.integers(97, 105, 7).astype(np.uint8), data[1000:]]))
    assert min(np.diff(a)) > sub.REACH and len(a) > 40
    assert set(a[a < 900]) <= set(b) and set(a[a > 1100] + 7) <= set(b)
    assert len(sub.boundaries(np.full(500, 97, np.uint8))) <= 1


def fixture():
    rnd = random.Random(11)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    passages = [words(n) for n in (52, 60, 80, 200, 51)]
    short = words(30)
    rows, want = [], {}
    for i in range(90):
        kind = rnd.choice(("clean", "short", *range(5)))
        text = words(rnd.randint(0, 120))
        if kind == "short":
            text += " " + short + " " + words(40)
        elif kind != "clean":
            text += rnd.choice((" ", "\n")) + passages[kind] + " " + words(rnd.randint(0, 90))
            want.setdefault(kind, []).append(i)
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "aaaa" * 500), (903, "aaaa" * 500)]
    return rows, passages, want


def test_passages_are_found_and_others_left(spark):
    rows, passages, want = fixture()
    df = spark.createDataFrame([*rows, (None, passages[0])], "doc_id bigint, text string").selectExpr("*", "1 as start", "2 as digest").repartition(3)
    out = sub.repeats(df)
    found = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for r in out.collect():
        assert texts[r.doc_id][r.start : r.end] == texts[r.first_doc_id][r.first_start : r.first_start + r.end - r.start]
        assert r.n_words > 50 and r.first_doc_id < r.doc_id
        found.setdefault(r.doc_id, set()).add(r.first_doc_id)
    # a chunk at a passage's edge may be shared with a later holder alone, which is then reported besides the first
    assert found.keys() == {i for ids in want.values() for i in ids[1:]}
    assert all(min(found[i]) == ids[0] and found[i] < set(ids) for ids in want.values() for i in ids[1:])
    left = {r.doc_id: r.text for r in sub.remove_repeats(df, out).collect()}
    for kind, ids in want.items():
        assert passages[kind] in left[ids[0]] and all(passages[kind][20:-20] not in left[i] for i in ids[1:])
    assert sub.repeats(df.limit(0)).count() == 0


def uncovered(rows, spans):
    """Windows of 51 words that an earlier document holds and that no span covers, without chunks."""
    import re

    seen, missed = set(), []
    for doc, text in sorted(rows):
        raw, own = text.encode(), set()
        at = [m.span() for m in re.finditer(rb"\S+", raw)]
        for (a, _), (_, b) in zip(at, at[50:], strict=False):
            own.add(raw[a:b])
            if raw[a:b] in seen and not any(d == doc and x <= a and b <= y for d, x, y in spans):
                missed.append((doc, a, b))
        seen |= own
    return missed


def spans_of(spark, rows):
    texts = {i: t.encode() for i, t in rows}
    out = sub.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    for r in out:
        part = texts[r.doc_id][r.start : r.end]
        assert part == texts[r.first_doc_id][r.first_start : r.first_start + len(part)] and len(part.split()) == r.n_words > 50
    return [(r.doc_id, r.start, r.end) for r in out]


def test_copies_after_near_copies_are_found_whole(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    rows = []
    for g in range(6):
        base = [word() for _ in range(300)]
        rows += [(100 * g + k, " ".join(word() if rnd.random() < 1 / 35 else w for w in base)) for k in range(20)]
        rows += [(100 * g + 50, " ".join(base)), (100 * g + 51, " ".join(base))]
    spans = spans_of(spark, rows)
    texts = dict(rows)
    assert not uncovered(rows, spans)
    for g in range(6):
        copy = 100 * g + 51
        assert len({x for d, a, b in spans if d == copy for x in range(a, b)}) == len(texts[copy])


def test_periodic_runs_are_found(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    runs = [" ".join(["For"] * 60), " ".join(["In."] * 200), " ".join(["ab", "cde"] * 40), "\n".join(["x"] * 70), " ".join(["one", "two", "three", "four"] * 20)]
    rows = [(10 * k + i, f"{words(30)} {run} {words(30)}") for k, run in enumerate(runs) for i in range(2)]
    spans = spans_of(spark, rows)
    assert {d for d, _, _ in spans} == {10 * k + 1 for k in range(len(runs))}
    assert not uncovered(rows, spans)
