import random

import numpy as np

from palaver.llm import decontaminate as d


def plain(text):
    return "".join(map(chr, d.normalise(text)[0]))


def least_edits(p, t):
    """Edits of the whole passage against any part of the text."""
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def edited(rnd, text, n):
    x = list(text)
    for _ in range(n):
        k = rnd.randrange(len(x))
        kind = rnd.randrange(3)
        if kind == 0:
            x[k] = rnd.choice("xyz")
        elif kind == 1:
            x.insert(k, rnd.choice("xyz"))
        else:
            del x[k]
    return "".join(x)


def fixture():
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice(("the", "of", "anea", "tion", "erth", "shé", "ou", "ing")) for _ in range(n))
    items = [(i, words(rnd.choice((6, 12, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for i in range(80):
        text = words(rnd.choice((0, 5, 60)))
        if rnd.random() < 0.7:
            p = rnd.choice(items[:12])[1]
            text += " " + rnd.choice((p, p.upper(), p.replace(" ", ",\n"), edited(rnd, p, len(p) // 12), edited(rnd, p, len(p) // 5), p[: len(p) // 2])) + ". " + words(rnd.choice((0, 5, 40)))
        docs.append((i, text))
    return [*docs, (900, None), (901, ""), (902, items[0][1] * 3)], items


def test_against_every_alignment(spark):
    docs, items = fixture()
    want = set()
    for i, t in docs:
        for item, p in items:
            x, y = plain(p), plain(t)
            if len(x) >= d.MIN_CHARS:
                most = min(int(len(x) * d.EDIT_SHARE), (len(x) + 1) // d.Q - 2)
                if y and least_edits(x, y) <= most:
                    want.add((i, item))
    a = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'q' as item_id")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (d.SLICE_CHARS, 300):
        rows = d.leaks(a, b, slice_chars=size).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
    texts = dict(docs)
    for r in rows:
        p, t = plain(dict(items)[r.item_id]), plain(texts[r.doc_id][r.start_char : r.end_char])
        assert least_edits(p, t) == r.edits
    kept = {r.doc_id for r in d.decontaminate(a, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert d.leaks(a.limit(0), b).count() == 0 and d.leaks(a, b.limit(0)).count() == 0


def test_align_is_exact():
    rnd = random.Random(9)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    pairs = [("".join(rnd.choice("ab") for _ in range(rnd.randint(4, 20))), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 30)))) for _ in range(300)]
    for (p, t), got in zip(pairs, d.align([(code(p), code(t), -len(p), len(t), len(p)) for p, t in pairs]), strict=True):
        want = least_edits(p, t)
        assert got[0] == want and least_edits(p, t[got[1] : got[2]]) == want


def test_many_texts_against_many_passages():
    rnd = random.Random(7)
    passages = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(20)) for _ in range(3)]
    index = d.Index(list(enumerate(passages)))
    texts = [np.zeros(0, np.uint32)] * 10_000
    for t, p in ((0, 0), (5_000, 1), (9_999, 2)):
        texts[t] = index.passages[p]
    want = index.regions(texts)
    # passages without a shared q-gram only widen the keys
    index.passages += [index.passages[0]] * 60_000
    assert index.regions(texts) == want and {(t, p) for t, p, _, _ in want} == {(0, 0), (5_000, 1), (9_999, 2)}


def test_many_short_passages_and_texts():
    rnd = random.Random(12)
    passage = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(5))
    index = d.Index([(i, passage()) for i in range(60_000)])
    texts = [d.normalise(passage())[0] for _ in range(20_000)]
    texts[7] = index.passages[59_999]
    assert (7, 59_999) in {(t, p) for t, p, *_ in d.occurrences(index, texts)}


def test_slices_are_searched_for_one_after_the_other(spark):
    docs, items = fixture()
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole, parts = d.leaks(a, b), d.leaks(a, b, slice_chars=400)
    assert parts.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert sorted(whole.collect()) == sorted(parts.collect())
