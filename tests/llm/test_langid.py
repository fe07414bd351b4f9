import random
import zlib

import numpy as np

from palaver.llm import langid


def longest_match_phrases(text, learned):
    """Phrases of a text by trying every substring."""
    count, i = 1, 0
    j = 0
    while j < len(text):
        if text[i : j + 1] in learned:
            j += 1
        else:
            count += 1
            i = j
            if text[j] not in learned:
                i = j + 1
            j += 1
    return count


def test_phrases_match_substring_search():
    rnd = random.Random(3)
    learned = ["".join(rnd.choice("abc ") for _ in range(300)).strip(), "".join(rnd.choice("abd ") for _ in range(300)).strip()]
    model = langid.learn({"x": [learned[0]], "y": [learned[1]]})
    squeezed = ["".join(map(chr, langid.letters(t))) for t in learned]
    texts = ["".join(rnd.choice("abcde ") for _ in range(n)) for n in (1, 5, 80, 700)]
    points = [langid.letters(t) for t in texts]
    got = langid.Parser(model).phrases(points)
    want = [[longest_match_phrases("".join(map(chr, p)), s) for s in squeezed] for p in points]
    assert got.tolist() == want


def test_long_texts_are_the_sum_of_their_segments():
    model = langid.learn({"x": ["abab baba aabb" * 5]})
    text = langid.letters("ab ba" * 1000)
    whole = langid.Parser(model).phrases([text])
    parts = langid.Parser(model).phrases([text[i : i + langid.SEGMENT] for i in range(0, len(text), langid.SEGMENT)])
    assert whole.sum() == parts.sum() and np.array_equal(whole[0], parts.sum(axis=0))


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the and of the", "en"), (5, "der die und", "de"), (5, "der die und", "de")], "doc_id bigint, text string, lang string").selectExpr("*", "1 as lang_pred", "'x' as score", "2 as band")
    model = langid.learn(langid.training_sample(df, "doc_id", "text", "lang"))
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] == "en" and out[5][0] == "de" and 0.5 <= out[4][1] <= 1
    assert langid.identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.learn({})).collect()} == {"und"}


def test_thousands_of_letters_take_little_memory():
    rnd = random.Random(9)
    letters = [chr(0x4E00 + k) for k in range(3000)], [chr(0x5E00 + k) for k in range(3000)], [chr(0x20000 + k) for k in range(3000)]
    draw = lambda k, n: "".join(letters[k][min(int(rnd.expovariate(1 / 300)), 2999)] for _ in range(n))
    model = langid.learn({f"l{k}": [draw(k, 40_000)] for k in range(3)})
    parser = langid.Parser(model)
    assert parser.slots.nbytes + parser.symbol.nbytes + model.starts.nbytes < 20 << 20
    assert [x for x, _ in parser.predict([draw(k, 50) for k in range(3)])] == ["l0", "l1", "l2"]


def test_displaced_rows_are_found_again():
    rnd = random.Random(2)
    rows = [(sorted(rnd.sample(range(1, 60), min(59, max(0, int(rnd.expovariate(0.6)))))), None) for _ in range(3000)]
    rows = [(x, [rnd.randrange(3000) for _ in x]) for x, _ in rows]
    base, slots = langid.displace(rows)
    assert len(set(base.tolist())) == len(rows) and len(slots) < 2 * sum(len(x) for x, _ in rows) + 4096
    for b, (symbols, targets) in zip(base.tolist(), rows, strict=True):
        known = dict(zip(symbols, targets, strict=True))
        for s in range(60):
            found = int(slots[b + s]) if b + s < len(slots) else -1
            assert (found >> 32 == b) == (s in known) and (s not in known or found & 0xFFFFFFFF == base[known[s]])


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    rows = langid.op8_langid(spark, sf).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    wrong = [r for r in held if docs[r.doc_id] != r.lang_pred]
    assert len(wrong) / len(held) < 0.02, [(docs[r.doc_id], r.lang_pred, r.score) for r in wrong][:10]
