import re
from collections import Counter

import numpy as np
import pytest

from palaver.llm import phrases


def brute(rows, longest=4, least=30, top=2000, held=80):
    count, total = Counter(), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            lang = lang if lang is not None else "und"
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    cands = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    out = []
    for (lang, p), a in cands.items():
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= held * a for (x, q), f in cands.items()):
            continue
        score, k = min((2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, left, right, total[lang], -score))
    return ranked


def mined(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 7)])
def test_against_brute_force(spark, least, top):
    rng = np.random.default_rng(7)
    vocabulary = ["the", "The", "of", "new", "york", "città", "x\xa0y", "É", "é", "a"] + [f"w{k}" for k in range(30)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(150):
        words = list(rng.choice(vocabulary, size=int(rng.integers(0, 40)), p=weights / weights.sum()))
        text = "".join(w + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "])) for w in words)
        rows.append((text, [None, "en", "en", "und", "fr"][k % 5]))
    rows += [(None, "en"), ("", None), ("new york city\u0085of light " * 5, "en")] + [("same words here again", "de")] * 4
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "2 as n", "named_struct('a b', 1) as `c``d`").repartition(5)
    assert mined(df, least=least, top=top) == brute(rows, least=least, top=top)


def test_a_bitmap_errs_on_the_side_of_counting(spark, monkeypatch):
    """With a bitmap that lets everything pass the result is the same."""
    rows = [("a b c d a b c d. a b x", "en")] * 3 + [("b c d e", "en")] * 2
    df = spark.createDataFrame(rows, "text string, lang string")
    want = brute(rows, least=2)
    assert mined(df, least=2) == want
    from palaver.llm import shared

    monkeypatch.setattr(shared, "LEAST_BITS", 8)
    monkeypatch.setattr(shared, "MOST_BITS", 8)
    bits = phrases._bits(spark.createDataFrame([("en", "a")], "lang string, phrase string"))
    assert bits.bits == 8


def test_long_texts_ties_and_empty_tables(spark):
    long = "tick tock " * 150_000
    df = spark.createDataFrame([(long, None), ("x" * 3_000_000, "en"), ("b c. a d. b c. a d", "de")], "text string, lang string")
    out = mined(df, least=2)
    assert [r[:4] for r in out if r[0] == "de"] == [("de", 1, "a d", 2), ("de", 2, "b c", 2)]  # a tie goes by the phrase
    assert sorted(r[2] for r in out if r[0] == "und") == ["tick tock tick tock", "tock tick tock tick"] and {r[6] for r in out if r[0] == "und"} == {300_000}
    assert mined(df.limit(0)) == []
    assert mined(df.where("text is null")) == []


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products don't fit 64 bits."""
    from pyspark.sql import functions as F

    big = 2**45 + 1
    row = spark.range(1).select(((F.lit(big).cast("decimal(20,0)") * F.lit(2_000_000))).alias("t"), (F.lit(big).cast("decimal(20,0)") + F.lit(big + 2).cast("decimal(20,0)")).alias("s"))
    assert row.select(F.expr("t div s")).first()[0] == 2_000_000 * big // (2 * big + 2)


def test_different_phrases_of_one_hash_stay_apart():
    offsets = np.array([0, 11])
    words = phrases.Words(offsets, np.frombuffer(b"aa bb aa cc", np.uint8))
    at = words.phrases(1)
    words.sums[0][:] = 0  # all hashes of the first kind equal
    first, count = phrases._together(words, at, 1, np.zeros(1, np.int64), np.zeros(1, np.uint64))
    got = Counter()
    for w, c in zip(words.strings(first, 1).to_pylist(), count.tolist(), strict=True):
        got[w] += c
    assert got == {"aa": 2, "bb": 1, "cc": 1}
