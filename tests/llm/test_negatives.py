import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import negatives


def brute(rows, positives=5, most=3):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, l, q) in enumerate(good):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, w, strict=True)), j, m, k) for k, (j, m, w) in enumerate(good) if k != n and len(w) == len(q)]
        for ps, p, _, _ in sorted(s for s in scored if s[2] == l)[:positives]:
            found = sorted(s for s in scored if s[2] != l and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:most]
            out += [(i, p, rank + 1, j, -ps, -s) for rank, (s, j, _, _) in enumerate(found)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))


SCHEMA = "vec_id bigint, label int, embedding array<double>"


@pytest.mark.parametrize("block, anchors, fan", [(2048, 512, 8), (23, 5, 2)])
def test_against_brute_force(spark, monkeypatch, block, anchors, fan):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "FAN", fan)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        base = rng.normal(size=6) if k % 4 == 0 else base
        rows.append((k * 10, int(rng.integers(0, 4)), [float(x) for x in base + rng.choice([0.0, 0.1, 0.5]) * rng.normal(size=6)]))
    v = rows[0][2]
    rows += [(None, 1, v), (5050, None, v), (5100, 1, None), (5150, 1, [None, *v[1:]]), (5200, 1, [float("nan"), *v[1:]]), (5250, 1, [float("inf"), *v[1:]]), (5300, 1, v[:3]), (5301, 1, v[1:4]), (5302, 2, v[1:4]), (5350, 1, []), (5351, 1, []), (5352, 2, []), (5400, 1, [0.0] * 6)]
    rows += [(5450, 9, v)]  # a label of its own
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as uid", "2 as q", "named_struct('a b', 1) as `x``y`").repartition(3)
    want = brute(rows)
    assert mined(df) == want and len(want) > 500


def test_ties_and_repeated_rows(spark):
    rows = [(50, 1, [1.0, 0.0])] * 2 + [(k, 1, [1.0, 0.0]) for k in range(1, 9)] + [(k, 2, [0.9, 0.1]) for k in range(20, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df) == brute(rows)
    assert {r[1] for r in mined(df)} == {1, 2, 3, 4, 5} and {r[3] for r in mined(df)} == {20, 21, 22}


def test_negative_scores_have_no_window(spark):
    rows = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.7]), (50, 3, [0.0]), (51, 3, [1.0]), (52, 4, [5.0])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_large_integers(spark):
    """Scores beyond what doubles hold are exact; beyond 62 bits they are an error."""
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in rng.normal(size=4) * 2e6]) for k in range(0, 600, 10)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        mined(spark.createDataFrame([(0, 1, [1e9])], SCHEMA))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA)
    assert mined(df) == [] and mined(df.limit(0)) == []  # no anchors, no rows


def test_exact_scores_either_way():
    rng = np.random.default_rng(2)
    a, x = rng.integers(-300, 300, (20, 8)).astype(np.int32), rng.integers(-300, 300, (50, 8)).astype(np.int32)
    want = a.astype(np.int64) @ x.T.astype(np.int64)
    for share in (0.02, 0.9):
        keep = rng.random((20, 50)) < share
        for largest in (1e6, 1e18):
            got = negatives.scores(a, x, keep, largest)
            assert (got[keep] == want[keep]).all() and (got[~keep] == negatives.NONE).all()
