import math
import random

import numpy as np
import pytest

from palaver.llm import egojoin


def brute(rows, cosine=0.98):
    good = [(i, l, np.array(v, float)) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {i: [0, i] for i, _, _ in rows}
    root = {i: i for i in out}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, l, v) in enumerate(good):
        for j, m, w in good[k + 1 :]:
            if l == m and len(v) == len(w) and v @ w / (math.sqrt(v @ v) * math.sqrt(w @ w)) >= cosine:
                out[i][0] += 1
                out[j][0] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n, find(i), find(i) == i) for i, (n, _) in out.items()}


@pytest.mark.parametrize("block, leaf", [(512, 64), (7, 3)])
def test_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(30):
        v = rng.normal(size=10)
        for _ in range(int(rng.integers(1, 12))):
            w = v + rng.normal(size=10) * rng.choice([0.0, 0.05, 0.15, 0.2])
            rows.append((len(rows) * 3 + 1, base % 4, [float(x) for x in w * rng.choice([1, 2])]))
    n = len(rows) * 3
    v = rows[0][2]
    rows += [(n + 1, None, v), (n + 2, 0, None), (n + 3, 0, [0.0] * 10), (n + 4, 0, [None, *v[1:]]), (n + 5, 0, [float("nan"), *v[1:]]), (n + 6, 0, [float("inf"), *v[1:]]), (n + 7, 0, v[:5]), (n + 8, 0, []), (n + 9, 0, [x * 1e-30 for x in v])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 as dim", "2 as n_links").repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in egojoin.near_duplicates(df).collect()}
    assert out == brute(rows)


def test_missing_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, [1.0]), (3, 1, [1.0]), (3, 1, [2.0])], "vec_id bigint, label int, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in egojoin.near_duplicates(df).collect()) == [("3", 2, 3), ("3", 2, 3), ("None", 0, None)]  # both links of the id 3
    assert egojoin.near_duplicates(df.limit(0)).count() == 0
