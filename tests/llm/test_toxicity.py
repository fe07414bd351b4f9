import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palaver.llm import toxicity as tx


def sets(texts):
    out = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        out.append(np.unique(np.concatenate([f for _, f in tx.features(np.array([0, len(data)]), data)] + [np.zeros(0, np.uint32)])))
    return out


def test_features_do_not_depend_on_the_run():
    texts = ["Foo bar", "", "barfoo é", "bar"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    together = [set() for _ in texts]
    for row, feature in tx.features(offsets, data):
        for r, f in zip(row.tolist(), feature.tolist(), strict=True):
            together[r].add(f)
    assert together == [set(x.tolist()) for x in sets(texts)]
    assert together[3] < together[0] and not together[1]


def test_learns_from_positives_and_a_mixture():
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["river", "house", "tree", "walk", "stone", "cloud"], 30)) for _ in range(600)]
    bad = [t + " " + rng.choice(["vileword", "badthing", "uglyone"]) for t in clean[:300]]
    model = tx.learn(sets(bad[:150]), sets(clean[300:] + bad[150:190]), 0.12)
    s = model.scores(pa.array([*bad[190:], *clean[:100], "", None]))
    assert (s[:110] > 0.5).all() and (s[110:] < 0.5).all() and ((s >= 0) & (s <= 1)).all()


def test_without_confirmed_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string").selectExpr("*", "1 as extra")
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1)], "doc_id bigint, toxic int")
    out = tx.score(df, tx.learn(*tx.training_sets(df, labels))).collect()
    assert sorted((r.doc_id, r.extra, r.predicted) for r in out) == [(1, 1, 0), (2, 1, 0)]
    assert tx.score(df.limit(0), tx.learn([], [], 0.0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    rows = tx.op2_toxicity(spark, sf).collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert above > 0.95  # one in twenty toxic texts is junk without a word of its own


def test_columns_named_as_results_are_replaced(spark):
    model = tx.Model(np.zeros(0, np.int64), np.zeros(0), -1.0)
    df = spark.createDataFrame([(1, "x", "old"), (None, None, "old"), (1, "y" * 3_000_000, "old")], "doc_id bigint, text string, score string").selectExpr("*", "7 as predicted", "2 as band")
    out = tx.score(df, model)
    assert out.columns == ["doc_id", "band", "score", "predicted"] and {(r.predicted, round(r.score, 3)) for r in out.collect()} == {(0, 0.269)}
