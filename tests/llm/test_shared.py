import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palaver.llm import shared


def test_key_bits(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.col("id") * 7919).alias("k"), F.col("id").cast("string").alias("v"))
    keys = df.where("v like '%1'").select("k")
    for hashed in (False, True):
        bits = shared.KeyBits(keys, "k", hashed)
        yes, no = bits.maybe(df, "k"), bits.maybe(df, "k", present=False)
        assert yes.columns == no.columns == df.columns and yes.count() + no.count() == 5000
        wanted = {r.k for r in keys.collect()}
        assert wanted <= {r.k for r in yes.collect()} and yes.count() < 1000
        assert no.where("k is null").count() == 500
    none = shared.KeyBits(keys.limit(0), "k")
    assert none.maybe(df, "k").count() == 0 and none.maybe(df, "k", present=False).count() == 5000


def test_words_of_runs():
    texts = ["One  two\tthree", "", " four\n", "five", "onetwo", "ONE é"]
    column = pa.array([*texts, None])
    seen, hashes = [], {}
    for limit in (1 << 20, 3):
        got = []
        for first, offsets, data in shared.text_runs(column, limit):
            h, begin, end, at = shared.word_hashes(offsets, data)
            for r in range(len(offsets) - 1):
                for k in range(at[r], at[r + 1]):
                    word = data[begin[k] : end[k]].tobytes().lower()
                    assert hashes.setdefault(word, h[k]) == h[k]
                    got.append((first + r, word))
        seen.append(got)
    assert seen[0] == seen[1] and [w for _, w in seen[0]] == [b"one", b"two", b"three", b"four", b"five", b"onetwo", b"one", "é".encode()]
    assert len({int(x) for x in hashes.values()}) == len(hashes)


def test_materialized_tables_are_deleted(spark):
    df = shared.materialize(spark.range(3).withColumn("x", F.lit(np.pi)), "t")
    assert df.count() == 3 and df.columns == ["id", "x"]
    path = df.__dict__["_palaver_path"]
    shared.discard(df)
    shared.discard(None)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_long_runs_are_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdé  \n"), 5000))
    column = pa.array([text, "x" * 300, None, text])
    (_, offsets, data), *none = shared.text_runs(column)
    want = shared.word_hashes(offsets, data)
    assert not none
    monkeypatch.setattr(shared, "PERIOD", 64)
    monkeypatch.setattr(shared, "_POWERS", {})
    got = shared.word_hashes(offsets, data)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert len(shared._POWERS["up"]) == 64


def test_scratch_tables_go_with_their_block(spark):
    with shared.scratch():
        inner = shared.materialize(spark.range(3), "t")
        with shared.scratch():
            second = shared.materialize(inner.selectExpr("id + 1 as id"), "t")
            assert second.count() == 3
        assert inner.count() == 3 and second.__dict__["_palaver_path"] not in shared._WRITTEN
    assert inner.__dict__["_palaver_path"] not in shared._WRITTEN


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Context:
        master, applicationId = "yarn", "x"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    Context.master = "local[2]"
    assert "palaver-" in shared.shared_dir(Session)


def test_heavy_keys_are_looked_up(spark):
    keys = spark.createDataFrame([(1, 9, 5000), (2, 8, 3), (3, 7, 1)], "k int, v int, n bigint")
    rows = spark.range(6000).selectExpr("id", "case when id < 5000 then 1 when id < 5003 then 2 when id < 5004 then 3 when id < 5500 then 4 end as k")
    got = {r.v: r["count"] for r in shared.look_up(rows, keys, ["k"], "n").groupBy("v").count().collect()}
    assert got == {9: 5000, 8: 3, 7: 1} and shared.look_up(rows, keys.limit(0), ["k"], "n").count() == 0


def test_worker_state_belongs_to_one_owner():
    made = []
    make = lambda x: lambda: made.append(x) or [x]
    assert shared.worker_state("a", 1, make("a")) is shared.worker_state("a", 1, make("never"))
    shared.worker_state("b", 1, make("b"))
    assert list(shared._STATE) == [("b", 1)] and made == ["a", "b"]
