import random

from pyspark.sql import functions as F

from palaver.operators import ordering


def test_places_over_eight_ranges_with_ties_at_their_borders(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice([None, 1, 1, 1, 2, 3]), draw.choice(["a", "a", "a", None, "b`c"])) for k in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, score int, `group` string").selectExpr("*", "0 as _part", "1 as _value0", "named_struct('x y', id) as `s``t`")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordering.numbered(df, [F.col("score").desc_nulls_last(), F.col("id").asc()], "place")
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        got = sorted(out.collect(), key=lambda r: r.place)
        assert [(r.id, r.score, r.group) for r in got] == want and [r.place for r in got] == list(range(1, 4001))
        assert out.columns == [*df.columns, "place"]
        assert out.select("_part").distinct().count() == 1
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "_part" in plan
        per = ordering.numbered(df, [F.col("score").desc_nulls_last(), F.col("id").asc()], "place", ["group"])
        for g in ("a", None, "b`c"):
            mine = sorted((r for r in per.collect() if r.group == g), key=lambda r: r.place)
            assert [(r.id, r.score, r.group) for r in mine] == [r for r in want if r[2] == g]
            assert [r.place for r in mine] == list(range(1, len(mine) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_are_exact(spark):
    rows = [(k, k % 3, None if k % 7 == 0 else k) for k in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g bigint, v bigint")
    out = ordering.running(df, ["id"], {"sum": F.col("v"), "money": (F.col("v") * F.lit(0.01)).cast("decimal(20,6)")}, ["g"])
    now = {}
    for r in sorted(out.collect(), key=lambda r: r.id):
        now[r.g] = now.get(r.g, 0) + (r.v or 0)
        assert r.sum == now[r.g] and float(r.money) == round(now[r.g] * 0.01, 6)
    assert ordering.running(df.limit(0), ["id"], {"sum": F.col("v")}).count() == 0
    assert ordering.numbered(df.limit(0), ["id"], within=["g"]).columns == ["id", "g", "v", "place"]
