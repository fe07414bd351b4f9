import json

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import analyzers


@pytest.fixture
def cold_calls():
    analyzers.register("cold", lambda low: {"openers": T.hits(low, ["quick call", "catch you"]), "polite": T.any_hit(low, ["please"])}, ["cold-call", "sales-call"], {"cold-call": ("polite",)})
    yield
    analyzers.unregister("cold")
    made, kinds = analyzers.FAMILIES["sales"]
    analyzers.register("sales", made, ["sales-call", *kinds])


def sections(df, **options):
    return {r.call_id: (r.family, json.loads(r.sections)) for r in analyzers.analyze(df, **options).collect()}


def test_a_family_from_outside(spark, cold_calls):
    df = spark.createDataFrame([(1, "Please, a QUICK CALL", "cold-call"), (2, "did I catch you? please", "sales-call"), (3, "our budget", "sales-demo"), (4, "x", None), (5, None, "cold-call")], "call_id bigint, text string, call_type string")
    out = sections(df)
    assert out[1] == ("cold", {"openers": ["quick call"], "polite": True}) and out[2] == ("cold", {"openers": ["catch you"]})
    assert out[3][0] == "sales" and out[4] == ("simple", {}) and out[5][0] == "cold"
    assert analyzers.DISPATCH["sales-call"] == "cold" and analyzers.DISPATCH["sales-demo"] == "sales"
    assert analyzers.present(df) == ["sales", "cold"]


def test_plan_holds_present_families_only(spark):
    df = spark.createDataFrame([(1, "we have a budget", "sales-call"), (2, "no", "voice-memo"), (3, "no", "such-a-type"), (4, "no", None)], "call_id bigint, text string, call_type string")
    here = analyzers.present(df)
    assert here == ["sales", "simple"]
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    every, few = analyzers.analyze(df), analyzers.analyze(df, families=here)
    # all fields are printed; the plan as JSON doesn't fit a small heap
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert len(plan(few)) < len(plan(every)) / 5 and size(few) <= size(every)
    assert "sprint" not in plan(few).lower().replace("sprint-retro", "")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sections(df, families=here) == sections(df)
    assert sections(df, families=[])[1] == ("sales", {})
    with pytest.raises(ValueError, match="no such family"):
        analyzers.analyze(df, families=["nothing"])


def test_registration_is_checked(spark):
    with pytest.raises(ValueError):
        analyzers.register("", lambda low: {}, ["x"])
    with pytest.raises(ValueError):
        analyzers.unregister("sales")
    assert spark.range(1).select(analyzers.family_of(F.lit("standup"))).first()[0] == "business"
