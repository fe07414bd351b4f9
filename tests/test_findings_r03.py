import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palaver.operators import episodes, identity, usage
from palaver.plans.queries_rollups import QUERIES, SQL
from tests import compare


def test_f1_calendar_against_all_pairs(spark):
    draw = random.Random(1)
    base = datetime(2024, 1, 1, 9)
    at = lambda: base + timedelta(minutes=draw.randrange(0, 400))
    calls = [(k, None if k % 17 == 0 else at(), draw.choice([None, 0.0, 90.0, 4000.0])) for k in range(150)] + [(3, at(), 5.0), (None, at(), 1.0)]
    events = [(k, s := at(), s + timedelta(minutes=draw.choice([-3, 0, 5, 90]))) for k in range(40)] + [(99, base, None), (98, None, base), (97, base - timedelta(days=200), base + timedelta(minutes=9))]
    events += [(e[0] + 200, e[1], e[2]) for e in events[:9]]
    c = spark.createDataFrame(calls, "call_id bigint, recorded_at timestamp, duration_seconds double")
    e = spark.createDataFrame(events, "event_id bigint, event_start timestamp, event_end timestamp")
    pad = timedelta(minutes=30)
    want = {}
    for call, t, n in calls:
        found = [(s, k) for k, s, x in events if t and s and x and s <= t + timedelta(seconds=n or 0) + pad and x >= t - pad]
        want[call] = min([*found, *([want[call]] if want.get(call) else [])], default=None)
    want[None] = None
    out = identity.calendar_matches(c, e)
    got = out.collect()
    assert len(got) == len(calls) and all((want[r.call_id] or (None, None)) == (r.event_start, r.event_id) for r in got)
    # the work does not grow with the pairs that fall into an hour: what is joined is keyed by calls and by ranges
    keys = re.findall(r"Join \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert keys and all(re.match(r"(call_id|_part)#", k) for k in keys)
    assert identity.calendar_matches(c, e.limit(0)).where("event_id is not null").count() == 0
    assert identity.calendar_matches(c.limit(0), e).count() == 0


def test_f2_items_that_begin_or_end_inside_a_word(spark, tmp_path):
    texts = ["xalpha beta gammay", "alpha beta gamma", "a longest b", "alongest b", "say foobar now", "foo\nbar", "foo bar", "", None, " lead x", "lead x", "x tail ", "one  two three", "alpha beta gamma"]
    docs = [(k, t, "en") for k, t in enumerate(texts)] + [(50, "alpha beta gamma", "de"), (1, "alpha beta gamma beta", "en"), (None, "foo bar", "en")]
    items = ["alpha beta gamma", "alpha beta gamma", "longest b", "oob", "foo bar", "o b", "", None, " lead x", "tail ", "e  two t", " ", "nowhere at all"]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = compare.duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert not compare.difference(spark, con, str(tmp_path), QUERIES["verbatim_items"], SQL["verbatim_items"])


def test_f3_means_round_as_sql_does(spark):
    want = compare.duckdb.connect().execute("SELECT round(6.6499999999999995::DOUBLE, 1), round(4.449999999999999::DOUBLE, 1), round(-6.6499999999999995::DOUBLE, 1)").fetchall()[0]
    means = spark.createDataFrame([(6.6499999999999995, 4.449999999999999, -6.6499999999999995)], "a double, b double, c double")
    assert tuple(means.select(*[episodes.tenths(F.col(c)) for c in "abc"]).first()) == want == (6.7, 4.4, -6.7)
    # the tenfold of each first half's mean is a tie, its decimals are not
    groups = [[5.4497, 3.7632, 0.8371], [3.8919, 4.211, 2.5471], [2.784, 2.4811, 5.3849]]
    rows = [(g, k, s) for g, v in enumerate(groups) for k, s in enumerate([*v, 1.0, 2.0, 3.0])]
    con = compare.duckdb.connect()
    con.execute("CREATE TABLE t (g BIGINT, k BIGINT, s DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT g, round(avg(s), 1) FROM (SELECT * FROM t WHERE k < 3 ORDER BY g, k) GROUP BY g").fetchall())
    df = spark.createDataFrame(rows, "g bigint, k bigint, score double")
    assert {r.g: r.first_half for r in episodes.half_trend(df, ["g"], ["k"]).collect()} == want
    for g, m in want.items():
        assert episodes.overall_trend(df.where(F.col("g") == g).coalesce(1), ["k"]).first().first_half == m


def test_f5_entries_are_not_shuffled_by_model(spark):
    entries = spark.range(2000).selectExpr("id as pos", "if(id % 50 = 0, 'B', 'A') as model", "10 as input_tokens", "20 as output_tokens")
    prices = spark.createDataFrame([("A", 1.0, 2.0)], "model string, price_in double, price_out double")
    out = usage.priced(entries, prices)
    assert "Exchange hashpartitioning(model" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.model, r.cost_usd) for r in out.collect()} == {("A", 0.00005), ("B", 0.00033)}


def test_f4_f6_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *range(25)])) for _ in range(900)]
    calls = {}
    for c, a in rows:
        if c is not None and a is not None:
            calls.setdefault(c, set()).add(a)
    want = {}
    for found in calls.values():
        for a in found:
            for b in found - {a}:
                want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(identity, "PAIRS_A_TASK", 300)
    out = identity.co_speakers(spark.createDataFrame(rows, "call_id bigint, cluster_id bigint"))
    assert {(r.a, r.b): r.calls for r in out.collect()} == want
    listed = sum(len(x) * (len(x) - 1) // 2 for x in calls.values())
    assert re.search(rf"hashpartitioning\(call_id#\d+L?, {listed // 300 + 1}\)", out._jdf.queryExecution().executedPlan().toString())
    assert identity.co_speakers(spark.createDataFrame([], "call_id bigint, cluster_id bigint")).count() == 0
