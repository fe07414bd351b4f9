import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from palaver.operators import dynamics, identity, inference, redaction, usage
from palaver.plans import model

SEG = "call_id bigint, ord bigint, speaker string, text string, start double, end double"


def test_speech_overlap_cases(spark):
    rows = [
        (1, 0, "a", "one two", 0.0, 10.0), (1, 1, "b", "three", 5.0, 12.0), (1, 2, "a", None, 12.0, 15.0), (1, 3, "a", "x", 20.0, 20.0),  # overlap, touching, null text, empty
        (2, 0, "a", "w w w", 4.0, 1.0), (2, 1, None, "w", None, 3.0),  # ends before it starts, no start
        (3, 0, "a", "q", 1.0, 3.0), (3, 1, "b", "q", 1.0, 3.0), (3, 2, "c", "q", 2.0, 3.0),  # equal segments
        (None, 0, "a", "q", 0.0, 60.0),
    ]
    df = spark.createDataFrame(rows, SEG).selectExpr("*", "1 as words", "2 as depth")
    out = {r.call_id: r for r in dynamics.speech_overlap(df).collect()}
    assert tuple(out[1])[1:7] == (20.0, 15.0, 5.0, 5.0, 0.25, round(1 / 3, 6)) and out[1].words == 4
    assert out[1].words_per_minute == 12.0 and out[1].switches_per_minute == 6.0
    assert tuple(out[2])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4, 0.0, 0.0)
    assert (out[3].duration_seconds, out[3].speech_seconds, out[3].overlap_seconds, out[3].overlap_share) == (2.0, 2.0, 2.0, 1.0)
    assert out[None].words_per_minute == 1.0
    plan = dynamics.speech_overlap(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert dynamics.speech_overlap(df.limit(0)).count() == 0


def test_speech_overlap_against_a_clock(spark):
    draw = random.Random(2)
    rows = [(c, k, draw.choice("ab"), "w", float(a := draw.randrange(40)), float(a + draw.randrange(-2, 9))) for c in range(20) for k in range(draw.randrange(1, 12))]
    for r in dynamics.speech_overlap(spark.createDataFrame(rows, SEG)).collect():
        own = [(x[4], x[5]) for x in rows if x[0] == r.call_id and x[5] >= x[4]]
        ticks = [sum(a <= t < b for a, b in own) for t in range(60)]
        assert r.speech_seconds == sum(t > 0 for t in ticks) and r.overlap_seconds == sum(t > 1 for t in ticks)
        assert r.duration_seconds == (max(b for _, b in own) - min(a for a, _ in own) if own else 0)


def test_gini(spark):
    calls = {1: [5], 2: [3, 3, 3], 3: [0, 0], 4: [0, 10], 5: [1, 2, 2, 7, 7, 7], 6: [None, -4, 6]}
    df = spark.createDataFrame([(c, f"s{k}", x) for c, xs in calls.items() for k, x in enumerate(xs)], "call_id bigint, speaker string, word_count bigint")
    for r in dynamics.participation_gini(df).collect():
        x = [max(v or 0, 0) for v in calls[r.call_id]]
        want = sum(abs(a - b) for a in x for b in x) / (2 * len(x) * sum(x)) if sum(x) else 0
        assert (r.speakers, r.gini) == (len(x), round(want, 6))
    assert dynamics.participation_gini(df.limit(0)).count() == 0


def test_sentiment_arc(spark):
    said = ["good good", "fine", "good", "well", "good", "bad", "bad maybe", "terrible", "bad", "bad so"]
    rows = [(1, k, "a", t, float(k), float(k + 1)) for k, t in enumerate(said)]
    rows += [(2, k, "a", "good maybe", float(k), float(k + 1)) for k in range(9)] + [(3, 0, "a", "bad", None, None), (4, 0, "a", None, 0.0, 5.0), (5, 0, "a", "goodness", 0.0, 1.0)]
    arc = dynamics.sentiment_arc(spark.createDataFrame(rows, SEG), ["good", "fine"], ["bad", "terrible"], ["maybe", "perhaps"])
    out = {}
    for r in arc.collect():
        out.setdefault(r.call_id, []).append(r)
    one = sorted(out[1], key=lambda r: r.part)
    assert [r.valence for r in one] == [1.0, 1.0, 1.0, 0.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0]
    assert {r.change_point for r in one} == {5} and {r.hedge_rate for r in one} == {round(1 / sum(len(t.split()) for t in said), 6)}
    assert {r.change_point for r in out[2]} == {None} and {r.hedge_rate for r in out[2]} == {0.5} and {r.valence for r in out[2]} == {1.0}
    assert [(r.part, r.valence, r.change_point) for r in out[3]] == [(None, None, None)]
    assert {r.valence for r in out[4]} == {0.0} and {r.valence for r in out[5]} == {0.0}
    assert arc.limit(0).count() == 0


def test_sentiment_arc_weighs_by_time(spark):
    rows = [(1, 0, "a", "good", 0.0, 6.0), (1, 1, "b", "bad", 6.0, 8.0), (1, 2, "a", "ok", 90.0, 100.0)]
    out = {r.part: r.valence for r in dynamics.sentiment_arc(spark.createDataFrame(rows, SEG), ["good"], ["bad"], []).collect()}
    assert out == {0: 0.5, 9: 0.0}  # six seconds good, two bad


def test_budget(spark):
    rows = [(k, "ab"[k % 2], None if k == 3 else float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "id bigint, s string, cost_usd double").repartition(5)
    total, want = 0, []
    for k, _, c in rows:
        want.append((k, total <= 100))
        total += c or 0
    out = usage.admit(df, 100, ["id"])
    assert sorted((r.id, r.admitted) for r in out.collect()) == want
    asked = model.ask(out, F.col("s"), lambda p: p.upper(), admitted=F.col("admitted"))
    assert {r.id: r.reply for r in asked.collect()} == {k: "AB"[k % 2] if ok else None for k, ok in want}
    assert not any(r.admitted for r in usage.admit(df, -1, ["id"]).collect())
    per = usage.admit(df, 50, ["id"], within=["s"]).groupBy("s").agg(F.max("running_cost").alias("m"), F.count_if("admitted").alias("n")).collect()
    assert {(r.s, float(r.m), r.n) for r in per} == {("a", 380.0, 8), ("b", 397.0, 8)}
    assert usage.admit(df.limit(0), 1, ["id"]).count() == 0


def spread(members, seeds, rounds, damping=0.4, least=0.01):
    calls = {}
    for c, m in set(members):
        calls.setdefault(c, set()).add(m)
    count = {m: sum(m in s for s in calls.values()) for s in calls.values() for m in s}
    best = {}
    for c, n, x in seeds:
        if c not in best or (-x, n) < (-best[c][1], best[c][0]):
            best[c] = (n, x, 0)
    for r in range(rounds):
        heard = {}
        for s in calls.values():
            said = sorted((-best[m][1], best[m][0]) for m in s if m in best)
            for m in s if said else ():
                if m not in best:
                    x, n = heard.setdefault(m, {}).get(said[0][1], (0, 0))
                    heard[m][said[0][1]] = max(x, -said[0][0]), n + 1
        new = {}
        for m, labels in heard.items():
            ranked = sorted((-round(x * damping * n / count[m], 6), label) for label, (x, n) in labels.items() if round(x * damping * n / count[m], 6) >= least)
            if ranked:
                new[m] = (ranked[0][1], -ranked[0][0], r + 1)
        best |= new
    return {m: v for m, v in best.items() if v[2]}


@pytest.mark.parametrize("heavy", [1000, 2])
def test_propagated_evidence(spark, monkeypatch, heavy):
    from palaver.operators import joins

    monkeypatch.setattr(joins, "HEAVY", heavy * 5)
    draw = random.Random(heavy)
    members = [(draw.randrange(40), draw.choice([0, draw.randrange(60)])) for _ in range(150)]
    members += [(7, k) for k in range(30)]  # a crowded call
    seeds = [(k, f"N{k % 5}", 0.5 + k / 100) for k in range(0, 60, 9)] + [(0, "Z", 0.2), (9, None, 1.0), (None, "Q", 1.0), (18, "Q", None)]
    df = spark.createDataFrame([*members, (None, 1), (3, None)], "call_id bigint, cluster_id bigint")
    sd = spark.createDataFrame(seeds, "cluster_id bigint, name string, confidence double")
    got = {r.cluster_id: (r.name, r.confidence, r.hops) for r in identity.propagated_evidence(df, sd).collect()}
    want = spread(members, [s for s in seeds if None not in s], 3)
    assert got == {m: v for m, v in want.items()} and len(want) > 10
    assert identity.propagated_evidence(df.limit(0), sd).count() == 0 and identity.propagated_evidence(df, sd.limit(0)).count() == 0


def test_email_and_topic_evidence(spark):
    m = spark.createDataFrame([(1, 10, "Ann Lee"), (1, 11, None), (2, 12, None), (2, 13, None), (3, 14, ""), (4, 15, None)], "call_id bigint, cluster_id bigint, name string")
    e = spark.createDataFrame([(1, "ann lee", 0), (1, "Bo Ray", 1), (1, "Bo Ray", 2), (2, "Cy", 0), (3, "Dee", 0), (3, "Eve", 1), (4, None, 0)], "call_id bigint, name string, pos bigint")
    assert [tuple(r) for r in identity.email_evidence(m, e).collect()] == [(11, "email", "Bo Ray", 0.7, "thread=2", 1, 1)]
    assert [(r.cluster_id, r.name) for r in identity.email_evidence(m.drop("name"), e).collect()] == []
    t = spark.createDataFrame([(1, "law", 5), (2, "law", 4), (2, "tax", 4), (3, "law", 2), (4, "cars", 9), (5, "cars", 3), (6, "cars", 3), (7, None, 9)], "cluster_id bigint, topic string, calls bigint")
    n = spark.createDataFrame([(1, "Kim"), (4, "Lou"), (5, "Max"), (6, None)], "cluster_id bigint, name string")
    assert [tuple(r) for r in identity.topic_evidence(t, n).collect()] == [(2, "topic", "Kim", 0.5, "topic=law")]


def replaced(text, names):
    """One name after another at each place, the longest first."""
    out, at, n = "", 0, 0
    word = re.compile(r"\w")
    while at < len(text):
        for name in sorted(names, key=len, reverse=True):
            end = at + len(name)
            inside = text[at:end].lower() == name and not (at and word.match(text[at - 1]) and word.match(name[0])) and not (end < len(text) and word.match(text[end]) and word.match(name[-1]))
            if inside:
                out, at, n = out + names[name], end, n + 1
                break
        else:
            out, at = out + text[at], at + 1
    return out, n


@pytest.mark.parametrize("most", [100, 1])
def test_redaction_against_one_name_at_a_time(spark, most):
    draw = random.Random(most)
    names = [("Ann", "[A]"), ("ann  lee", "[AL]"), ("Ann Lee Ray", "[ALR]"), ("Lee", "[L]"), ("lee", "[K]"), ("Zoë", "[Z]"), ("o'neil", "[O]"), ("J. R.", "[J]"), (None, "[X]"), (" ", "[X]"), ("!!", "[X]")]
    pool = ["Ann", "ann", "Lee", "Ray", "LEE", "Zoë", "zoë", "O'Neil", "J. R.", "Annie", "x", "_Lee", "İ", "!!", ",", "9"]
    texts = ["".join(draw.choice(pool) + draw.choice([" ", "", ".", " "]) for _ in range(draw.randrange(12))) for _ in range(150)] + ["", None, "Ann Lee " * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id bigint, text string").selectExpr("*", "named_struct('a b', 1) as `x``y`", "1 as label").repartition(3)
    got = redaction.redacted_turns(df, spark.createDataFrame(names, "name string, label string"), most=most)
    labels = {"ann": "[A]", "ann lee": "[AL]", "ann lee ray": "[ALR]", "lee": "[K]", "zoë": "[Z]", "o'neil": "[O]", "j. r.": "[J]"}
    rows = {r.id: (r.redacted, r.n_names) for r in got.collect()}
    assert got.columns == [*df.columns, "redacted", "n_names"] and len(rows) == len(texts)
    for k, t in enumerate(texts):
        want = (None, 0) if t is None else ("[AL] " * 20_000, 20_000) if len(t) > 10_000 else replaced(t, labels)
        assert rows[k] == want, t
    assert redaction.redacted_turns(df.limit(0), spark.createDataFrame(names, "name string, label string"), most=most).count() == 0


def test_monthly_trend(spark):
    draw = random.Random(5)
    rows = []
    for g in ["up", "flat", "few", None]:
        for k in range(9 if g == "few" else 60):
            m = draw.randrange(14)
            rows.append((g, f"20{20 + m // 12}-{m % 12 + 1:02d}-03", None if k == 5 else round(m * (0.3 if g == "up" else 0) + draw.randrange(10) / 10, 1)))
    df = spark.createDataFrame([*rows, ("up", None, 3.0), ("one", "2020-01-01", 1.0)], "g string, date string, score double").withColumn("date", F.col("date").cast("date"))
    out = {r.g: r for r in inference.monthly_trend(df, ["g"]).collect()}
    assert out["few"].trend is None and out["one"].slope is None and out["one"].months == 1
    for g in ("up", "flat", None):
        by = {}
        for h, date, s in rows:
            if h == g and s is not None:
                by.setdefault(int(date[:4]) * 12 + int(date[5:7]), []).append(s)
        x = {m: round(sum(v) / len(v), 6) for m, v in by.items()}
        pairs = list(itertools.combinations(sorted(x), 2))
        s = sum((x[b] > x[a]) - (x[b] < x[a]) for a, b in pairs)
        assert out[g].s == s and abs(out[g].slope - statistics.median((x[b] - x[a]) / (b - a) for a, b in pairs)) < 2e-6
        n, t = len(x), [list(x.values()).count(v) for v in set(x.values())]
        z = (s - (s > 0) + (s < 0)) / math.sqrt((n * (n - 1) * (2 * n + 5) - sum(c * (c - 1) * (2 * c + 5) for c in t)) / 18)
        assert abs(out[g].z - z) < 1e-5 and abs(out[g].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-6
    assert out["up"].trend == "improving"
    assert inference.monthly_trend(df.limit(0), ["g"]).count() == 0


def test_finding_lift(spark):
    draw = random.Random(8)
    calls = [(k, draw.choice(["x", None]), draw.random() < 0.5 if k % 20 else None) for k in range(800)]
    found = [(k, f"f{j}") for k, _, won in calls for j in range(8) if draw.random() < (0.5 if j > 2 else 0.8 if won else 0.3)] + [(99999, "f1"), (0, None)]
    c = spark.createDataFrame(calls, "call_id bigint, task_type string, won boolean")
    f = spark.createDataFrame(found + found[:50], "call_id bigint, finding string")
    rows = inference.finding_lift(c, f).collect()
    for g in ("x", None):
        mine = sorted((r for r in rows if r.task_type is g or r.task_type == g), key=lambda r: r["rank"])
        won = {k: w for k, t, w in calls if t == g and w is not None}
        for r in mine:
            have = {k for k, name in found if name == r.finding and k in won}
            assert (r.won_with, r.lost_with) == (sum(won[k] for k in have), sum(not won[k] for k in have))
            assert r.won_with + r.lost_with + r.won_without + r.lost_without == len(won)
        last = max([k for k, r in enumerate(mine, 1) if r.p <= k * 0.05 / len(mine)], default=0)
        assert [r.kept for r in mine] == [k <= last for k in range(1, len(mine) + 1)] and last >= 3
        assert {r.finding for r in mine if r.side == "works"} >= {"f0", "f1", "f2"} and [r.p for r in mine] == sorted(r.p for r in mine)
    assert inference.finding_lift(c, f.limit(0)).count() == 0


def test_judges(spark):
    draw = random.Random(3)
    rows = [(u, j, round(draw.random() * 3 + u % 7, 1)) for u in range(30) for j in range(draw.randrange(4))] + [(99, 1, None), (99, 2, 5.0)]
    df = spark.createDataFrame(rows, "unit bigint, judge bigint, score double")
    got = inference.judge_agreement(df).first()
    units = {}
    for u, _, s in rows:
        if s is not None:
            units.setdefault(u, []).append(s)
    units = {u: v for u, v in units.items() if len(v) > 1}
    every = [s for v in units.values() for s in v]
    n = len(every)
    seen = sum(sum((a - b) ** 2 for a in v for b in v) / (len(v) - 1) for v in units.values()) / n
    expected = sum((a - b) ** 2 for a in every for b in every) / (n * (n - 1))
    assert (got.units, got.ratings) == (len(units), n) and abs(got.alpha - (1 - seen / expected)) < 2e-6
    same = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0)], df.schema)
    assert inference.judge_agreement(same).first().alpha == 1.0
    r = [(u, j, m, s + draw.random() * 2) for u in range(20) for j in range(3) for m, s in (("a", 0), ("b", 1), ("c", 2), ("d", 2))] + [(1, 1, "a", None), (50, 1, "lone", 1.0)]
    strengths = {x.model: x for x in inference.judge_strengths(spark.createDataFrame(r, "unit bigint, judge bigint, model string, score double")).collect()}
    assert strengths["a"].strength < strengths["b"].strength < min(strengths["c"].strength, strengths["d"].strength) and strengths["lone"].games == 0
    wins = sum(1 for u in range(20) for j in range(3) for x, y in itertools.permutations([q for q in r[:240] if q[0] == u and q[1] == j], 2) if x[2] == "a" and x[3] > y[3])
    assert strengths["a"].wins == wins and strengths["a"].games == 180
    assert inference.judge_strengths(spark.createDataFrame([], "unit bigint, judge bigint, model string, score double")).count() == 0
