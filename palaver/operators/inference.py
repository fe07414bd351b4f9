"""Trends with tests, findings that go with an outcome, and panels of judges: sums per group, then closed forms.

Whatever is summed is rounded to six places first and summed as decimals, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import ordering

#: Months of a group, at most: pairs of months are listed. 100 years.
MOST_MONTHS = 1200
#: Models of a panel, at most: wins are a table of pairs of models.
MOST_MODELS = 1000


def two_sided(z: Column) -> Column:
    """The share of a normal distribution beyond -|z| and |z|, to seven places (Abramowitz and Stegun, 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    # Coefficients of the formula
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return F.round(F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(0.0)), 7)


def monthly_trend(scores: DataFrame, within: list[str], least: int = 10, level: float = 0.05) -> DataFrame:
    """Per group of (within..., date, score): calls, months, Mann-Kendall's S, z and p, the Theil-Sen slope a month, and the trend.

    What is tested are the months' means.  S counts the pairs of months that rise less those that fall; its variance takes ties into
    account; the slope is the median of all pairs' slopes, by counts of equal slopes, the mean of the two middle ones of an even number.
    Calls are averaged before months are paired, so what is paired are a group's months, of which more than ``MOST_MONTHS`` are refused.

    Cases: null dates and scores are no calls; groups of fewer than ``least`` calls, or of one month, have neither test nor trend
    (null); months without calls are no points, but time goes on in them; a test without variance has z 0 and p 1.
    """
    month = F.year("date") * 12 + F.month("date")
    per = scores.where("date is not null and score is not null").groupBy(*within, month.alias("_m")).agg(F.count("*").alias("_n"), F.sum(F.col("score").cast("decimal(20,6)")).alias("_s"))
    means = per.select(*within, "_m", "_n", F.round(F.col("_s").cast("double") / F.col("_n"), 6).alias("_x"))
    sizes = means.groupBy(*within).agg(F.sum("_n").alias("calls"), F.count("*").alias("months"))
    sizes = sizes.withColumn("months", F.when(F.col("months") > MOST_MONTHS, F.raise_error(F.lit(f"more than {MOST_MONTHS} months")).cast("bigint")).otherwise(F.col("months")))
    groups = [f"_g{k}" for k in range(len(within))]
    later = means.select(*[F.col(g).alias(h) for g, h in zip(within, groups, strict=True)], F.col("_m").alias("_m2"), F.col("_x").alias("_x2"))
    same = [F.col(g).eqNullSafe(F.col(h)) for g, h in zip(within, groups, strict=True)]
    pairs = means.join(later, [*same, F.col("_m") < F.col("_m2")]).select(*within, F.signum(F.col("_x2") - F.col("_x")).cast("bigint").alias("_sign"), F.round((F.col("_x2") - F.col("_x")) / (F.col("_m2") - F.col("_m")), 6).alias("_slope"))
    slopes = pairs.groupBy(*within, "_slope").agg(F.count("*").alias("_k"), F.sum("_sign").alias("_sign"))
    w = Window.partitionBy(*within)
    ranked = slopes.withColumn("_upto", F.sum("_k").over(w.orderBy("_slope").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_k").over(w))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col("_slope")))
    middle = ranked.groupBy(*within).agg(F.sum("_sign").alias("s"), at(F.floor((F.col("_all") + 1) / 2)).alias("_low"), at(F.floor(F.col("_all") / 2) + 1).alias("_high"))
    ties = means.groupBy(*within, "_x").agg(F.count("*").alias("_t")).groupBy(*within).agg(F.sum(F.col("_t") * (F.col("_t") - 1) * (2 * F.col("_t") + 5)).alias("_ties"))
    named = lambda df, tag: df.select(*[F.col(g).alias(f"_{tag}{k}") for k, g in enumerate(within)], *[c for c in df.columns if c not in within])
    on = lambda tag: [F.col(g).eqNullSafe(F.col(f"_{tag}{k}")) for k, g in enumerate(within)]
    out = sizes.join(named(middle, "a"), on("a"), "left").join(named(ties, "b"), on("b"), "left")
    tested = (F.col("calls") >= least) & (F.col("months") >= 2)
    n, s = F.col("months"), F.col("s")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18
    z = F.round(F.when((s == 0) | (variance <= 0), 0.0).otherwise((s - F.signum(s)) / F.sqrt(variance)), 6)
    out = out.withColumn("z", F.when(tested, z)).withColumn("p", F.when(tested, two_sided(F.col("z")))).withColumn("slope", F.when(tested, F.round((F.col("_low") + F.col("_high")) / 2, 6)))
    trend = F.when((F.col("p") < level) & (F.col("z") > 0), "improving").when((F.col("p") < level) & (F.col("z") < 0), "declining").otherwise("stable")
    return out.select(*within, "calls", "months", F.when(tested, s).alias("s"), "z", "p", "slope", F.when(tested, trend).alias("trend"))


def finding_lift(calls: DataFrame, findings: DataFrame, within: str = "task_type", least: int = 10, level: float = 0.05) -> DataFrame:
    """Which findings go with success: per group and finding the 2x2 table with the outcome, log-odds, z, p, rank of p, and whether it is kept.

    calls: (call_id, within, won boolean); findings: (call_id, finding).  Half a call is added to each of the four cells, which shrinks the
    log-odds of rare findings; findings of fewer than ``least`` calls are not tested.  Of a group's tests those are kept whose p the rule
    of Benjamini and Hochberg admits: all up to the last rank k with p <= k / tests * ``level``.  ``side`` tells whether a kept
    finding works or fails.

    A group's tests may be many: ranks come from one order cut into ranges, and the last rank admitted is a maximum.

    Cases: a call without an outcome takes no part; a finding that a call has twice counts once; findings of unknown calls count
    nowhere; null groups are a group; ties of p go to the greater |log-odds|, then to the finding.
    """
    known = calls.where("won is not null").select("call_id", F.col(within).alias("_w"), F.col("won").cast("int").alias("won"))
    group = known.groupBy("_w").agg(F.sum("won").cast("bigint").alias("_won"), F.count("*").alias("_all"))
    once = findings.where("finding is not null").select("call_id", "finding").distinct()
    have = once.join(known, "call_id").groupBy("_w", "finding").agg(F.sum("won").cast("bigint").alias("won_with"), F.count("*").alias("_with")).where(F.col("_with") >= least)
    g = group.select(F.col("_w").alias("_v"), "_won", "_all")
    t = have.join(g, F.col("_w").eqNullSafe(F.col("_v"))).drop("_v")
    t = t.withColumn("lost_with", F.col("_with") - F.col("won_with")).withColumn("won_without", F.col("_won") - F.col("won_with")).withColumn("lost_without", F.col("_all") - F.col("_won") - F.col("lost_with"))
    cells = [F.col(c) + 0.5 for c in ("won_with", "lost_with", "won_without", "lost_without")]
    odds = F.round(F.log(cells[0] * cells[3] / (cells[1] * cells[2])), 6)
    z = F.round(odds / F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3]), 6)
    t = t.withColumn("log_odds", odds).withColumn("z", z).withColumn("p", two_sided(F.col("z")))
    ranked = ordering.numbered(t, [F.col("p").asc(), F.abs("log_odds").desc(), F.col("finding").asc()], "rank", ["_w"])
    tests = ranked.groupBy("_w").agg(F.count("*").alias("_tests"))
    x, y = ranked.alias("x"), tests.select(F.col("_w").alias("_v"), "_tests")
    joined = x.join(y, F.col("_w").eqNullSafe(F.col("_v"))).drop("_v")
    last = joined.where(F.col("p") <= F.col("rank") * F.lit(level) / F.col("_tests")).groupBy("_w").agg(F.max("rank").alias("_last")).select(F.col("_w").alias("_v"), "_last")
    kept = joined.join(last, F.col("_w").eqNullSafe(F.col("_v")), "left").withColumn("kept", F.col("rank") <= F.coalesce("_last", F.lit(0)))
    side = F.when(F.col("kept"), F.when(F.col("log_odds") > 0, "works").when(F.col("log_odds") < 0, "fails"))
    return kept.select(F.col("_w").alias(within), "finding", "won_with", "lost_with", "won_without", "lost_without", "log_odds", "z", "p", "rank", "kept", side.alias("side"))


def judge_agreement(ratings: DataFrame, within: list[str] = ()) -> DataFrame:
    """Krippendorff's alpha of judges' scores (interval scale): (within..., units, ratings, alpha).

    ratings: (unit, judge, score).  What judges disagree about is the sum over units of the squared differences of their pairs; all pairs
    of a unit, and all pairs of scores, come from counts, sums and sums of squares, so no pair is listed.

    Cases: null scores are no ratings; a unit with one rating is no unit; a judge who rates a unit twice counts twice; alpha is 1 where
    all scores are equal, null where no unit has two ratings.
    """
    x = F.round(F.col("score").cast("double") * 1000).cast("decimal(19,0)")
    per = ratings.where("score is not null").groupBy(*within, "unit").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
    apart = (F.col("m") * F.col("q") - F.col("s") * F.col("s")).cast("double") * 2 / (F.col("m") - 1)
    sums = per.groupBy(*within).agg(F.count("*").alias("units"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.round(apart, 3).cast("decimal(30,3)")).alias("apart"))
    n = F.col("n")
    seen = F.col("apart").cast("double") / n
    expected = (n * F.col("q").cast("double") - F.col("s").cast("double") * F.col("s").cast("double")) * 2 / (n * (n - 1))
    return sums.select(*within, "units", n.alias("ratings"), F.round(F.when(expected <= 0, 1.0).otherwise(1 - seen / expected), 6).alias("alpha"))


def judge_strengths(ratings: DataFrame, rounds: int = 20) -> DataFrame:
    """Bradley-Terry strengths of models: (model, wins, games, strength), the mean strength being 1.

    ratings: (unit, judge, model, score).  Each judge's scores of a unit are compared; a tie is half a win for both.  What is iterated is the
    table of pairs of models, of which there are at most ``MOST_MODELS`` (more are refused): strength = (wins + 1/2) / sum over opponents
    of games / (strength + opponent's strength), with one drawn game against a model of strength 1 that keeps unbeaten models finite.

    How often a model beats another comes from counts per score: pairs of single ratings are never listed unless two different models
    are in one unit, judge for judge.

    Cases: null scores are no ratings; a model without opponents has its prior only; ties in all games give equal strengths.
    """
    rated = ratings.where("score is not null and model is not null").groupBy("unit", "judge", "model").agg(F.round(F.avg("score"), 6).alias("score"))
    models = rated.select("model").distinct()
    if models.count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    other = rated.select("unit", "judge", F.col("model").alias("rival"), F.col("score").alias("theirs"))
    games = rated.join(other, ["unit", "judge"]).where("model <> rival").groupBy("model", "rival").agg(F.count("*").alias("games"), F.sum(F.when(F.col("score") > F.col("theirs"), 1.0).when(F.col("score") == F.col("theirs"), 0.5).otherwise(0.0)).alias("wins")).collect()
    names = sorted(r.model for r in models.collect())
    strength = dict.fromkeys(names, 1.0)
    against: dict = {m: [] for m in names}
    wins, played = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0)
    for r in sorted(games, key=lambda r: (r.model, r.rival)):
        against[r.model].append((r.rival, r.games))
        wins[r.model] += r.wins
        played[r.model] += r.games
    for _ in range(rounds):
        now = {m: (wins[m] + 0.5) / (sum(g / (strength[m] + strength[o]) for o, g in against[m]) + 1 / (strength[m] + 1)) for m in names}
        mean = sum(now.values()) / len(now) if now else 1.0
        strength = {m: s / mean for m, s in now.items()}
    rows = [(m, wins[m], played[m], round(strength[m], 6)) for m in names]
    return ratings.sparkSession.createDataFrame(rows, ratings.select("model").withColumns({"wins": F.lit(0.0), "games": F.lit(0).cast("bigint"), "strength": F.lit(0.0)}).schema)
