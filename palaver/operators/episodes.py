"""Episodes of analysed calls and what is learned from them: playbooks, product-fit dashboards, call preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import ordering

#: Words that mark a finding as something that fails.
FAILS = ["risk", "missing", "weak", "gap", "concern", "anti"]


def build_episodes(calls: DataFrame) -> DataFrame:
    """Scores and findings of analysed calls.

    Needs n_actions, n_decisions, n_buying, n_risk, n_pains, n_commitments, methodology_total, methodology_max,
    framework_score (null where absent), total_speakers and speaking_balance (null without metrics).
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = [
        ("methodology", F.when(F.col("methodology_total").isNotNull(), F.coalesce(F.round(F.try_divide(F.col("methodology_total") * 10, "methodology_max"), 1), F.lit(0.0)))),
        ("buying_signals", F.when(n("n_buying") > 0, F.least(n("n_buying") * 2.5, F.lit(10.0)))),
        ("risk_signals", F.when(n("n_risk") > 0, F.greatest(10.0 - n("n_risk") * 2.5, F.lit(0.0)))),
        ("framework", F.col("framework_score").cast("double")),
        ("speaking_balance", F.round(F.col("speaking_balance") * 10, 1)),
    ]
    scores = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in parts]), lambda e: e["value"].isNotNull())
    counted = lambda c, what: F.when(n(c) > 0, F.format_string(f"%d {what}", n(c)))
    findings = F.array_compact(
        F.array(
            counted("n_actions", "action items extracted"),
            counted("n_decisions", "key decisions identified"),
            F.when(F.col("methodology_total").isNotNull(), F.concat(F.lit("Methodology score: "), F.col("methodology_total").cast("string"), F.lit("/"), F.col("methodology_max").cast("string"))),
            counted("n_buying", "buying signals detected"),
            counted("n_risk", "risk signals detected"),
            counted("n_pains", "pain points identified"),
            counted("n_commitments", "commitment signals detected"),
            F.when(F.col("speaking_balance").isNotNull(), F.concat(F.col("total_speakers").cast("string"), F.lit(" speakers, balance: "), F.col("speaking_balance").cast("string"))),
        )
    )
    out = calls.withColumn("_s", scores).withColumn("findings", findings)
    overall = F.when(F.size("_s") > 0, F.round(F.aggregate("_s", F.lit(0.0), lambda a, e: a + e["value"]) / F.size("_s"), 1))
    return out.withColumn("overall", overall).withColumn("scores", F.map_from_entries(F.when(F.col("overall").isNull(), F.col("_s")).otherwise(F.array_append("_s", F.struct(F.lit("overall").alias("key"), F.col("overall").alias("value")))))).drop("_s")


def benchmarks(episodes: DataFrame) -> DataFrame:
    """Per task type and score: average, least, most and number."""
    rows = episodes.select("task_type", F.explode("scores").alias("key", "value"))
    return rows.groupBy("task_type", "key").agg(F.round(F.avg("value"), 2).alias("avg"), F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"), F.count("value").alias("n"))


def finding_counts(findings: DataFrame, most: int, within: list[str] = ("task_type",)) -> DataFrame:
    """The most frequent findings (finding, pos) of each group; ties by first appearance; whether each works or fails."""
    counts = findings.groupBy(*within, "finding").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(*within).orderBy(F.col("n").desc(), "first_pos")
    low = F.lower("finding")
    fails = F.lit(False)
    for x in FAILS:
        fails = fails | F.contains(low, F.lit(x))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("side", F.when(fails, "fails").otherwise("works")).drop("first_pos")


def ellis_class(finding: str) -> Column:
    low = F.lower(finding)
    has = lambda a: F.contains(low, F.lit(a)) | F.contains(low, F.lit(a.replace(" ", "_")))
    return F.when(has("very disappointed"), "very_disappointed").when(has("somewhat disappointed"), "somewhat_disappointed").when(has("not disappointed"), "not_disappointed")


def ellis_distribution(findings: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Counts and shares of the three answers, and whether the first reaches its target."""
    kinds = findings.select(ellis_class("finding").alias("answer")).where("answer is not null").groupBy("answer").agg(F.count("*").alias("n"))
    # at most three rows are left, so one window over them is cheap
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return kinds.select("answer", "n", share.cast("int").alias("pct"), ((F.col("answer") == "very_disappointed") & (share >= threshold * 100)).alias("on_target"))


def tenths(mean: Column) -> Column:
    """A mean rounded to tenths as SQL does: ten times the double, its half away from zero.

    ``round(x, 1)`` looks at the shortest decimal of x instead, and takes 6.6499999999999995, whose tenfold is 66.5, for 6.6.
    """
    return F.round(mean * 10) / 10


def _halves(first: Column) -> list[Column]:
    return [F.count("*").alias("n"), tenths(F.avg("score")).alias("average"), tenths(F.avg(F.when(first, F.col("score")))).alias("first_half"), tenths(F.avg(F.when(~first, F.col("score")))).alias("second_half")]


def _trend(out: DataFrame) -> DataFrame:
    trend = F.when(F.col("second_half") > F.col("first_half"), "improving").when(F.col("second_half") < F.col("first_half"), "declining").otherwise("stable")
    return out.withColumn("trend", F.when(F.col("n") >= 4, trend))


def half_trend(scores: DataFrame, within: list[str], order: list) -> DataFrame:
    """From four scores on: the mean of the first half against the rest."""
    w = Window.partitionBy(*within)
    rows = scores.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return _trend(rows.groupBy(*within).agg(*_halves(F.col("_r") <= F.floor(F.col("_n") / 2))))


def overall_trend(scores: DataFrame, order: list) -> DataFrame:
    """:func:`half_trend` of all scores as one row: places come from one order cut into ranges, sums are partial."""
    placed = ordering.numbered(scores, order, "_r")
    rows = placed.join(F.broadcast(placed.agg(F.count("*").alias("_n"))), how="cross")  # one row
    return _trend(rows.agg(*_halves(F.col("_r") <= F.floor(F.col("_n") / 2))).where("n > 0"))


def top_findings(findings: DataFrame, most: int) -> DataFrame:
    """The most frequent findings (finding, pos) of all, ties by first appearance: (finding, n, first_pos)."""
    return findings.groupBy("finding").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).orderBy(F.col("n").desc(), "first_pos").limit(most)


def recent(episodes: DataFrame, within: list[str], order: list, most: int = 10) -> DataFrame:
    """The last episodes of each group, the newest first."""
    w = Window.partitionBy(*within).orderBy(*order)
    return episodes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def dead_ends(rows: DataFrame, call_type: str, most: int = 10, order: str = "pos") -> DataFrame:
    """Patterns recorded for a call type, the first ``most``."""
    return rows.where((F.col("task_type") == call_type) | (F.col("call_type") == call_type)).orderBy(order).limit(most).select(F.coalesce("pattern", "finding").alias("pattern"))


def prep_notes(recent_findings: DataFrame, within: list[str], most: int = 5) -> DataFrame:
    """The first different findings (finding, pos) of each group."""
    firsts = recent_findings.groupBy(*within, "finding").agg(F.min("pos").alias("pos"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy("pos"))).where(F.col("place") <= most)


def playbook_markdown(bench: DataFrame, patterns: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per task type a Markdown playbook: patterns that work, patterns that fail, benchmarks."""
    line = F.struct("place", F.format_string("- %s *(seen %dx)*", F.col("finding"), F.col("n")).alias("line"))
    listed = patterns.groupBy("task_type").agg(F.sort_array(F.collect_list(F.when(F.col("side") == "works", line))).alias("works"), F.sort_array(F.collect_list(F.when(F.col("side") == "fails", line))).alias("fails"))
    rows = bench.groupBy("task_type").agg(F.sort_array(F.collect_list(F.format_string("| %s | %s | %s | %s | %d |", F.col("key"), F.col("avg").cast("string"), F.col("min").cast("string"), F.col("max").cast("string"), F.col("n")))).alias("bench"))
    counts = episodes.groupBy("task_type").agg(F.count("*").alias("calls"))
    text = lambda c: F.array_join(F.transform(c, lambda r: r["line"]), "\n")
    return counts.join(listed, "task_type", "left").join(rows, "task_type", "left").select(
        "task_type",
        F.concat_ws("\n", F.concat(F.lit("# "), F.initcap(F.replace("task_type", F.lit("-"), F.lit(" "))), F.lit(" Playbook\n")), F.format_string("*From %d calls*\n", "calls"), F.lit("## What works\n"), text("works"), F.lit("\n## What fails\n"), text("fails"), F.lit("\n## Benchmarks\n\n| score | avg | min | max | n |\n|-|-|-|-|-|"), F.array_join("bench", "\n")).alias("markdown"),
    )


def prep_markdown(task_types: DataFrame, notes: DataFrame, recent_rows: DataFrame, playbooks: DataFrame, budget_words: int = 2000) -> DataFrame:
    """Per task type a page to prepare a call: notes, recent scores, and the playbook cut to half the budget of words."""
    n = notes.groupBy("task_type").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("finding")).alias("line")))).alias("n"))
    r = recent_rows.groupBy("task_type").agg(F.sort_array(F.collect_list(F.struct("place", F.format_string("- %s: %s", F.col("timestamp").cast("string"), F.coalesce(F.col("score").cast("string"), F.lit("-"))).alias("line")))).alias("r"))
    lines = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["line"]), "\n")
    book = T.truncate_words(F.coalesce("markdown", F.lit("")), budget_words // 2)
    out = task_types.join(n, "task_type", "left").join(r, "task_type", "left").join(playbooks, "task_type", "left")
    return out.select("task_type", F.concat_ws("\n", F.concat(F.lit("# Preparation: "), F.col("task_type")), F.lit("\n## Notes\n"), lines(F.col("n")), F.lit("\n## Recent\n"), lines(F.col("r")), F.lit("\n## Playbook\n"), book).alias("markdown"))
