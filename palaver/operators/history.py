"""Model evaluations: aggregates of results, comparison of runs, trends and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.usage import dollars


def tier(quality: Column) -> Column:
    return F.when(quality >= 7.5, 1).when(quality >= 5, 2).when(quality > 0, 3).otherwise(0)


def model_aggregates(results: DataFrame) -> DataFrame:
    """Per model: success rate, means over results without an error, totals over all, quality per dollar, tier.

    Results may have accuracy_f1, grounding_rate and hallucinated_count; missing columns count as 0.
    """
    ok = F.col("error").isNull()
    for c in ("accuracy_f1", "grounding_rate", "hallucinated_count"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(0))
    mean = lambda c, digits: F.coalesce(F.round(F.avg(F.when(ok, F.col(c))), digits), F.lit(0.0))
    out = results.groupBy("model").agg(
        F.count("*").alias("runs"),
        F.avg(ok.cast("double")).alias("success_rate"),
        mean("quality", 2).alias("avg_quality"),
        mean("latency_ms", 0).cast("bigint").alias("avg_latency_ms"),
        mean("accuracy_f1", 3).alias("avg_accuracy_f1"),
        mean("grounding_rate", 3).alias("avg_grounding_rate"),
        F.sum("hallucinated_count").cast("bigint").alias("total_hallucinated"),
        dollars("cost_usd").alias("total_cost_usd"),
    )
    return out.withColumn("quality_cost_ratio", F.when(F.col("total_cost_usd") > 0, F.round(F.try_divide("avg_quality", "total_cost_usd"), 1)).otherwise(0.0)).withColumn("tier", tier(F.col("avg_quality")))


def compare_runs(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per model of two runs (model, avg_quality, avg_latency_ms, tier): changes and status.

    One full outer join finds added and removed models; latencies and tiers that a run lacks count as 0.
    """

    def side(run: DataFrame, name: str) -> DataFrame:
        number = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in run.columns else F.lit(0)
        return run.select("model", F.col("avg_quality").alias(f"quality_{name}"), number("avg_latency_ms").cast("bigint").alias(f"latency_{name}_ms"), number("tier").cast("int").alias(f"tier_{name}"), F.lit(True).alias(f"_{name}"))

    delta = F.round(F.col("quality_after") - F.col("quality_before"), 2)
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(delta > threshold, "improved").when(delta < -threshold, "regressed").otherwise("stable")
    return side(before, "before").join(side(after, "after"), "model", "full_outer").select(
        "model", "quality_before", "quality_after", delta.alias("delta"),
        "latency_before_ms", "latency_after_ms", (F.col("latency_after_ms") - F.col("latency_before_ms")).alias("latency_delta_ms"),
        "tier_before", "tier_after", (F.col("tier_after") - F.col("tier_before")).alias("tier_change"), status.alias("status"),
    )


def comparison_counts(compared: DataFrame) -> DataFrame:
    """One row: how many models were compared, and how many have each status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return compared.agg(n("improved", "regressed", "stable").alias("models_compared"), *[n(s).alias(s) for s in ("improved", "regressed", "stable", "added", "removed")])


def model_stats(points: DataFrame, order: str) -> DataFrame:
    """Per model over runs: mean, sample deviation (0 of one run), least, most and number of qualities and of latencies above 0; last tier."""

    def stats(name: str, value: Column) -> list[Column]:
        return [F.coalesce(F.round(f, 2), F.lit(0.0)).alias(f"{what}_{name}") for what, f in (("mean", F.avg(value)), ("stddev", F.stddev_samp(value)), ("min", F.min(value).cast("double")), ("max", F.max(value).cast("double")))] + [F.count(value).alias(f"n_{name}")]

    last = F.max_by("tier", order) if "tier" in points.columns else tier(F.max_by("quality", order))
    return points.groupBy("model").agg(F.count("*").alias("runs"), *stats("quality", F.col("quality")), *stats("latency", F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), last.alias("current_tier"))


def model_trend(points: DataFrame, order: list[str], threshold: float = 0.5) -> DataFrame:
    """Every point of every model with its place, and the label of the model's change from first to last."""
    key = F.struct(*order)
    ends = points.groupBy("model").agg(F.min_by("quality", key).alias("first_quality"), F.max_by("quality", key).alias("last_quality"), F.count("*").alias("n_runs"))
    change = F.col("last_quality") - F.col("first_quality")
    label = F.when(change > threshold, "improving").when(change < -threshold, "declining").otherwise("stable")
    place = F.row_number().over(Window.partitionBy("model").orderBy(*order))
    return points.withColumn("place", place).join(ends.withColumn("trend", label), "model")


def rank_models(models: DataFrame, by: list, within: list[str], most: int) -> DataFrame:
    """The best rows of each group, by ranks."""
    w = Window.partitionBy(*within).orderBy(*by)
    return models.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def catalog_order(catalog: DataFrame, owners: dict[str, int], most: int) -> DataFrame:
    """Models to try first: by tier (4 if unknown), the owner's priority (99 if unknown) and id."""
    place = F.coalesce(F.element_at(F.create_map(*[x for k, v in owners.items() for x in (F.lit(k), F.lit(v))]), F.col("owned_by")), F.lit(99)) if owners else F.lit(99)
    return catalog.withColumn("priority", place).orderBy(F.coalesce("tier_hint", F.lit(4)), "priority", "id").limit(most)


def suitable(catalog: DataFrame, excluded: list[str]) -> DataFrame:
    """The catalog with a flag for chat models: no excluded substring in the id."""
    out = F.lit(True)
    for x in excluded:
        out = out & ~F.contains(F.lower("id"), F.lit(x))
    return catalog.withColumn("suitable_for_analysis", out)


def by_owner(catalog: DataFrame) -> DataFrame:
    owner = F.when(F.coalesce("owned_by", F.lit("")) == "", "unknown").otherwise(F.col("owned_by")).alias("owner")
    return catalog.groupBy(owner).agg(F.count("*").alias("n_models"), F.sort_array(F.collect_set("id")).alias("ids"))


def _listed(df: DataFrame, head: str, order: list[Column], line: Column, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """One row: a Markdown table of the few rows of ``df`` in order."""
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], line.alias("line")))), lambda r: r["line"]), "\n")
    parts = [x for x in (before, F.lit(head), rows, after) if x is not None]
    return df.agg(F.concat_ws("\n", *parts).alias("markdown"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def comparison_markdown(compared: DataFrame) -> DataFrame:
    """One row: counts and a Markdown table of :func:`compare_runs` by falling change, then added and removed models (runs hold few models)."""
    both = F.col("status").isin("improved", "regressed", "stable")
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    head = F.concat(F.lit("# Comparison\n\nModels compared: "), F.count_if(both).cast("string"), F.lit(" | improved: "), n("improved"), F.lit(" | regressed: "), n("regressed"), F.lit(" | stable: "), n("stable"), F.lit("\n"))
    signed = F.concat(F.when(F.col("delta") > 0, "+").otherwise(""), _text("delta"))
    tiers = F.when(F.col("tier_change") != 0, F.concat(_text("tier_before"), F.lit("→"), _text("tier_after"))).otherwise(_text("tier_after"))
    row = F.when(both, F.concat(F.lit("| "), F.concat_ws(" | ", "model", F.concat(_text("quality_after"), F.lit("/10")), signed, F.concat(_text("latency_after_ms"), F.lit("ms")), tiers, "status"), F.lit(" |")))
    lines = F.array_join(F.transform(F.sort_array(F.filter(F.collect_list(F.struct((-F.col("delta")).alias("k"), F.col("model").alias("m"), row.alias("line"))), lambda r: r["line"].isNotNull())), lambda r: r["line"]), "\n")
    names = lambda s, title: F.concat(F.lit(f"\n{title}: "), F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("model")))), ", "), F.lit("")))
    return compared.agg(F.concat_ws("\n", head, F.lit("| Model | Quality | Delta | Latency | Tier | Status |\n|-|-|-|-|-|-|"), lines, names("added", "New models"), names("removed", "Removed models")).alias("markdown"))


def ranking_markdown(models: DataFrame) -> DataFrame:
    """One row: a Markdown table of model aggregates by tier (unranked last) and falling quality."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "model", F.concat(_text("avg_quality"), F.lit("/10")), _text("tier"), _text("avg_accuracy_f1"), _text("avg_grounding_rate"), _text("total_hallucinated"), F.concat(_text("avg_latency_ms"), F.lit("ms")), _text("total_cost_usd"), _text("quality_cost_ratio")), F.lit(" |"))
    return _listed(models, "| Model | Quality | Tier | Accuracy | Grounding | Hallucinated | Latency | Cost | Quality per $ |\n|-|-|-|-|-|-|-|-|-|", [F.when(F.col("tier") == 0, 4).otherwise(F.col("tier")), -F.col("avg_quality"), F.col("model")], line, F.concat(F.lit("# Models\n\n*"), F.count("*").cast("string"), F.lit(" models tested*\n")))


def history_markdown(runs: DataFrame) -> DataFrame:
    """One row: a Markdown table of runs (file_name, timestamp, models_tested, top_model, top_quality), the newest first."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.left("timestamp", F.lit(19)), _text("models_tested"), _text("top_model"), F.concat(_text("top_quality"), F.lit("/10"))), F.lit(" |"))
    ordered = runs.withColumn("_back", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("file_name").desc())))  # a handful of runs
    return _listed(ordered, "| Date | Models | Top model | Best quality |\n|-|-|-|-|", [F.col("_back")], line, F.concat(F.lit("# History\n\n*"), F.count("*").cast("string"), F.lit(" runs on record*\n")))


def trend_markdown(trend: DataFrame) -> DataFrame:
    """Per model a Markdown page: its points in order and its trend, from :func:`model_trend`."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_text(c) for c in ("place", "quality", "latency_ms")]), F.lit(" |"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"]), "\n")
    end = F.concat(F.lit("\n**Trend:** "), F.first("trend"), F.lit(" ("), F.first("first_quality").cast("string"), F.lit(" → "), F.first("last_quality").cast("string"), F.lit(")"))
    return trend.groupBy("model").agg(F.concat_ws("\n", F.concat(F.lit("# Trend: "), F.col("model"), F.lit("\n")), F.lit("| # | Quality | Latency |\n|-|-|-|"), rows, F.when(F.first("n_runs") >= 2, end)).alias("markdown"))
