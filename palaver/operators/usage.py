"""Token usage and cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators import ordering


def in_days(usage: DataFrame, days: int, now: Column) -> DataFrame:
    """Entries of at most ``days`` whole days before ``now``."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("timestamp").cast("timestamp"))) / 86400)
    return usage.where(age <= days)


def in_month(usage: DataFrame, month: str) -> DataFrame:
    """Entries whose timestamp begins with YYYY-MM."""
    return usage.where(F.startswith(F.col("timestamp").cast("string"), F.lit(month)))


#: Dollars per million tokens read and written, for models without a price.
DEFAULT_PRICE = (3.0, 15.0)


def dollars(c: str):
    """Exact sum of money of six decimals, whatever the order of the rows."""
    return F.round(F.sum(F.col(c).cast("decimal(28,6)")).cast("double"), 6)


def priced(usage: DataFrame, prices: DataFrame, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Entries with their cost from (model, price_in, price_out) per million tokens, exact and rounded to six decimals.

    A price list has a row for each model, so it is broadcast: entries of a model, which may be most of all, stay where they are.
    """
    at = [F.coalesce(F.col(c), F.lit(d)) for c, d in zip(("price_in", "price_out"), default, strict=True)]
    cost = F.col("input_tokens") * at[0] / 1e6 + F.col("output_tokens") * at[1] / 1e6
    return usage.join(F.broadcast(prices), "model", "left").withColumn("exact_cost", F.coalesce(cost, F.lit(0.0))).withColumn("cost_usd", F.round("exact_cost", 6)).drop("price_in", "price_out")


def over_budget(usage: DataFrame, limit: float, session: str, order: list) -> DataFrame:
    """Running cost per session, of unrounded costs where they are known, and whether it is above the limit."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = "exact_cost" if "exact_cost" in usage.columns else "cost_usd"
    return usage.withColumn("running_cost", F.sum(cost).over(w)).withColumn("over_budget", F.col("running_cost") > limit)


def admit(calls: DataFrame, limit: float, order: list, cost: str = "cost_usd", within: list[str] = ()) -> DataFrame:
    """Calls of a whole log with ``running_cost``, the exact cost up to and with each, and whether it is ``admitted``.

    A call is made while the calls before it have not cost more than the limit, so the one that crosses it is the last.  The order
    is cut into ranges with carried sums (``ordering.running``): no task sees the whole log.  With ``within`` each group
    (a month, a session) has a budget of its own, and a group of any size is split all the same.

    Cases: a null cost is 0; costs count in millionths, rounded; a limit below 0 admits nothing; ties in the order are taken in
    any order, so an order ends with a key.
    """
    exact = F.coalesce(F.col(cost), F.lit(0)).cast("decimal(20,6)")
    summed = ordering.running(calls, order, {"running_cost": exact}, within)
    return summed.withColumn("admitted", F.col("running_cost") - exact <= F.lit(limit).cast("decimal(20,6)"))


def totals(usage: DataFrame, budget: float | None = None, order: str | None = None) -> DataFrame:
    """One row: calls, tokens, cost; with a budget what is left of it; with an order the first and last entry's time."""
    ends = [] if order is None else [F.min_by("timestamp", order).alias("first_entry"), F.max_by("timestamp", order).alias("last_entry")]
    out = usage.agg(F.count("*").alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(dollars("cost_usd"), F.lit(0.0)).alias("cost_usd"), *ends)
    if budget is None:
        return out
    return out.withColumn("budget_used", F.round(F.col("cost_usd") / budget, 4)).withColumn("budget_remaining", F.round(F.lit(budget) - F.col("cost_usd"), 6)).withColumn("over_budget", F.col("cost_usd") > budget)


def by_model(usage: DataFrame, order: str) -> DataFrame:
    """Per model: calls, tokens, cost, first provider and latencies above 0; the median of an even number is the upper one.

    The exact median comes from counts per latency, so what is ranked are a model's different latencies, not its entries.
    """
    per = usage.where("latency_ms > 0").groupBy("model", "latency_ms").agg(F.count("*").alias("_k"))
    up = Window.partitionBy("model").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    rank = per.withColumn("_upto", F.sum("_k").over(up)).withColumn("_n", F.sum("_k").over(Window.partitionBy("model")))
    latency = rank.groupBy("model").agg(
        F.round(F.sum(F.col("latency_ms") * F.col("_k")) / F.sum("_k")).cast("bigint").alias("avg_latency"),
        F.min("latency_ms").alias("min_latency"),
        F.max("latency_ms").alias("max_latency"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col("latency_ms"))).alias("p50_latency"),
    )
    base = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), dollars("cost_usd").alias("cost_usd"), F.min_by("provider", order).alias("provider"))
    return base.join(latency, "model", "left")


def by_call_type(usage: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("call_type", F.lit("")) == "", "unknown").otherwise(F.col("call_type")).alias("call_type")
    return usage.groupBy(kind).agg(F.count("*").alias("calls"), dollars("cost_usd").alias("cost_usd"))


def by_day(usage: DataFrame) -> DataFrame:
    """Calls and cost of each day."""
    return usage.groupBy(F.left(F.col("timestamp").cast("string"), F.lit(10)).alias("day")).agg(F.count("*").alias("calls"), dollars("cost_usd").alias("cost_usd"))


def cube(usage: DataFrame) -> DataFrame:
    """Calls and cost by model, by call type and in all, in one pass."""
    return usage.groupingSets([["model"], ["call_type"], []], "model", "call_type").agg(F.count("*").alias("calls"), dollars("cost_usd").alias("cost_usd"))
