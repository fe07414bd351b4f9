"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Both steps need only the smallest neighbour of each node, which partial aggregates find before the shuffle, and a
join of the links with it, whose skewed keys Spark splits.  No neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.shared import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u > v."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that a link with two different ends touches; component: the smallest node.

    Null ends, self links, repeated links and an empty table are allowed; they add nothing.
    """
    now = materialize(links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if state.n == 0 or (state.n, state.s) == seen:
            break
        seen = state.n, state.s
        step = materialize(_star(_star(now, True), False), "star")
        discard(now)
        now = step
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
