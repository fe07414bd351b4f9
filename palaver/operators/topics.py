"""Topic boundaries and topics.

A boundary needs a pause or a transition phrase and enough time since the last accepted boundary; that greedy choice
is a fold over the candidates of a call alone, so only candidates are gathered, never whole calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.functions.lexicons import TOPIC_TRANSITIONS


def spans(segments: DataFrame, min_duration: float = 60, pause: float = 5.0, transitions: list[str] | None = None) -> DataFrame:
    """``segments`` with the number of the span (from 0) that each is in."""
    order = Window.partitionBy("call_id").orderBy("ord")
    phrase = T.any_hit(T.lower("text"), TOPIC_TRANSITIONS if transitions is None else transitions) if "text" in segments.columns else F.lit(False)
    marked = segments.withColumn("_start", F.coalesce("start", F.lit(0.0))).withColumn("_gap", F.col("_start") - F.coalesce(F.lag("end").over(order), F.lit(0.0))).withColumn("_first", F.row_number().over(order) == 1)
    marked = marked.withColumn("_candidate", F.col("_first") | (F.col("_gap") > pause) | phrase)
    points = F.array_sort(F.collect_list(F.when(F.col("_candidate"), F.struct("ord", F.col("_start").alias("at")))))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def accept(acc, x):
        ok = acc["last"].isNull() | (x["at"] - acc["last"] >= min_duration)
        return F.when(ok, F.struct(x["at"].cast("double").alias("last"), F.array_append(acc["kept"], x["ord"].cast("bigint")).alias("kept"))).otherwise(acc)

    kept = marked.groupBy("call_id").agg(F.aggregate(points, zero, accept)["kept"].alias("kept")).select("call_id", F.explode("kept").alias("ord"))
    accepted = marked.join(kept.withColumn("_accepted", F.lit(1)), ["call_id", "ord"], "left")
    return accepted.withColumn("span", F.sum(F.coalesce("_accepted", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).select(*segments.columns, "span")


def topics(segments: DataFrame, min_duration: float = 60, max_topics: int = 20, pause: float = 5.0, transitions: list[str] | None = None) -> DataFrame:
    """Per call and span: name, start, end, speakers and summary of a topic."""
    found = spans(segments, min_duration, pause, transitions).where(F.col("span") < max_topics)
    per = found.groupBy("call_id", "span").agg(
        F.min_by("start", "ord").alias("start_seconds"),
        F.max_by("end", "ord").alias("end_seconds"),
        F.sort_array(F.collect_set(F.coalesce("speaker", F.lit("Unknown")))).alias("speakers"),
        F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("t")), "ord")["t"].alias("first_text"),
        F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("t")))).alias("parts"),
        F.count("*").alias("n_segments"),
    )
    name = F.regexp_replace(F.left(T.strip("first_text"), F.lit(50)), r"\.+$", "")
    full = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    return per.select(
        "call_id",
        "span",
        F.when(T.strip("first_text") == "", F.format_string("Topic %d", F.col("span") + 1)).otherwise(name).alias("name"),
        "start_seconds",
        "end_seconds",
        "speakers",
        F.concat(T.strip(F.split_part(full, F.lit("."), F.lit(1))), F.lit(".")).alias("summary"),
        "n_segments",
    )
