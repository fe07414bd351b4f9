"""Action items, decisions, questions and summaries from segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.functions.lexicons import ACTIONS, DECISIONS, SUMMARY_TRANSITIONS


def _item(pattern: int):
    return lambda m, i: F.struct(F.lit(pattern).alias("pattern"), i.alias("place"), T.strip(m).alias("item"))


def matches(segments: DataFrame, patterns: list[str], least: int = 5) -> DataFrame:
    """One row per match of the patterns' first group: (call_id, ord, pattern, place, item, speaker, start)."""
    body = T.strip("text")
    every = F.flatten(F.array(*[F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), _item(k)) for k, p in enumerate(patterns)]))
    rows = segments.select("call_id", "ord", F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "start", F.explode(every).alias("m"))
    return rows.select("call_id", "ord", "m.pattern", "m.place", "m.item", "speaker", "start").where(F.length("item") >= least)


def first_by_key(rows: DataFrame, key: Column, order: list, within: str = "call_id") -> DataFrame:
    """The first row of each normalised key."""
    w = Window.partitionBy(within, "_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_key", "_nth")


def _items(segments: DataFrame, patterns: list[str]) -> DataFrame:
    return first_by_key(matches(segments, patterns), F.left(F.lower("item"), F.lit(50)), ["ord", "pattern", "place"])


def action_items(segments: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return _items(segments, ACTIONS if patterns is None else patterns)


def decisions(segments: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return _items(segments, DECISIONS if patterns is None else patterns)


def questions(segments: DataFrame, suffix: str = "?") -> DataFrame:
    return segments.where(T.is_question("text", suffix)).select("call_id", "ord", T.strip("text").alias("question"), F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "start")


def attendees(segments: DataFrame) -> DataFrame:
    """Per call and speaker: words, segments and share of the words."""
    per = segments.groupBy("call_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(F.sum(T.word_count("text")).alias("word_count"), F.count("*").alias("segment_count"))
    total = F.sum("word_count").over(Window.partitionBy("call_id"))
    return per.withColumn("talk_ratio", F.round(F.when(total > 0, F.col("word_count") / total).otherwise(0.0), 3))


def summary(calls: DataFrame, transitions: list[str] | None = None) -> DataFrame:
    """Per call (call_id, text, first_start, last_end): opening sentences, words, duration and topic shifts."""
    phrases = SUMMARY_TRANSITIONS if transitions is None else transitions
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: F.length(s) > 10)
    out = calls.withColumn("_s", sentences)
    return out.select(
        "call_id",
        F.when(F.size("_s") > 0, F.array_join(F.slice("_s", 1, 3), " ")).otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(200))).alias("opening"),
        T.word_count("text").alias("word_count"),
        F.round(F.col("last_end") - F.col("first_start"), 1).alias("duration_seconds"),
        F.size(F.filter("_s", lambda s: T.any_hit(F.lower(s), phrases))).alias("topic_shifts"),
    )


def keyword_segments(segments: DataFrame, terms: list[str], unique: bool = False) -> DataFrame:
    """Segments that hold a term, with the first term of the list; ``unique``: the first of equal beginnings per call."""
    found = segments.select("call_id", "ord", F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "start", T.strip("text").alias("quote"), T.first_hit(T.lower("text"), terms).alias("keyword")).where("keyword is not null")
    return first_by_key(found, F.lower(F.left("quote", F.lit(50))), ["ord"]) if unique else found
