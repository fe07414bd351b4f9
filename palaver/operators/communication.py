"""Talk time, turns, questions, monologues and balance of calls.

Segments are rows (call_id, ord, speaker, text, ...).  Everything is computed per call, so windows and aggregates share
one exchange on call_id; no call is gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T


def with_runs(segments: DataFrame) -> DataFrame:
    """Add words and the number of the run of equal speakers that each segment is in."""
    order = Window.partitionBy("call_id").orderBy("ord")
    return (
        segments.withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))
        .withColumn("words", T.word_count("text"))
        .withColumn("turned", F.coalesce((F.col("speaker") != F.lag("speaker").over(order)).cast("int"), F.lit(0)))
        .withColumn("run", F.sum("turned").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def speaker_stats(segments: DataFrame, question_suffix: str = "?") -> DataFrame:
    """Per call and speaker: words, turns, questions, share of the words, words a turn, longest monologue."""
    runs = with_runs(segments).groupBy("call_id", "speaker", "run").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.sum(T.is_question("text", question_suffix).cast("bigint")).alias("q"), F.sum("turned").alias("turned"))
    per = runs.groupBy("call_id", "speaker").agg(F.sum("words").alias("word_count"), F.sum("n").alias("segment_count"), F.sum("q").alias("question_count"), F.max("words").alias("longest_monologue_words"), F.sum("turned").alias("turns_taken"))
    total = F.sum("word_count").over(Window.partitionBy("call_id"))
    return per.select(
        "call_id",
        "speaker",
        "word_count",
        "segment_count",
        "question_count",
        F.round(F.when(total > 0, F.col("word_count") / total).otherwise(0.0), 3).alias("talk_ratio"),
        F.round(F.col("word_count") / F.col("segment_count"), 1).alias("avg_words_per_turn"),
        "longest_monologue_words",
        "turns_taken",
    )


def call_metrics(stats: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Per call, from :func:`speaker_stats`: totals, balance and changes of speaker per segment.

    With ``calls`` (call_id) calls without segments have a row of zeros.
    """
    found = _metrics(stats)
    if calls is None:
        return found
    counts = ["total_speakers", "total_words", "total_segments", "total_questions"]
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("speaking_balance", "speaker_switches_per_segment")])


def _metrics(stats: DataFrame) -> DataFrame:
    call = Window.partitionBy("call_id")
    spread = F.abs(F.col("talk_ratio") - F.lit(1.0) / F.count("*").over(call))
    return (
        stats.withColumn("spread", spread)
        .groupBy("call_id")
        .agg(F.count("*").alias("total_speakers"), F.sum("word_count").alias("total_words"), F.sum("segment_count").alias("total_segments"), F.sum("question_count").alias("total_questions"), F.sum("spread").alias("spread"), F.sum("turns_taken").alias("turns"))
        .select(
            "call_id",
            "total_speakers",
            "total_words",
            "total_segments",
            "total_questions",
            F.round(F.when((F.col("total_speakers") <= 1) | (F.col("total_words") == 0), 1.0).otherwise(1 - F.col("spread") / 2), 3).alias("speaking_balance"),
            F.round(F.col("turns") / F.col("total_segments"), 3).alias("speaker_switches_per_segment"),
        )
    )


def we_i_language(segments: DataFrame) -> DataFrame:
    """Per call and speaker: the words we and I, and the share of we."""
    low = T.lower("text")
    per = segments.groupBy("call_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(F.sum(F.regexp_count(low, F.lit(r"\bwe\b"))).alias("we_count"), F.sum(F.regexp_count(low, F.lit(r"\bi\b"))).alias("i_count"), F.min("ord").alias("first_ord"))
    both = F.col("we_count") + F.col("i_count")
    return per.withColumn("collaborative_ratio", F.round(F.when(both > 0, F.col("we_count") / both).otherwise(0.0), 3))


def engagement(segments: DataFrame) -> DataFrame:
    """Per call and speaker: average words a turn, turns of one or two words or none, turns."""
    return segments.groupBy("call_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(
        F.round(F.avg(T.word_count("text")), 1).alias("avg_words_per_turn"), F.count_if(T.word_count("text") <= 2).alias("one_word_answers"), F.count("*").alias("total_turns")
    )


def host_and_guest(segments: DataFrame) -> DataFrame:
    """Of calls with exactly two speakers, the one with fewer words is the guest; ties: who spoke first."""
    per = segments.groupBy("call_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")).agg(F.sum(T.word_count("text")).alias("words"), F.min("ord").alias("first_ord"))
    key = F.struct("words", "first_ord")
    return per.groupBy("call_id").agg(F.count("*").alias("n"), F.min_by("speaker", key).alias("guest"), F.max_by("speaker", key).alias("host")).where("n = 2").drop("n")


def key_quotes(segments: DataFrame, least_words: int = 20, most: int = 5) -> DataFrame:
    """The longest segments of more than ``least_words`` words of each call, at most ``most``."""
    order = Window.partitionBy("call_id").orderBy(F.length("quote").desc(), "ord")
    return segments.where(T.word_count("text") > least_words).withColumn("quote", T.strip("text")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("call_id", "place", "ord", F.coalesce("speaker", F.lit("Unknown")).alias("speaker"), "quote")


def numbered_turns(segments: DataFrame) -> DataFrame:
    """One text per call with a line ``[MM:SS] speaker: text`` for each segment."""
    line = F.format_string("[%s] %s: %s", T.clock("start"), F.coalesce("speaker", F.lit("Unknown")), F.coalesce("text", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    return segments.groupBy("call_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))
