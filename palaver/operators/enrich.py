"""Speaker labels for segments that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_map(resolved: DataFrame) -> DataFrame:
    """Per call and label: speaker, cluster and confidence; the last of repeated labels (by ord) wins."""
    best = F.max_by(F.struct("display_name", "speaker_cluster_id", "confidence"), "ord").alias("r")
    name = F.coalesce(F.nullif(F.col("r.display_name"), F.lit("")), F.nullif(F.col("r.speaker_cluster_id"), F.lit("")), F.col("label"))
    return resolved.groupBy("call_id", F.coalesce("local_label", F.lit("")).alias("label")).agg(best).select("call_id", "label", name.alias("speaker"), F.coalesce("r.speaker_cluster_id", F.lit("")).alias("speaker_cluster_id"), F.coalesce("r.confidence", F.lit(0.0)).alias("speaker_confidence"))


def labels_by_time(segments: DataFrame, timeline: DataFrame) -> DataFrame:
    """(call_id, ord, label): the first interval of the call's timeline (call_id, ord, start, end, label) that holds the segment's middle.

    An equi-join on call_id with the range as residual condition; the first match is an aggregate, so no window sorts
    the matches.
    """
    middle = segments.select("call_id", "ord", ((F.coalesce("start", F.lit(0.0)) + F.coalesce("end", F.lit(0.0))) / 2).alias("middle"))
    line = timeline.select(F.col("call_id").alias("_call"), F.col("ord").alias("_place"), F.coalesce("start", F.lit(0.0)).alias("_from"), F.coalesce("end", F.lit(0.0)).alias("_to"), F.col("label").alias("_label"))
    return middle.join(line, (F.col("call_id") == F.col("_call")) & F.col("middle").between(F.col("_from"), F.col("_to"))).groupBy("call_id", "ord").agg(F.min_by("_label", "_place").alias("label"))


def labels_by_pause(segments: DataFrame, labels: DataFrame, pause: float = 2.0) -> DataFrame:
    """(call_id, ord, label): the call's labels (call_id, place from 0, n, label) in turn, the next one after each longer pause."""
    order = Window.partitionBy("call_id").orderBy("ord")
    step = (F.coalesce("start", F.lit(0.0)) - F.coalesce(F.lag(F.coalesce("end", F.lit(0.0))).over(order), F.lit(0.0)) > pause).cast("int")
    turned = segments.withColumn("_step", step).withColumn("_turns", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = labels.groupBy("call_id").agg(F.count("*").alias("n"))
    return turned.join(size, "call_id").withColumn("place", F.when(F.col("n") > 1, F.pmod("_turns", "n")).otherwise(0)).join(labels, ["call_id", "place"]).select("call_id", "ord", "label")


def enrich(segments: DataFrame, resolved: DataFrame, timeline: DataFrame) -> DataFrame:
    """Segments with speaker, speaker_cluster_id and speaker_confidence where the call had no labels in its first five segments."""
    order = Window.partitionBy("call_id").orderBy("ord")
    rank = segments.withColumn("_nth", F.row_number().over(order))
    labelled = rank.groupBy("call_id").agg(F.max(F.when(F.col("_nth") <= 5, F.coalesce(F.col("speaker") != "", F.lit(False))).otherwise(False)).alias("labelled"))
    todo = segments.join(labelled.where("not labelled"), "call_id", "left_semi").join(resolved, "call_id", "left_semi")
    timed = labels_by_time(todo.join(timeline, "call_id", "left_semi"), timeline)
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("ord")) - 1
    turns = resolved.select("call_id", place.alias("place"), F.coalesce("local_label", F.lit("")).alias("label"))
    guessed = labels_by_pause(todo.join(timeline, "call_id", "left_anti"), turns)
    found = timed.unionByName(guessed).join(label_map(resolved).withColumnRenamed("speaker", "_named").withColumnRenamed("speaker_cluster_id", "_cluster").withColumnRenamed("speaker_confidence", "_sure"), ["call_id", "label"], "left")
    keep = [c for c in segments.columns if c not in ("speaker", "speaker_cluster_id", "speaker_confidence")]
    old = lambda c, kind: F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    return segments.join(found, ["call_id", "ord"], "left").select(
        *keep, F.coalesce("_named", F.nullif("label", F.lit("")), old("speaker", "string")).alias("speaker"), F.coalesce("_cluster", old("speaker_cluster_id", "string")).alias("speaker_cluster_id"), F.coalesce("_sure", old("speaker_confidence", "double")).alias("speaker_confidence")
    )
