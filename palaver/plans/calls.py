"""The whole analysis of transcripts, keyed by call_id: segments, speaker statistics and typed calls are stored once, all else is lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators import analyzers, chunks, classify, communication, enrich, extract, incremental, reports, topics
from palaver.plans import documents, model
from palaver.plans.stored import cut
from palaver.sources import transcripts as S


def analyze(transcripts: DataFrame, lexicon: dict[str, list[str]] | None = None, override: str | None = None, insights: bool = False, min_duration: float = 60, max_topics: int = 20, competitors: list[str] = (), channels: list = ()) -> dict[str, DataFrame]:
    """Transcripts to tables: segments, stats, metrics, calls (type, sections of all kinds), topics, actions, decisions, questions, tags, documents, reports, routes."""
    # both are read by every later step: a call's type comes from hundreds of terms, and would be planned anew in each
    seg = cut(enrich.enrich(S.segments(transcripts), S.resolved_speakers(transcripts), S.timeline(transcripts)), "segments")
    stats = cut(communication.speaker_stats(seg), "stats")
    named = seg.where("coalesce(speaker, '') <> ''").groupBy("call_id").agg(F.count_distinct("speaker").alias("n_named"))
    base = transcripts.join(named, "call_id", "left")
    found = classify.classify(base, lexicon, "n_named")
    chunked = chunks.is_chunked()
    kind, sure = classify.resolve_type(F.lit(override).cast("string"), F.when(chunked, chunks.classification()), 0.9, F.col("call_type"), F.col("confidence"))
    typed = found.withColumn("_kind", classify.privacy_gate(kind, insights)).withColumn("confidence", sure).drop("call_type").withColumnRenamed("_kind", "call_type")
    typed = cut(typed.select("call_id", "text", "call_type", "confidence", "scores"), "typed")
    # which families there are is known before their columns are planned
    calls = cut(analyzers.analyze(typed, competitors=competitors, families=analyzers.present(typed)), "calls")
    ruled = topics.topics(seg, min_duration, max_topics)
    whole = transcripts.where(chunked)
    spans = ruled.join(whole, "call_id", "left_anti").select("call_id", "span", "name", "start_seconds", "end_seconds", "speakers", "summary").unionByName(chunks.topics(whole).withColumnRenamed("chunk", "span"))
    own = extract.action_items(seg).select("call_id", F.struct("ord", "pattern", "place").cast("string").alias("ord"), "item")
    late = chunks.actions(whole).select("call_id", F.struct("chunk", "place").cast("string").alias("ord"), "item")
    metrics = communication.call_metrics(stats, transcripts.select("call_id"))
    analysed = documents.analyses(calls, transcripts, seg, stats)
    return {
        "segments": seg,
        "stats": stats,
        "metrics": metrics,
        "calls": analysed,
        "topics": spans,
        "actions": chunks.merge_actions(own, late),
        "decisions": extract.decisions(seg),
        "questions": extract.questions(seg),
        "tags": reports.tags(calls, stats, spans).join(documents.tag_properties(calls, metrics), "call_id", "left"),
        "documents": documents.documents(analysed, stats, metrics, spans),
        "reports": documents.reports(analysed, stats, metrics, spans),
        "routes": incremental.route(calls.select("call_id", "call_type"), [(c["name"], list(c.get("on", []))) for c in channels]),
    }


def with_model(calls: DataFrame, complete: Callable[[str], str | None] | None = None, column: str = "reply", prompt: Column | None = None) -> DataFrame:
    """Hook for an external model: ``complete`` maps a prompt to a reply or None; without it the column is null."""
    return model.ask(calls, F.col("text") if prompt is None else prompt, complete, column)
