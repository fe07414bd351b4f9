"""Classification of calls by lexicons of substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.functions.lexicons import CLASSIFICATION


def merge_lexicons(custom: dict[str, list[str]] | None = None, discovered: dict[str, list[str]] | None = None, builtin: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Built-in types, then discovered ones that are absent, then custom ones, lower-cased, which replace a type."""
    out = dict(CLASSIFICATION if builtin is None else builtin)
    for kind, terms in (discovered or {}).items():
        out.setdefault(kind, terms)
    for kind, terms in (custom or {}).items():
        out[kind] = [t.lower() for t in terms]
    return out


def classify(calls: DataFrame, lexicon: dict[str, list[str]] | None = None, n_speakers: str | None = None) -> DataFrame:
    """Per call (call_id, text): call_type, confidence and all scores in falling order.

    A type's score is the share of its terms that are substrings of the lower-cased text.  A call of one speaker with
    fewer than 200 words and no score of .3 is a voice memo.  ``n_speakers`` names the column with the number of named
    speakers.  Scores are columns of one projection: no join, no shuffle.
    """
    lexicon = CLASSIFICATION if lexicon is None else lexicon
    kinds = [k for k, terms in lexicon.items() if terms]
    low = calls.withColumn("_low", T.lower("text"))
    score = {k: F.round(T.hit_count("_low", lexicon[k]) / F.lit(len(lexicon[k])), 12) for k in kinds}
    best = F.greatest(*score.values(), F.lit(0.0)) if kinds else F.lit(0.0)
    named = F.col(n_speakers) if n_speakers else F.lit(0)
    memo = (named == 1) & (T.word_count("text") < 200) & (F.col("_best") < 0.3)
    out = low.withColumn("_raw", F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("call_type"), score[k].alias("score")) for i, k in enumerate(kinds)])).withColumn("_best", F.array_max(F.transform("_raw", lambda s: s["score"])) if kinds else best).withColumn("_memo", memo)
    entry = F.struct(F.lit(len(kinds)).alias("place"), F.lit("voice-memo").alias("call_type"), F.lit(0.7).alias("score"))
    every = F.when(F.col("_memo"), F.array_append(F.filter("_raw", lambda s: s["call_type"] != "voice-memo"), entry)).otherwise(F.col("_raw"))
    ranked = F.array_sort(every, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["place"] - b["place"]))
    out = out.withColumn("_ranked", ranked)
    top: Column = F.get("_ranked", F.lit(0))
    hit = F.coalesce(top["score"] > 0, F.lit(False))
    return out.select(
        *calls.columns,
        F.when(hit, top["call_type"]).otherwise("unknown").alias("call_type"),
        F.when(hit, F.round(F.least(top["score"], F.lit(1.0)), 3)).otherwise(0.0).alias("confidence"),
        F.transform("_ranked", lambda s: F.struct(s["call_type"].alias("call_type"), F.round(s["score"], 3).alias("score"))).alias("scores"),
    )


def _placed(terms: list[str]):
    return lambda t: F.struct((F.array_position(F.array(*map(F.lit, terms)), t) - 1).alias("place"), t.alias("term"))


def matched_terms(calls: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """One row per call, group and matching term, in the lexicon's order."""
    low = calls.select("call_id", T.lower("text").alias("_low"))
    groups = F.array(*[F.struct(F.lit(g).alias("grp"), F.transform(T.hits("_low", terms), _placed(terms)).alias("found")) for g, terms in lexicon.items()])
    rows = low.select("call_id", F.explode(groups).alias("g")).select("call_id", "g.grp", F.explode("g.found").alias("f"))
    return rows.select("call_id", "grp", "f.place", "f.term")


def resolve_type(override: Column, chunk: Column, chunk_confidence: float, found: Column, confidence: Column) -> tuple[Column, Column]:
    """An explicit type, else the upstream chunks' type, else the classifier's, else unknown."""
    kind = F.coalesce(override, chunk, found, F.lit("unknown"))
    sure = F.when(override.isNotNull(), 1.0).when(chunk.isNotNull(), chunk_confidence).otherwise(F.coalesce(confidence, F.lit(0.0)))
    return kind, sure


def privacy_gate(kind: str | Column, insights: bool = False) -> Column:
    """Private call types are treated as business meetings unless insights into them were asked for."""
    c = T.col(kind)
    return c if insights else F.when(c.isin("family", "partner", "personal"), "business-meeting").otherwise(c)
