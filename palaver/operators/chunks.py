"""Results that an upstream tool made per chunk of a long call.

``llm_analysis`` is a VARIANT, since items may be texts or objects; what leaves this module is typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.extract import first_by_key


def _get(path: str, kind: str, v: str = "llm_analysis") -> Column:
    return F.try_variant_get(v, path, kind)


def is_chunked() -> Column:
    return F.coalesce(_get("$.chunked", "boolean"), F.lit(False)) & (F.coalesce(_get("$.chunk_count", "int"), F.lit(0)) > 1)


def _chunks(calls: DataFrame) -> DataFrame:
    return calls.select("call_id", F.posexplode(F.coalesce(_get("$.chunks", "array<variant>"), F.array().cast("array<variant>"))).alias("chunk", "c"))


def topics(calls: DataFrame) -> DataFrame:
    """A topic per chunk; a chunk without a title is called after its place."""
    get = lambda p, t: F.try_variant_get("c", p, t)
    labels = get("$.speaker_labels", "array<string>")
    speakers = F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, labels).otherwise(F.coalesce(get("$.speakers_identified", "array<string>"), F.array().cast("array<string>")))
    title = F.nullif(get("$.title", "string"), F.lit(""))
    return _chunks(calls).select("call_id", "chunk", F.coalesce(title, F.format_string("Part %d", F.col("chunk") + 1)).alias("name"), F.coalesce(get("$.start_time", "double"), F.lit(0.0)).alias("start_seconds"), F.coalesce(get("$.end_time", "double"), F.lit(0.0)).alias("end_seconds"), speakers.alias("speakers"), F.coalesce(get("$.summary", "string"), F.lit("")).alias("summary"))


def actions(calls: DataFrame) -> DataFrame:
    """Action items of all chunks, the first of each 60-character key."""
    rows = _chunks(calls).select("call_id", "chunk", F.posexplode(F.coalesce(F.try_variant_get("c", "$.action_items", "array<variant>"), F.array().cast("array<variant>"))).alias("place", "a"))
    text = F.coalesce(F.try_variant_get("a", "$.text", "string"), F.try_variant_get("a", "$.action", "string"), F.try_variant_get("a", "$", "string"), F.to_json("a"))
    return first_by_key(rows.select("call_id", "chunk", "place", text.alias("item")), F.left(F.trim(F.lower("item")), F.lit(60)), ["chunk", "place"])


def merge_actions(found: DataFrame, chunked: DataFrame) -> DataFrame:
    """A call's own action items, and those of its chunks whose 50-character key is new.  Both: (call_id, ord, item)."""
    both = found.select("call_id", F.lit(0).alias("source"), "ord", "item").unionByName(chunked.select("call_id", F.lit(1).alias("source"), "ord", "item"))
    key = F.left(F.lower("item"), F.lit(50))
    return first_by_key(both, F.concat(key), ["source", "ord"])


def classification() -> Column:
    """The chunks' call type: a text, or an object's type or call_type."""
    return F.coalesce(_get("$.classification.type", "string"), _get("$.classification.call_type", "string"), F.when(F.schema_of_variant(F.variant_get("llm_analysis", "$.classification", "variant")) == "STRING", _get("$.classification", "string")))


def metadata(calls: DataFrame) -> DataFrame:
    """Per chunked call: number of chunks, total duration and titles."""
    chunks = F.coalesce(_get("$.chunks", "array<variant>"), F.array().cast("array<variant>"))
    length = F.aggregate(chunks, F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_variant_get(c, "$.duration_seconds", "double"), F.lit(0.0)))
    titles = F.transform(chunks, lambda c, i: F.coalesce(F.try_variant_get(c, "$.title", "string"), F.format_string("Part %d", i + 1)))
    return calls.where(F.coalesce(_get("$.chunked", "boolean"), F.lit(False))).select("call_id", F.coalesce(_get("$.chunk_count", "int"), F.lit(0)).alias("chunk_count"), length.alias("total_duration"), titles.alias("chunk_titles"))
