"""Extracted items against ground truth and transcripts, and quality scores of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as T

#: Weights of a reply's format, schema, accuracy, grounding and evidence.
WEIGHTS = {"format_valid": 0.10, "schema_complete": 0.15, "accuracy": 0.30, "grounding": 0.25, "evidence_quality": 0.20}


def word_set(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.lower(c), F.lit(r"(?U)(\S+)"), F.lit(1)))


def greedy_matches(extracted: str | Column, truth: str | Column, threshold: float = 0.5) -> Column:
    """Number of extracted items that, taken in order, find a truth item that is still free.

    Two items match if enough of the truth's words are shared or one text holds the other.  The fold runs over the
    arrays of one row inside the JVM.
    """
    shape = lambda c: F.transform(F.coalesce(T.col(c), F.array().cast("array<string>")), lambda s: F.struct(F.lower(s).alias("low"), word_set(s).alias("words")))
    truths, found = shape(truth), shape(extracted)
    start = F.struct(F.array().cast("array<int>").alias("used"))

    def step(acc, e):
        def fits(g, i):
            shared = F.size(F.array_intersect(e["words"], g["words"]))
            enough = (F.size(g["words"]) > 0) & (F.size(e["words"]) > 0) & ((shared / F.greatest(F.size(g["words"]), F.lit(1)) >= threshold) | F.contains(e["low"], g["low"]) | F.contains(g["low"], e["low"]))
            return F.when(enough & ~F.array_contains(acc["used"], i), i)

        free = F.array_min(F.array_compact(F.transform(truths, fits)))
        return F.struct(F.when(free.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], free)).alias("used"))

    return F.size(F.aggregate(found, start, step)["used"])


def precision_recall(rows: DataFrame, extracted: str = "extracted", truth: str = "truth", threshold: float = 0.5) -> DataFrame:
    """``rows`` with matches, precision, recall and f1."""
    n, m = F.size(F.coalesce(extracted, F.array())), F.size(F.coalesce(truth, F.array()))
    out = rows.withColumn("matches", greedy_matches(extracted, truth, threshold))
    p, r = F.col("matches") / F.nullif(n, F.lit(0)), F.col("matches") / F.nullif(m, F.lit(0))
    both = (n == 0) & (m == 0)
    precision = F.when(both, 1.0).otherwise(F.coalesce(F.when(m > 0, p), F.lit(0.0)))
    recall = F.when(m == 0, 1.0).otherwise(F.coalesce(r, F.lit(0.0)))
    f1 = F.when(both, 1.0).when(m == 0, 0.0).otherwise(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return out.select("*", F.round(precision, 3).alias("precision"), F.round(recall, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def grounded(item: str | Column, text: str | Column, least: int = 2) -> Column:
    """Whether an item shares at least ``least`` different words with a text or stands in it."""
    return (F.size(F.array_intersect(word_set(item), word_set(text))) >= least) | F.contains(T.lower(text), T.lower(item))


def accepted_types(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions (fixture, call_type) against truth (fixture, call_type, accepted_types): accuracy 1, 0, or 0 without truth."""
    t = truth.select("fixture", F.array_union(F.array("call_type"), F.coalesce("accepted_types", F.array().cast("array<string>"))).alias("_valid"))
    return predicted.join(t, "fixture", "left").withColumn("accuracy", F.coalesce(F.array_contains("_valid", F.col("call_type")).cast("double"), F.lit(0.0))).drop("_valid")


def quality(schema_complete: Column, accuracy: Column, grounding: Column, evidence: Column) -> Column:
    """Composite score of a valid reply, 0 to 10."""
    return F.round((F.lit(1.0) * WEIGHTS["format_valid"] + schema_complete * WEIGHTS["schema_complete"] + accuracy * WEIGHTS["accuracy"] + grounding * WEIGHTS["grounding"] + evidence * WEIGHTS["evidence_quality"]) * 10, 2)


def score_replies(replies: DataFrame, expected: list[str]) -> DataFrame:
    """Replies (response, transcript, accuracy) in JSON: parts of the quality and the score.

    No reply scores 0, a reply that is not JSON 0.5.  Expected fields are looked for in an object, or in the first entry
    of a list.  Held against the transcript are an object's texts reasoning, quote and evidence and the entries of its lists
    findings, strengths, gaps and strongest_signals, or a list's entries (of objects the text, else the quote).  Evidence is the
    share of an object's fields that are not empty, or a third for each entry of a list, at most 1.
    """
    body = T.json_without_fence("response")
    out = replies.withColumn("_v", F.try_parse_json(body))
    kind = F.schema_of_variant("_v")
    is_object, is_list = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)), F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    out = out.withColumn("_m", F.when(is_object, F.try_variant_get("_v", "$", "map<string,variant>"))).withColumn("_l", F.when(is_list, F.try_variant_get("_v", "$", "array<variant>")))
    first = F.try_variant_get("_v", "$[0]", "map<string,variant>")
    keys = F.coalesce(F.map_keys("_m"), F.when(is_list, F.map_keys(first)), F.array().cast("array<string>"))
    present = F.size(F.filter(F.array(*map(F.lit, expected)), lambda k: F.array_contains(keys, k))) if expected else F.lit(0)
    schema = present / F.lit(len(expected)) if expected else F.lit(1.0)
    empty = ["", '""', "0", "0.0", "[]", "{}", "null", "false", '"null"']
    json = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    filled = F.size(F.filter(F.map_values("_m"), lambda v: ~json(v).isin(*empty)))
    evidence = F.when(F.col("_m").isNotNull(), F.least(F.lit(1.0), filled / F.greatest(F.size("_m"), F.lit(1)))).when(F.col("_l").isNotNull(), F.least(F.lit(1.0), F.size("_l") / 3)).otherwise(0.0)
    plain = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), json(v))
    texts = F.filter(F.array(*[F.when(F.startswith(json(F.try_variant_get("_v", f"$.{k}", "variant")), F.lit('"')), F.try_variant_get("_v", f"$.{k}", "string")) for k in ("reasoning", "quote", "evidence")]), lambda v: v.isNotNull() & (v != ""))
    nested = F.flatten(F.array(*[F.transform(F.filter(F.coalesce(F.try_variant_get("_v", f"$.{k}", "array<variant>"), F.array().cast("array<variant>")), lambda v: ~json(v).isin(*empty[:-1])), plain) for k in ("findings", "strengths", "gaps", "strongest_signals")]))
    entries = F.transform("_l", lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.quote", "string"), plain(v)))
    checks = F.when(F.col("_l").isNotNull(), entries).when(F.col("_m").isNotNull(), F.concat(texts, nested)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_checks", F.when(F.coalesce("transcript", F.lit("")) == "", F.array().cast("array<string>")).otherwise(checks))
    words = word_set("transcript")
    ok = F.size(F.filter("_checks", lambda v: (F.size(F.array_intersect(word_set(v), words)) >= 2) | F.contains(T.lower("transcript"), F.lower(v))))
    grounding = F.when(F.size("_checks") > 0, F.round(ok / F.size("_checks"), 3)).otherwise(1.0)
    valid = F.col("_v").isNotNull()
    score = F.when(F.col("response").isNull(), 0.0).when(~valid, 0.5).otherwise(quality(schema, F.coalesce("accuracy", F.lit(0.0)), grounding, evidence))
    part = lambda c: F.when(valid, c).otherwise(0.0)
    return out.select(*replies.columns, valid.alias("json_valid"), part(F.round(schema, 3)).alias("schema_complete"), part(grounding).alias("grounding_rate"), F.when(valid, F.size("_checks") - ok).otherwise(0).alias("hallucinated_count"), part(F.round(evidence, 3)).alias("evidence_quality"), score.alias("quality_score"))


def score_summaries(replies: DataFrame) -> DataFrame:
    """Summaries (response, transcript, keywords): share of the keywords, grounding and length."""
    low = T.lower("response")
    n = F.size(F.coalesce("keywords", F.array().cast("array<string>")))
    share = F.coalesce(F.try_divide(F.size(F.filter("keywords", lambda k: F.contains(low, F.lower(k)))), n), F.lit(0.0))
    ground = F.when(F.coalesce("transcript", F.lit("")) == "", 1.0).otherwise(grounded("response", "transcript").cast("double"))
    length = F.least(F.lit(1.0), T.word_count("response") / 30)
    return replies.select("*", F.round(share, 3).alias("accuracy"), ground.alias("grounding_rate"), F.coalesce(F.when(F.col("response").isNotNull(), quality(F.lit(1.0), share, ground, length)), F.lit(0.0)).alias("quality_score"))
