"""Views of the driver's tables as calls, segments, usage logs, episodes, runs and identities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.functions import text as T

#: Fragments of the invented words that a third of the conversations hold; they stand in for the built-in terms.
FRAGMENTS = ["hest", "inbl", "ouble", "stou", "uing", "lein", "ered", "gble", "tien", "whst", "eable", "nted", "ofer", "haing", "ingon", "thine", "inon", "aning", "blere", "anou"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragments(groups: dict[str, list[str]], offset: int = 0, most: int = 4) -> dict[str, list[str]]:
    """The groups of a lexicon with fragments in place of their terms."""
    out, at = {}, offset
    for name, terms in groups.items():
        n = min(most, len(terms))
        out[name] = [FRAGMENTS[(at + k) % len(FRAGMENTS)] for k in range(n)]
        at += n
    return out


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as segments; a clock of 0.4 s a word stands in for time."""
    order = Window.partitionBy("call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seg = table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text").withColumn("_w", T.word_count("text"))
    return seg.withColumn("start", F.coalesce(F.sum("_w").over(order), F.lit(0)) * 0.4).withColumn("end", F.col("start") + F.col("_w") * 0.4).drop("_w")


SEG = r"""seg0 AS (SELECT conv_id AS call_id, turn AS ord, coalesce(role, 'Unknown') AS speaker, text, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS words FROM conversations),
seg AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY call_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.4::DOUBLE AS "start", coalesce(sum(words) OVER (PARTITION BY call_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.4::DOUBLE + words * 0.4::DOUBLE AS "end" FROM seg0)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as whole texts."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("call_id")).agg(F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias("text"), F.count_distinct("role").alias("n_named"))


CALLS = "calls AS (SELECT conv_id AS call_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text, lower(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS low, count(DISTINCT role) AS n_named FROM conversations GROUP BY conv_id)"


def event_segments(spark: SparkSession, d: str) -> DataFrame:
    """Events as timed segments: a call per user, the event type speaks."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker"), F.col("event_type").alias("text"), start.alias("start"), (start + F.coalesce("value", F.lit(0.0))).alias("end"))


EVENTS = """ev AS (SELECT user_id AS call_id, event_id AS ord, coalesce(event_type, 'Unknown') AS speaker, event_type AS text, epoch_us(ts) / 1e6 AS "start", epoch_us(ts) / 1e6 + coalesce(value, 0) AS "end" FROM events)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Line items as usage entries."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("call_type"), F.col("l_quantity").cast("bigint").alias("input_tokens"), (F.col("l_linenumber") * 10).cast("bigint").alias("output_tokens"),
        F.col("l_extendedprice").alias("cost_usd"), F.col("l_shipdate").alias("timestamp"), F.pmod("l_partkey", F.lit(97)).alias("latency_ms"), F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("provider"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("session"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
    )


USAGE = "usage AS (SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS call_type, CAST(floor(l_quantity) AS BIGINT) AS input_tokens, CAST(l_linenumber * 10 AS BIGINT) AS output_tokens, l_extendedprice AS cost_usd, l_shipdate AS ts, l_partkey % 97 AS latency_ms, 'p' || CAST(l_suppkey % 5 AS VARCHAR) AS provider, l_orderkey AS session, l_linenumber, l_partkey, l_suppkey FROM lineitem)"


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as episodes: the priority is the task type, the price the overall score."""
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("task_type"), F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("timestamp"), F.round(F.col("o_totalprice") / 50000, 4).alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("custkey"))


EPISODES = "ep AS (SELECT o_orderpriority AS task_type, o_orderkey AS pos, o_orderdate AS ts, round(o_totalprice / 50000, 4) AS score, o_orderstatus AS status, o_custkey AS custkey FROM orders)"
