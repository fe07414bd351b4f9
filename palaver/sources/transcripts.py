"""Readers of transcripts, episodes, usage logs and manifests, with fixed schemas; damaged rows are left out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<start:double,end:double,text:string,speaker:string,speaker_cluster_id:string,speaker_confidence:double>"
RESOLVED = "struct<local_label:string,speaker_cluster_id:string,display_name:string,status:string,confidence:double,source:string,is_new:boolean>"
TRANSCRIPT = (
    f"text string, language string, segments array<{SEGMENT}>, "
    f"diarization struct<num_speakers:int,speakers_resolved:array<{RESOLVED}>,segments:array<struct<start:double,end:double,speaker:string,label:string>>>, "
    "llm_analysis variant, metadata struct<audio:struct<duration_seconds:double,creation_time:string>,file:struct<name:string,size_human:string>>, _corrupt_record string"
)
EPISODE = "episode_id string, timestamp string, mode string, context struct<task_id:string,task_type:string,session_id:string,run_id:string,generation:int>, execution struct<model:string,provider:string,execution_time_ms:int>, outcome struct<status:string,scores:map<string,double>,findings:array<string>,errors:array<string>>, confidence double, category string"
USAGE = "timestamp string, model string, input_tokens bigint, output_tokens bigint, cost_usd double, source_file string, call_type string, latency_ms bigint, provider string"
RUN = "timestamp string, models_tested int, in_progress boolean, results array<struct<model:string,provider:string,tier:int,avg_quality:double,avg_latency_ms:bigint,total_cost_usd:double,success_rate:double>>"
MANIFEST = "version string, entries map<string,struct<file_path:string,file_hash:string,status:string,analyzed_at:string,call_type:string,file_size:bigint,file_mtime:double>>"
IDENTITIES = "identities map<string,struct<canonical_name:string,total_calls:int,total_speaking_seconds:double,first_seen:string,last_seen:string,typical_co_speakers:array<string>,aliases:array<string>,"
IDENTITIES += "name_history:array<struct<timestamp:string,name:string,confidence:double,status:string,conflict:boolean,sources:array<string>,evidence_count:int,top_evidence:array<struct<source:string,name:string,detail:string>>,role:string,calls_at_time:int>>>>"
#: In a scan for speakers, files whose names have these parts are results or databases, no transcripts.
NOT_FOR_SPEAKERS = r"embeddings|manifest|speaker_identities|\.audioscript"


def id_of(spark: SparkSession, path: str, suffix: str) -> F.Column:
    """A file's path below the folder that is read, without its suffix; the whole path where that is no folder."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString().rstrip("/")
    file = F.replace("source", F.lit(":///"), F.lit(":/"))
    root = root.replace(":///", ":/")
    below = F.when(F.startswith(file, F.lit(root + "/")), F.expr(f"substring(replace(source, ':///', ':/'), {len(root) + 2})")).when(file == F.lit(root), F.col("file_name")).otherwise(file)
    return F.regexp_replace(below, re.escape(suffix) + "$", "")


def read_transcripts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per JSON document that has a text or segments; a missing text is joined from the segments.

    call_id is the path below ``path``, so files of one name in two folders are two calls; ``name`` is the bare file name.
    """
    reader = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.json(path).select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("file_mtime"))
    df = df.where(F.col("_corrupt_record").isNull() & (F.col("text").isNotNull() | F.col("segments").isNotNull()))
    joined = F.array_join(F.transform("segments", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return df.withColumn("text", F.coalesce("text", joined)).withColumn("call_id", id_of(spark, path, ".json")).withColumn("name", F.regexp_replace("file_name", r"\.json$", "")).drop("_corrupt_record")


def read_for_speakers(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a folder and the folders in it, without files whose names mark them as results or databases."""
    return read_transcripts(spark, path).where(~F.col("file_name").rlike(NOT_FOR_SPEAKERS))


def segments(transcripts: DataFrame) -> DataFrame:
    """Segments as rows in list order."""
    return transcripts.select("call_id", F.posexplode("segments").alias("ord", "s")).select("call_id", "ord", "s.*")


def resolved_speakers(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("call_id", F.posexplode("diarization.speakers_resolved").alias("ord", "r")).select("call_id", "ord", "r.*")


def timeline(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("call_id", F.posexplode("diarization.segments").alias("ord", "d")).select("call_id", "ord", "d.start", "d.end", F.coalesce("d.speaker", "d.label").alias("label"))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_episodes(spark: SparkSession, path: str, task_type: str | None = None) -> DataFrame:
    """Episodes of a folder partitioned by task_type; a type prunes the folders that are read."""
    df = _json_lines(spark, path, EPISODE)
    return df if task_type is None else df.where(F.col("task_type") == task_type if "task_type" in df.columns else F.col("context.task_type") == task_type)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, USAGE)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Saved evaluation runs, without those still in progress: one row per run with its best model."""
    df = spark.read.schema(RUN).option("multiLine", True).option("pathGlobFilter", "benchmark-*.json").json(path).withColumn("file_name", F.col("_metadata.file_name"))
    return df.where(~F.coalesce("in_progress", F.lit(False))).withColumn("top", F.get("results", F.lit(0))).select("file_name", "timestamp", "models_tested", "results", F.col("top.model").alias("top_model"), F.col("top.avg_quality").alias("top_quality")).orderBy(F.col("file_name").desc())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries; fields that an older version lacks are null."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select(F.explode("entries").alias("key", "e")).select("e.*")


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IDENTITIES).option("multiLine", True).json(path).select(F.explode("identities").alias("cluster_id", "i")).select("cluster_id", "i.*")


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Saved analyses (``*.analysis.json``) as VARIANT by the call they belong to (name: the bare file name)."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.analysis.json").text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("file_name"))
    return df.select(id_of(spark, path, ".analysis.json").alias("call_id"), F.regexp_replace("file_name", r"\.analysis\.json$", "").alias("name"), F.try_parse_json("value").alias("analysis"))
