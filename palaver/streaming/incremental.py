"""Incremental processing by Structured Streaming file sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.plans.stored import cut
from palaver.sources.sinks import merge_table
from palaver.sources.transcripts import TRANSCRIPT, USAGE, id_of, read_transcripts

#: What a listing says of a file.
LISTING = "path string, mtime double, size bigint, hash string"


def new_transcripts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of transcripts that arrive in a folder; the checkpoint remembers which were seen."""
    df = spark.readStream.schema(TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).json(path)
    df = df.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_name").alias("file_name"))
    return df.where("_corrupt_record is null and (text is not null or segments is not null)").withColumn("call_id", id_of(spark, path, ".json")).drop("_corrupt_record")


def process_new(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply a batch transform to what is new and append the results; returns when all that is there is done."""

    def batch(df: DataFrame, n: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def list_files(spark: SparkSession, path: str, log: str) -> None:
    """Append what a folder of transcripts holds now to a log of listings, one line a file."""
    found = read_transcripts(spark, path)
    found.select(F.col("source").alias("path"), (F.unix_micros("file_mtime") / 1e6).alias("mtime"), F.col("file_size").alias("size"), T.content_hash("text").alias("hash")).write.mode("append").json(log)


def listings(spark: SparkSession, log: str, files_per_trigger: int = 1000) -> DataFrame:
    """The log of listings as a stream."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_trigger).json(log)


def versions(listed: DataFrame) -> DataFrame:
    """Of a stream of listings those that show a path with another hash than before; the state of a path is its last time and hash.

    Of several listings of a path in one batch the latest counts, of equal times the largest hash.  Listings older than what is known
    of the path, and those without path, time or hash, say nothing; a newer time with the same hash only moves the time on.
    """

    def newest(key, frames, state):
        at, known = state.get if state.exists else (float("-inf"), None)
        best = None
        for f in frames:
            last = f.sort_values(["mtime", "hash"]).tail(1)
            if best is None or (last["mtime"].iloc[0], last["hash"].iloc[0]) > (best["mtime"].iloc[0], best["hash"].iloc[0]):
                best = last
        if best is None or best["mtime"].iloc[0] < at:
            return
        now = best["hash"].iloc[0]
        state.update((float(best["mtime"].iloc[0]), now))
        if now != known:
            yield best[["path", "mtime", "size", "hash"]]

    told = listed.where("path is not null and mtime is not null and hash is not null").select("path", "mtime", "size", "hash")
    return told.groupBy("path").applyInPandasWithState(newest, LISTING, "mtime double, hash string", "update", "NoTimeout")


def process_changed(listed: DataFrame, read: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Process each version of each file once: ``read`` makes rows with a ``path`` of new versions, which replace the path's rows in ``out``.

    A batch that is run again after a failure replaces its own rows, so each version is there once.
    """

    def batch(df: DataFrame, n: int) -> None:
        new = cut(df, "versions")
        if not new.isEmpty():
            merge_table(read(new), out, new.select("path"))

    query = versions(listed).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def daily_usage(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Beyond batch roll-ups: calls, tokens and cost per day and model as entries arrive, with a watermark for late ones."""
    usage = spark.readStream.schema(USAGE).json(path).withColumn("ts", F.col("timestamp").cast("timestamp"))
    return usage.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_usd").alias("cost_usd"))
