"""What still has to be processed, given a manifest of earlier work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, mtime, size, hash) that no completed entry covers: neither by time and size nor by content.

    A left anti join on path; the hash is compared only where time or size differ.
    """
    done = manifest.where("status = 'completed'").select(F.col("file_path").alias("_path"), F.col("file_mtime").alias("_mtime"), F.col("file_size").alias("_size"), F.col("file_hash").alias("_hash"))
    same = ((F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size"))) | (F.col("hash") == F.col("_hash"))
    return files.join(done, (F.col("path") == F.col("_path")) & same, "left_anti")


def record(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """The manifest with processed files (path, mtime, size, hash, call_type, status, analyzed_at) put in by path."""
    new = processed.select(F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), "status", "analyzed_at", "call_type", F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime"))
    return manifest.join(new, "file_path", "left_anti").select(new.columns).unionByName(new)


def route(calls: DataFrame, channels: list[tuple[str, list[str]]]) -> DataFrame:
    """Calls with the configured notification channels (name, call types) that want them; an empty list wants all.

    The channels are settings, so they are constants of a projection and no join.
    """
    entries = [F.struct(F.lit(name).alias("name"), (F.lit(True) if not kinds else F.coalesce(F.col("call_type").isin(*kinds), F.lit(False))).alias("wants")) for name, kinds in channels]
    wanted = F.filter(F.array(*entries), lambda e: e["wants"]) if entries else F.array().cast("array<struct<name:string,wants:boolean>>")
    return calls.select(*calls.columns, F.explode(wanted).alias("_c")).select(*calls.columns, F.col("_c.name").alias("channel"))
