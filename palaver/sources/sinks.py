"""Writers; all go through Spark's commit protocol, so a lost task leaves no partial file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import text as T


def write_analyses(documents: DataFrame, path: str) -> None:
    """(call_id, document) as lines of JSON, partitioned by call type where there is one."""
    parts = ["call_type"] if "call_type" in documents.columns else []
    documents.select(*parts, F.col("document").alias("value")).write.mode("overwrite").partitionBy(*parts).text(path)


def append_episodes(episodes: DataFrame, path: str) -> None:
    """Episodes appended to a folder per task type; the type is made safe as a folder name."""
    episodes.withColumn("task_type", T.safe_name("task_type")).write.mode("append").partitionBy("task_type").json(path)


def append_usage(usage: DataFrame, path: str, source_file: str | None = None, call_type: str | None = None) -> None:
    """Usage entries appended, stamped with their source and call type where these are missing."""
    out = usage
    for name, value in (("source_file", source_file), ("call_type", call_type)):
        if value is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in out.columns else F.lit(value))
    out.write.mode("append").json(path)


def clear(spark, path: str) -> int:
    """Number of rows of a log of JSON lines, which is then deleted."""
    n = spark.read.text(path).count()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def _places(spark, path: str):
    """The file system of a table, its folder, and those beside it of a new and of an old version."""
    place, new, old = (spark._jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".old"))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place, new, old


def _move(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"cannot move {a.toString()} to {b.toString()}")


def recover(spark, path: str) -> bool:
    """Bring back what a swap that failed left under ``path``.old; whether there is a table."""
    fs, place, _, old = _places(spark, path)
    if fs.exists(old):
        fs.delete(old, True) if fs.exists(place) else _move(fs, old, place)
    return fs.exists(place)


def replace_table(df: DataFrame, path: str) -> None:
    """A table swapped for a new version: written beside it, the old one moved aside, the new one moved in, the old one deleted.

    Whatever fails, a whole version stays under ``path`` or ``path``.old; a version that was left there comes back first.
    """
    spark = df.sparkSession
    fs, place, new, old = _places(spark, path)
    there = recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if there:
        _move(fs, place, old)
    _move(fs, new, place)
    fs.delete(old, True)


def merge_table(df: DataFrame, path: str, keys: DataFrame) -> None:
    """Rows of a table whose key is among ``keys`` (one column, which both have) are replaced by ``df``.

    Where the table holds none of the keys, ``df`` is appended and nothing is read but the keys; else the table is swapped.  Doing it
    again with the same rows leaves the same table, so what failed half-way is simply done again.  Keys without rows in ``df``
    lose theirs; null keys match nothing; a missing table is made.
    """
    spark, key = df.sparkSession, keys.columns[0]
    if not recover(spark, path):
        df.write.parquet(path)
        return
    there = spark.read.schema(df.schema).parquet(path)
    if there.join(keys, key, "left_semi").isEmpty():
        df.write.mode("append").parquet(path)
    else:
        replace_table(there.join(keys, key, "left_anti").select(*df.columns).unionByName(df), path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Markdown pages (file, markdown), one folder per file name."""
    pages.select("file", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_runs(runs: DataFrame, path: str, name: str | None = None) -> None:
    """Evaluation runs as JSON documents: appended, or, with a name, as the one document ``benchmark-NAME.json``.

    The latest state of a run that goes on is saved after each model under one name, which replaces what stood there in one step.
    """
    if name is None:
        runs.coalesce(1).write.mode("append").json(path)
        return
    spark = runs.sparkSession
    rows = [r.j for r in runs.select(F.to_json(F.struct(*runs.columns)).alias("j")).collect()]  # one run: a handful of models
    jvm = spark._jvm
    final, part = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"benchmark-{name}.json", f".benchmark-{name}.json.part"))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray("\n".join(rows).encode()))
    out.close()
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(final), over)


def emit(df: DataFrame, form: str = "json", most: int = 1000) -> str:
    """Rows as text for a terminal: JSON lines, a Markdown table, or YAML; after ``most`` rows a line says how many are left out."""
    rows = df.limit(most + 1).collect()
    more = ""
    if len(rows) > most:
        more = f"\n({df.count() - most} more rows; write them to a folder to see all)"
        rows = rows[:most]
    if form == "markdown":
        lines = [" | ".join(str(v) for v in r) for r in rows]
        return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *(f"| {x} |" for x in lines)]) + more
    shown = [r.j for r in df.sparkSession.createDataFrame(rows, df.schema).select(F.to_json(F.struct(*df.columns)).alias("j")).collect()] if rows else []
    if form == "yaml":
        # JSON values are YAML values
        return "\n".join("- " + "\n  ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in json.loads(x).items()) for x in shown) + more
    return "\n".join(shown) + more
