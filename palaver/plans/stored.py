"""Tables that several later steps read, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and executors are threads of this machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="palaver-"))
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: what reads it neither computes nor plans it anew.

    The table goes with :func:`clear`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/palaver/calls/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete all tables of :func:`cut`; what was made of them must have been stored by then."""
    for path, spark in list(_WRITTEN.items()):
        del _WRITTEN[path]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(where, True)


@atexit.register
def _clear_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        clear()
