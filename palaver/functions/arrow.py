"""Functions of Arrow batches over DataFrames with columns of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def map_in_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any name, back quotes, dots and equal names included, and types of any field names.

    Inside, columns are called c0, c1, ...; what ``run`` yields is taken by position.
    """
    names = [f.name for f in schema.fields]
    plain = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(schema.fields)])

    def renamed(batches):
        for batch in run(batches):
            yield batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(renamed, plain).toDF(*names)
