"""Places, running sums and running minima over one order of any number of rows, without a task that sees them all.

Rows are range-partitioned by the order, which also splits a group with most of the rows; sums are taken inside each
range, and what stands before a range is added to it.  One row for each range reaches the driver: those of groups
that lie in several ranges, which are two for a range at most.

Cases: an empty table gives an empty table; a null in an order column has the place that the column's order gives it, a null
group is a group; null values add nothing; further columns pass through, whatever their names.  Ties have no order of their
own: rows that tie in all order columns keep any order among them, so an order ends with a key where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.plans.stored import cut


def _new(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = "_" + name
    return name


def quoted(name: str, of: str = "") -> Column:
    return F.col(of + "`" + name.replace("`", "``") + "`")


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column], within: list[str] = ()) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the exact sum (bigint or decimal) of the value up to and with the row, in its group.

    The rows are written once to the shared folder, since ranges that are sampled anew would differ.
    """
    part = _new(rows, "_part")
    values = {_new(rows, f"_value{k}"): v for k, v in enumerate(sums.values())}
    groups = {_new(rows, f"_group{k}"): quoted(g) for k, g in enumerate(within)}
    keyed = rows.withColumns(values | groups)
    order = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    ranged = cut(keyed.repartitionByRange(*[F.col(g).asc_nulls_first() for g in groups], *order).withColumn(part, F.spark_partition_id()), "ranges")
    inside = ranged.groupBy(part, *groups).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    if groups:
        across = inside.groupBy(*groups).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        a, b = inside.alias("a"), across.alias("b")
        same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
        inside = a.join(b, same, "left_semi")
    before, total = [], {}
    for r in sorted(inside.collect(), key=lambda r: r[part]):
        group = tuple(r[g] for g in groups)
        now = total.get(group) or tuple(type(r[v])(0) for v in values)
        before.append((r[part], *group, *now))
        total[group] = tuple(x + r[v] for x, v in zip(now, values, strict=True))
    w = Window.partitionBy(part, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({v: F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values})
    if before:
        schema = inside.select(part, *groups, *values).schema
        offsets = rows.sparkSession.createDataFrame(before, schema).select(F.col(part).alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], *[F.col(v).alias(f"_v{k}") for k, v in enumerate(values)])
        x, y = local.alias("x"), F.broadcast(offsets).alias("y")
        on = [F.col(f"x.{part}") == F.col("y._p"), *[F.col(f"x.{g}").eqNullSafe(F.col(f"y._g{k}")) for k, g in enumerate(groups)]]
        joined = x.join(y, on, "left")
        sums_of = [(F.col(f"x.{v}") + F.coalesce(F.col(f"y._v{k}"), F.lit(0))).alias(name) for k, (v, name) in enumerate(zip(values, sums, strict=True))]
        return joined.select(*[quoted(c, "x.") for c in rows.columns], *sums_of)
    return local.select(*[quoted(c) for c in rows.columns], *[F.col(v).alias(name) for v, name in zip(values, sums, strict=True)])


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place", within: list[str] = ()) -> DataFrame:
    """``rows`` with their place, from 1, in one order of all rows, or of each group's."""
    return running(rows, order, {name: F.lit(1).cast("bigint")}, within)


def least_so_far(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the least ``value``, nulls aside, up to and with the row in one order of all rows; null where there is none before.

    What stands before a range is a table with a row for each range, which stays on the executors.
    """
    part, v = _new(rows, "_part"), _new(rows, "_value")
    ranged = cut(rows.withColumn(v, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    up = Window.partitionBy(F.lit(1)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(part).agg(F.min(v).alias(v)).select(F.col(part).alias("_p"), F.min(v).over(up).alias("_v"))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x, y = ranged.withColumn(v, F.min(v).over(w)).alias("x"), F.broadcast(before).alias("y")
    joined = x.join(y, F.col(f"x.{part}") == F.col("y._p"), "left")
    return joined.select(*[quoted(c, "x.") for c in rows.columns], F.least(F.col(f"x.{v}"), F.col("y._v")).alias(name))
