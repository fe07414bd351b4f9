"""Operator 6: embedding near-duplicates by an epsilon grid order join.

Two vectors of the same label and length link if their cosine in double precision is at least ``COSINE``.  On the unit
sphere that is a distance of at most eps = sqrt(2 - 2 * COSINE), and a projection on orthonormal directions never
lengthens it.  Vectors are sorted by their grid cells of width eps on the leading principal directions (epsilon grid
order) and cut into blocks.  The sequence of blocks is joined with itself by recursion: intervals of ``FAN`` to the power of
k blocks have bounding boxes in those directions; only pairs of intervals whose boxes are no further apart than eps, and whose
labels overlap, are taken apart into pairs of their parts, level by level down to blocks, so provably distant intervals are never
paired.  Of a pair of blocks one sends the other only its vectors within eps of the other's box; blocks are joined by the
same recursion, down to leaves that a matrix product decides.

Equal vectors of one label are one class with a multiplicity first, so a group of copies costs one vector; links are
counted with multiplicities and leave a task as one row per class, never as pairs.  Components come from the stars of
each task's links by large-star and small-star steps.  The principal directions come from a bounded sample of
``SAMPLE`` vectors; they steer the order and no result depends on them.

Cases: vectors that are null, zero or hold null or non-finite components, and null labels, link with nothing; rows
without a vec_id have 0 links and no component; equal vectors under one vec_id link with each other, and
the links of different vectors under one vec_id are counted together; vectors
of different lengths never link; an empty table gives an empty table; further columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.components import components
from palaver.llm.shared import look_up, materialize, table, worker_state

COSINE = 0.98
DIRECTIONS = 6
BLOCK, LEAF, FAN = 512, 64, 8
SAMPLE = 4_000


def _valid(batches):
    """(vec_id, label, dim, h1, h2, unit) of the vectors that can link."""
    for batch in batches:
        column = batch.column(2)
        values, offsets = column.flatten(), None
        sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        bad = np.asarray(values.is_null())
        flat = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        rows, h1, h2, unit = [], [], [], []
        for r in np.flatnonzero(sizes).tolist():
            a, b = offsets[r], offsets[r + 1]
            x = flat[a:b]
            if bad[a:b].any() or not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()  # keeps squares in range
            u = x / math.sqrt(float(x @ x))
            both = xxhash.xxh3_128_intdigest(flat[a:b].tobytes())
            rows.append(r)
            h1.append((both >> 64) - (1 << 63))
            h2.append((both & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
            unit.append(u.tobytes())
        kept = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(sizes[rows].astype(np.int32)), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(unit, pa.binary())], ["vec_id", "label", "dim", "h1", "h2", "unit"])


def directions(classes: DataFrame, most: int = SAMPLE) -> dict[int, np.ndarray]:
    """Leading principal directions (columns) of a bounded sample of the unit vectors of each length."""
    counts = {r.dim: r["count"] for r in classes.groupBy("dim").count().collect()}
    out = {}
    for dim, n in counts.items():
        share = min(1.0, most / n)
        rows = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("unit").limit(2 * most).collect()
        x = np.array([np.frombuffer(r.unit) for r in rows]).reshape(-1, dim)
        if len(x) < 2:
            out[dim] = np.eye(dim)[:, : min(dim, DIRECTIONS)]
            continue
        x = x - x.mean(axis=0)
        _, vectors = np.linalg.eigh(x.T @ x)
        out[dim] = np.ascontiguousarray(vectors[:, ::-1][:, : min(dim, DIRECTIONS)])
    return out


def _places(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Projections of unit vectors, filled up with zeros to ``DIRECTIONS``."""
    out = np.zeros((len(u), DIRECTIONS))
    out[:, : axes.shape[1]] = u @ axes
    return out


def _apart(lo, hi, lo2, hi2) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(np.maximum(lo2 - hi, lo - hi2), 0)
    return float(gap @ gap)


def join_blocks(ids, counts, u, p, ids2, counts2, u2, p2, same: bool, cosine: float):
    """(class, links, root) of the classes of two blocks that link; ``same``: the blocks are one."""
    reach = 2 - 2 * cosine + 1e-9
    n = len(ids)
    parent = list(range(n + (0 if same else len(ids2))))
    links = np.zeros(len(parent), np.int64)
    shift = 0 if same else n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stack = [(0, n, 0, len(ids2))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d:
            continue
        if same and d <= a:
            continue  # the mirror image of an interval pair that is looked at
        if _apart(p[a:b].min(axis=0), p[a:b].max(axis=0), p2[c:d].min(axis=0), p2[c:d].max(axis=0)) > reach:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(u[a:b] @ u2[c:d].T >= cosine)
            i, j = i + a, j + c
            if same:
                upper = i < j
                i, j = i[upper], j[upper]
            np.add.at(links, i, counts2[j])
            np.add.at(links, j + shift, counts[i])
            for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    every = ids if same else np.concatenate((ids, ids2))
    hit = np.flatnonzero(links)
    return every[hit], links[hit], every[[find(i) for i in hit.tolist()]] if len(hit) else every[:0]


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, n, root): links of classes (rep, copies, label, dim, unit) found in each pair of blocks."""
    spark = classes.sparkSession
    axes = spark.sparkContext.broadcast(directions(classes))
    eps = math.sqrt(2 - 2 * cosine) + 1e-9

    def cells(batches):
        for batch in batches:
            dims = np.asarray(batch.column(3))
            units = [np.frombuffer(x.as_buffer()) for x in batch.column(4)]
            place = np.zeros((len(dims), DIRECTIONS))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                place[at] = _places(np.array([units[i] for i in at]), axes.value[int(dim)])
            grid = np.floor(place / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, k]) for k in range(DIRECTIONS))], [*batch.schema.names, *(f"c{k}" for k in range(DIRECTIONS))])

    grid = [f"c{k}" for k in range(DIRECTIONS)]
    ordered = classes.select("rep", "copies", "label", "dim", "unit").mapInArrow(cells, "rep bigint, copies bigint, label string, dim int, unit binary, " + ", ".join(f"{c} int" for c in grid))
    order = ["label", "dim", *grid, "rep"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        worker_state("egojoin", 0, dict)
        held: list[tuple] = []
        key, nth = None, 0

        def block():
            u = np.array([np.frombuffer(h[2]) for h in held])
            p = _places(u, axes.value[key[1]])
            return pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int64()), pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()), pa.array([u.tobytes()], pa.binary())],
                ["nth", "label", "dim", "lo", "hi", "ids", "copies", "units"],
            )

        for batch in batches:
            for rep, copies, label, dim, unit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and (key != (label, dim) or len(held) >= BLOCK):
                    yield block()
                    held.clear()
                    nth += 1
                key = (label, dim)
                held.append((rep, copies, unit))
        if held:
            yield block()

    blocks = materialize(ordered.mapInArrow(cut, "nth bigint, label string, dim int, lo array<double>, hi array<double>, ids binary, copies binary, units binary").withColumn("part", F.spark_partition_id()), "ego-blocks")
    # blocks are numbered through in the order of the sequence; there is a row here for each partition
    counts = {r.part: r.n for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, before = 0, {}
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    if not total:
        return spark.createDataFrame([], LINKS)
    numbered = blocks.withColumn("block", F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("part")].cast("bigint") + F.col("nth"))
    pairs = materialize(_near(numbered, total, eps * eps), "ego-pairs")
    data = numbered.select("block", "dim", "ids", "copies", "units")

    def inside(batches):
        """Links inside each block."""
        for batch in batches:
            out = []
            for _, dim, ids, copies, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, n, u = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(units).reshape(-1, dim)
                p = _places(u, axes.value[dim])
                out.append(join_blocks(i, n, u, p, i, n, u, p, True, cosine))
            yield _link_batch(out)

    def near_part(batches):
        """Of each pair's first block the vectors that the other's box may reach."""
        for batch in batches:
            rows = []
            for b, lo, hi, dim, ids, copies, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u = np.frombuffer(units).reshape(-1, dim)
                p = _places(u, axes.value[dim])
                gap = np.maximum(np.maximum(np.array(lo) - p, p - np.array(hi)), 0)
                near = np.flatnonzero((gap * gap).sum(axis=1) <= 2 - 2 * cosine + 1e-9)
                if len(near):
                    rows.append((b, np.frombuffer(ids, np.int64)[near].tobytes(), np.frombuffer(copies, np.int64)[near].tobytes(), u[near].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "ids_a", "copies_a", "units_a"])

    def across(batches):
        for batch in batches:
            out = []
            for dim, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, copies, ids2, copies2 = (np.frombuffer(parts[k], np.int64) for k in (0, 1, 3, 4))
                u, u2 = (np.frombuffer(parts[k]).reshape(-1, dim) for k in (2, 5))
                out.append(join_blocks(ids, copies, u, _places(u, axes.value[dim]), ids2, copies2, u2, _places(u2, axes.value[dim]), False, cosine))
            yield _link_batch(out)

    box = numbered.select(F.col("block").alias("b"), "lo", "hi")
    sent = pairs.where("a < b").join(box, "b").join(data, F.col("a") == F.col("block")).select("b", "lo", "hi", "dim", "ids", "copies", "units").mapInArrow(near_part, "block bigint, ids_a binary, copies_a binary, units_a binary")
    other = sent.join(data, "block").select("dim", "ids_a", "copies_a", "units_a", "ids", "copies", "units").mapInArrow(across, LINKS)
    return data.mapInArrow(inside, LINKS).unionByName(other)


LINKS = "rep bigint, n bigint, root bigint"


def _link_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in (zip(*found, strict=True) if found else ((), (), ()))], ["rep", "n", "root"])


def _near(blocks: DataFrame, total: int, reach: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose labels overlap and whose boxes are no further apart than the root of ``reach``.

    Intervals of the sequence are paired from the whole down: what a pair of distant intervals holds is never looked at.
    """
    bounds = [f(f"{side}{k}").alias(f"{side}{k}") for k in range(DIRECTIONS) for side, f in (("lo", F.min), ("hi", F.max))]
    levels = [blocks.select("block", F.struct("label", "dim").alias("least"), F.struct("label", "dim").alias("most"), *[F.col(side)[k].alias(f"{side}{k}") for k in range(DIRECTIONS) for side in ("lo", "hi")])]
    while total > 1:
        total = -(-total // FAN)
        levels.append(levels[-1].withColumn("block", F.expr(f"block div {FAN}")).groupBy("block").agg(F.min("least").alias("least"), F.max("most").alias("most"), *bounds))
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    gap = " + ".join(f"power(greatest(y.lo{k} - x.hi{k}, x.lo{k} - y.hi{k}, 0D), 2)" for k in range(DIRECTIONS))
    for level in reversed(levels[:-1]):
        parts = level.withColumn("of", F.expr(f"block div {FAN}"))
        pairs = pairs.join(parts.alias("x"), F.col("a") == F.col("x.of")).join(parts.alias("y"), F.col("b") == F.col("y.of")).where(f"x.block <= y.block and x.least <= y.most and y.least <= x.most and {gap} <= {reach!r}").select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    return pairs


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by links), kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    valid = materialize(rows.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_valid, "vec_id bigint, label string, dim int, h1 bigint, h2 bigint, unit binary"), "vectors")
    key = ["label", "dim", "h1", "h2"]
    classes = materialize(valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max("unit").alias("unit")), "vector-classes")
    # classes of one smallest vec_id (it stands in several rows) are told apart by nothing else: they count as one node
    found = materialize(links(classes, cosine), "vector-links")
    joined = components(found, "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    member = look_up(valid.select("vec_id", *key), classes.select(*key, "rep", "copies", F.col("copies").alias("rows")), key, "rows")
    out = (
        member.join(counts, "rep", "left")
        .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rest = rows.select("vec_id").join(valid.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
