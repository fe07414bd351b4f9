"""Operator 11: hard-negative mining by inner product over a pivot table.

Components become integers, and a row gets one more component that brings all rows to one length; anchors get a zero there.
Then the inner product of an anchor and a row falls as their Euclidean distance grows, and the distances of both from a few
pivots, which a table keeps for every row, bracket it by the triangle inequality: |d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) +
d(x, p).

* Rows are sorted by label, nearest pivot and distance from it, and cut into blocks; so are the anchors.  Blocks and intervals of
  ``FAN`` to the power of k blocks keep the least and greatest distance from each pivot.  The two sequences are joined
  by recursion: a pair of intervals is only taken apart while its bracket can hold a wanted score.
* Anchors travel to the blocks of rows.  There whole blocks are spared for single anchors, single rows by their own
  distances, and what survives is scored exactly in integers.
* Positives come first: an anchor starts with the last of the places it could fill from its own block.  A positive's
  window of scores then is what negatives are looked for in.  A task sends no more than the wanted number for each anchor and
  block, and ranks are taken in windows that Spark limits before their shuffle.

The pivots come from a bounded sample of ``SAMPLE`` vectors of a length; they steer the work, and no result depends on them.

Cases: rows with a null label, vector or id, or with null or non-finite components, take no part; vectors of different lengths
never meet; zero and empty vectors take part, with scores of 0; rows that repeat a vec_id are rows of their own, each an anchor
if the id is, and one may be the positive of the other; ties go to the smaller vec_id; vectors whose integers are so large that
an inner product may not fit 62 bits are an error; an empty table gives an empty table; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.shared import materialize, table, worker_state

POSITIVES, NEGATIVES = 5, 3
#: Of a positive's score, in percent: the least and the greatest score of its negatives.
LOW, HIGH = 50, 95
PIVOTS, SAMPLE = 12, 4_000
#: Rows and anchors of a block, blocks of an interval.
BLOCK, ANCHORS, FAN = 2048, 512, 8
GRID = 256
NONE = np.iinfo(np.int64).min
LARGE = 2.0**62

_INTEGERS = "uid bigint, vec_id bigint, label string, anchor boolean, dim int, norm double, q binary"
_MEASURED = _INTEGERS + ", dist binary, asked binary, home int, near double"
_BLOCKS = "part int, nth bigint, dim int, least string, most string, uids binary, ids binary, labels array<string>, vectors binary, dists binary, asks binary, norms binary, lo array<double>, hi array<double>, norm_lo double, norm_hi double, anchors array<boolean>, lows binary, highs binary, want bigint, cap bigint"


def _integers(batches):
    """Vectors on the integer grid."""
    for batch in batches:
        column = batch.column(4)
        sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        values = column.flatten()
        flat = np.floor(GRID * values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
        rows, norms, vectors = [], [], []
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            x = flat[a:b]
            if np.isfinite(x).all():
                with np.errstate(over="ignore"):
                    norm = float(x @ x)
                if norm >= LARGE:
                    raise ValueError("components are too large: an inner product may not fit 62 bits")
                rows.append(r)
                norms.append(norm)
                vectors.append(x.astype(np.int32).tobytes())
        kept = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(kept) for k in range(4)), pa.array(sizes[rows].astype(np.int32), pa.int32()), pa.array(norms, pa.float64()), pa.array(vectors, pa.binary())], ["uid", "vec_id", "label", "anchor", "dim", "norm", "q"])


def pivots(rows: DataFrame, most: int = SAMPLE, count: int = PIVOTS) -> dict[int, tuple[float, np.ndarray]]:
    """For each length of vectors: the greatest squared norm, and pivots of a bounded sample, each far from those before it (augmented by one component)."""
    sizes = {r.dim: (r.n, r.m) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("m")).collect()}
    out = {}
    for dim, (n, m) in sizes.items():
        share = min(1.0, most / n)
        sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("uid", "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("q", "norm").limit(2 * most).collect()
        x = np.zeros((max(1, len(sample)), dim + 1))
        for k, r in enumerate(sample):
            x[k, :dim] = np.frombuffer(r.q, np.int32)
            x[k, dim] = np.sqrt(max(0.0, m - r.norm))
        at = [int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
        far = ((x - x[at[0]]) ** 2).sum(axis=1)
        while len(at) < count:
            at.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        out[dim] = m, x[at]
    return out


def _distances(q: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of vectors with their last components from each pivot."""
    square = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] + (last * last)[:, None] - 2 * (q @ p[:, :-1].T) - 2 * last[:, None] * p[None, :, -1]
    return np.sqrt(np.maximum(square, 0))


def _measured(sent):
    def run(batches):
        worker_state("negatives", 0, dict)
        for batch in batches:
            dims = np.asarray(batch.column(4))
            norms = np.asarray(batch.column(5))
            raw = batch.column(6).to_pylist()
            dist, asked = [b""] * len(dims), [b""] * len(dims)
            home, near = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                m, p = sent.value[dim]
                at = np.flatnonzero(dims == dim)
                q = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.int32).reshape(len(at), dim).astype(np.float64)
                d = _distances(q, np.sqrt(np.maximum(m - norms[at], 0)), p)
                a = _distances(q, np.zeros(len(at)), p)
                home[at], near[at] = d.argmin(axis=1), d.min(axis=1)
                for k, i in enumerate(at.tolist()):
                    dist[i], asked[i] = d[k].tobytes(), a[k].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist, pa.binary()), pa.array(asked, pa.binary()), pa.array(home), pa.array(near)], [*batch.schema.names, "dist", "asked", "home", "near"])

    return run


def _blocks(rows: DataFrame, size: int, by: str, tag: str) -> tuple[DataFrame, int]:
    """Blocks of rows in the order of label, nearest pivot and distance, numbered through; their number.

    by: the distances (of rows or of anchors) whose least and greatest a block keeps.
    """
    spark = rows.sparkSession
    order = ["dim", "label", "home", "near", "vec_id", "uid"]
    wanted = ["lows", "highs"] if "lows" in rows.columns else []
    ordered = rows.select(*order, "anchor", "norm", "q", "dist", "asked", *wanted).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        held: list[tuple] = []
        nth = 0

        def block():
            dims, labels, _, _, ids, uids, anchors, norms, q, dist, asked, *want = zip(*held, strict=True)
            d = np.frombuffer(b"".join(dist if by == "dist" else asked)).reshape(len(held), -1)
            lows = np.array([w for x in want[:1] for w in x], np.int64).reshape(len(held), -1)
            highs = np.array([w for x in want[1:] for w in x], np.int64).reshape(len(held), -1)
            open_ = lows[lows <= highs]
            one = {
                "part": 0, "nth": nth, "dim": dims[0], "least": labels[0], "most": labels[-1], "uids": np.array(uids, np.int64).tobytes(), "ids": np.array(ids, np.int64).tobytes(), "labels": list(labels), "vectors": b"".join(q), "dists": b"".join(dist), "asks": b"".join(asked),
                "norms": np.array(norms).tobytes(), "lo": d.min(axis=0).tolist(), "hi": d.max(axis=0).tolist(), "norm_lo": min(norms), "norm_hi": max(norms), "anchors": list(anchors), "lows": lows.tobytes(), "highs": highs.tobytes(), "want": int(open_.min()) if len(open_) else None, "cap": int(highs[lows <= highs].max()) if len(open_) else None,
            }
            return pa.RecordBatch.from_pylist([one], schema)

        schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("dim", pa.int32()), ("least", pa.string()), ("most", pa.string()), ("uids", pa.binary()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("dists", pa.binary()), ("asks", pa.binary()), ("norms", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("norm_lo", pa.float64()), ("norm_hi", pa.float64()), ("anchors", pa.list_(pa.bool_())), ("lows", pa.binary()), ("highs", pa.binary()), ("want", pa.int64()), ("cap", pa.int64())])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= size):
                    yield block()
                    held.clear()
                    nth += 1
                held.append(row)
        if held:
            yield block()

    found = materialize(ordered.mapInArrow(cut, _BLOCKS).withColumn("part", F.spark_partition_id()), tag)
    before, total = [], 0
    for r in sorted(found.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before.append((r.part, total))
        total += r.n
    if not total:
        return found.withColumn("block", F.col("nth")), 0
    offsets = spark.createDataFrame(before, "part int, before bigint")
    return found.join(F.broadcast(offsets), "part").withColumn("block", F.col("before") + F.col("nth")).drop("part", "nth", "before"), total


def _pairs(anchors: DataFrame, n_anchors: int, rows: DataFrame, n_rows: int, norms: DataFrame, same: bool) -> DataFrame:
    """(a, b): blocks of anchors and of rows whose brackets may hold a wanted score, and whose labels may be equal (or may differ)."""
    spans = [f(f"{side}{j}").alias(f"{side}{j}") for j in range(PIVOTS) for side, f in (("lo", F.min), ("hi", F.max))]
    flat = [F.col(side)[j].alias(f"{side}{j}") for j in range(PIVOTS) for side in ("lo", "hi")]
    ends = [F.min("dim0").alias("dim0"), F.max("dim1").alias("dim1"), F.min("least").alias("least"), F.max("most").alias("most")]
    a_ends = [F.min("norm_lo").alias("norm_lo"), F.max("norm_hi").alias("norm_hi"), F.min("want").alias("want"), F.max("cap").alias("cap")]
    r_ends = [F.min("m0").alias("m0"), F.max("m1").alias("m1")]
    box = ["block", F.col("dim").alias("dim0"), F.col("dim").alias("dim1"), "least", "most", *flat]
    a_levels = [anchors.where("want is not null").select(*box, "norm_lo", "norm_hi", "want", "cap")]
    r_levels = [rows.join(F.broadcast(norms), "dim").select(*box, F.col("m").alias("m0"), F.col("m").alias("m1"))]
    while n_anchors > 1 or n_rows > 1:
        n_anchors, n_rows = -(-n_anchors // FAN), -(-n_rows // FAN)
        for levels, more in ((a_levels, a_ends), (r_levels, r_ends)):
            levels.append(levels[-1].withColumn("block", F.expr(f"block div {FAN}")).groupBy("block").agg(*ends, *more, *spans))
    gap = "greatest(0D, " + ", ".join(f"y.lo{j} - x.hi{j}, x.lo{j} - y.hi{j}" for j in range(PIVOTS)) + ")"
    reach = "least(" + ", ".join(f"x.hi{j} + y.hi{j}" for j in range(PIVOTS)) + ")"
    slack = "(1e-6D * (x.norm_hi + y.m1) + 1D)"
    held = f"x.dim0 <= y.dim1 and y.dim0 <= x.dim1 and (x.norm_hi + y.m1 - pow({gap}, 2)) / 2 + {slack} >= x.want and (x.norm_lo + y.m0 - pow({reach}, 2)) / 2 - {slack} <= x.cap"
    held += " and x.least <= y.most and y.least <= x.most" if same else " and not (x.least = x.most and y.least = y.most and x.least = y.least)"
    pairs = a_levels[-1].select(F.col("block").alias("a")).join(r_levels[-1].select(F.col("block").alias("b")), F.col("a") == F.col("b"))  # both are 0
    for xs, ys in zip(reversed(a_levels[:-1]), reversed(r_levels[:-1]), strict=True):
        xs, ys = xs.withColumn("of", F.expr(f"block div {FAN}")), ys.withColumn("of", F.expr(f"block div {FAN}"))
        pairs = pairs.join(xs.alias("x"), F.col("a") == F.col("x.of")).join(ys.alias("y"), F.col("b") == F.col("y.of")).where(held).select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    return pairs


def scores(a: np.ndarray, x: np.ndarray, keep: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of the pairs to keep; ``NONE`` elsewhere.  largest: the product of the greatest norms."""
    out = np.full(keep.shape, NONE, np.int64)
    if keep.mean() < 0.1:
        i, j = np.nonzero(keep)
        for k in range(0, len(i), 1 << 15):
            s, t = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            out[s, t] = (a[s].astype(np.int64) * x[t].astype(np.int64)).sum(axis=1)
    elif largest < 2.0**52:  # every partial sum is an integer that doubles hold
        out[keep] = np.rint(a.astype(np.float64) @ x.astype(np.float64).T)[keep].astype(np.int64)
    else:
        out[keep] = (a.astype(np.int64) @ x.astype(np.int64).T)[keep]
    return out


def first(found: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` scores of each row, higher ones first, then smaller ids."""
    n = found.shape[1]
    least = np.partition(found, n - most, axis=1)[:, n - most] if n > most else np.full(len(found), NONE)
    i, j = np.nonzero((found > NONE) & (found >= least[:, None]))
    order = np.lexsort((ids[j], -found[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < most], j[place < most]


def _codes(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    names: dict = {}
    both = [np.array([names.setdefault(x, len(names)) for x in side], np.int64) for side in (left, right)]
    return both[0], both[1]


_FOUND = "auid bigint, anchor_id bigint, slot int, uid bigint, vec_id bigint, score bigint"


def _found_batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    columns[2] = columns[2].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["auid", "anchor_id", "slot", "uid", "vec_id", "score"])


def _hold(m: float, dim: int, a: dict, r: dict, same: bool, most: int) -> list[tuple]:
    """What a block of anchors finds in a block of rows, for each of the anchors' windows (lows, highs) its first ``most``."""
    ints = lambda x: np.frombuffer(x, np.int64)
    at = np.frombuffer(a["norms"])
    lows, highs = (ints(a[k]).reshape(len(at), -1) for k in ("lows", "highs"))
    ask, dist = np.frombuffer(a["asks"]).reshape(len(at), -1), np.frombuffer(r["dists"]).reshape(len(r["labels"]), -1)
    least, most_of = np.where(lows <= highs, lows, 1 << 62).min(axis=1), np.where(lows <= highs, highs, NONE).max(axis=1)
    slack = 1e-6 * (at + m) + 1
    # the block as a whole, for each anchor
    gap = np.maximum(np.maximum(dist.min(axis=0) - ask, ask - dist.max(axis=0)), 0).max(axis=1)
    reach = (ask + dist.max(axis=0)).min(axis=1)
    asking = np.flatnonzero(((at + m - gap * gap) / 2 + slack >= least) & ((at + m - reach * reach) / 2 - slack <= most_of))
    if not len(asking):
        return []
    left, right = _codes([a["labels"][k] for k in asking.tolist()], r["labels"])
    keep = (left[:, None] == right[None, :]) == same
    ids, uids = ints(r["ids"]), ints(r["uids"])
    own = ints(a["uids"])[asking]
    keep &= own[:, None] != uids[None, :]
    # single rows by their distances from the pivots
    gap, reach = np.zeros(keep.shape), np.full(keep.shape, np.inf)
    for j in range(dist.shape[1]):
        np.maximum(gap, np.abs(ask[asking, j][:, None] - dist[None, :, j]), out=gap)
        np.minimum(reach, ask[asking, j][:, None] + dist[None, :, j], out=reach)
    top = (at[asking] + m)[:, None]
    keep &= ((top - gap * gap) / 2 + slack[asking, None] >= least[asking, None]) & ((top - reach * reach) / 2 - slack[asking, None] <= most_of[asking, None])
    q = np.frombuffer(a["vectors"], np.int32).reshape(len(at), dim)[asking]
    x = np.frombuffer(r["vectors"], np.int32).reshape(len(ids), dim)
    found = scores(q, x, keep, float(np.sqrt(at.max() * np.frombuffer(r["norms"]).max())))
    out = []
    for k in range(lows.shape[1]):
        low, high = lows[asking, k][:, None], highs[asking, k][:, None]
        i, j = first(np.where((found >= low) & (found <= high), found, NONE), ids, most)
        out.append((own[i], ints(a["ids"])[asking][i], np.full(len(i), k), uids[j], ids[j], found[i, j]))
    return out


_SIDE = ["labels", "uids", "ids", "norms", "vectors"]


def _search(sent, anchors: DataFrame, n_anchors: int, rows: DataFrame, n_rows: int, norms: DataFrame, same: bool, most: int) -> DataFrame:
    """(auid, anchor_id, slot, uid, vec_id, score): of each pair of blocks the first ``most`` for each anchor and window."""
    pairs = materialize(_pairs(anchors, n_anchors, rows, n_rows, norms, same), "pivot-pairs")
    a_side = [*_SIDE, "asks", "lows", "highs"]
    left = anchors.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in a_side])
    right = rows.select(F.col("block").alias("b"), "dim", *_SIDE, "dists")

    def run(batches):
        worker_state("negatives", 0, dict)
        for batch in batches:
            parts = []
            for row in batch.to_pylist():
                m, _ = sent.value[row["dim"]]
                parts += _hold(m, row["dim"], {c: row[f"a_{c}"] for c in a_side}, row, same, most)
            yield _found_batch(parts)

    return pairs.join(left, "a").join(right, "b").select("dim", *_SIDE, "dists", *[f"a_{c}" for c in a_side]).mapInArrow(run, _FOUND)


def _starts(rows: DataFrame, most: int) -> DataFrame:
    """(auid, start): for anchors whose own block has enough rows of their label, the last score of those they would take there."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, flags = len(row["labels"]), np.array(row["anchors"], bool)
                if not flags.any():
                    continue
                x = np.frombuffer(row["vectors"], np.int32).reshape(n, row["dim"])
                codes, _ = _codes(row["labels"], [])
                at = np.flatnonzero(flags)
                keep = codes[at][:, None] == codes[None, :]
                keep[np.arange(len(at)), at] = False
                found = scores(x[at], x, keep, float(np.frombuffer(row["norms"]).max()))
                if n > most:
                    last = np.partition(found, n - most, axis=1)[:, n - most]
                    uids = np.frombuffer(row["uids"], np.int64)[at]
                    out += [(u, s) for u, s in zip(uids.tolist(), last.tolist(), strict=True) if s > NONE]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["auid", "start"])

    return rows.mapInArrow(run, "auid bigint, start bigint")


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among the rows.

    An anchor's positives are its first other rows of the same label, a positive's negatives the first rows of other labels whose
    scores lie between ``LOW`` and ``HIGH`` percent of the positive's.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(read.where("vec_id is not null and label is not null and v is not null").mapInArrow(_integers, _INTEGERS), "integers")
    fitted = pivots(rows)
    sent = spark.sparkContext.broadcast(fitted)
    norms = spark.createDataFrame([(d, m) for d, (m, _) in fitted.items()], "dim int, m double")
    measured = materialize(rows.mapInArrow(_measured(sent), _MEASURED), "pivot-table")
    blocks, n_rows = _blocks(measured, BLOCK, "dist", "pivot-rows")
    asking = measured.where("anchor")
    # where an anchor starts: the score that it has to reach for a place among its positives
    starts = _starts(blocks.select("labels", "anchors", "uids", "norms", "vectors", "dim"), positives)
    a_rows = asking.join(starts.withColumnRenamed("auid", "uid"), "uid", "left")
    a_rows = a_rows.withColumn("lows", F.array(F.coalesce("start", F.lit(-(1 << 62))))).withColumn("highs", F.array(F.lit(1 << 62)))
    a_blocks, n_anchors = _blocks(a_rows, ANCHORS, "asked", "pivot-anchors")
    near = _ranked(_search(sent, a_blocks, n_anchors, blocks, n_rows, norms, True, positives), ["auid"], positives)
    near = materialize(near.select("auid", "anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a positive's window, in whole numbers; negative scores have none
    window = near.withColumn("low", F.ceil(F.col("positive_score").cast("decimal(20,0)") * LOW / 100).cast("bigint")).withColumn("high", F.floor(F.col("positive_score").cast("decimal(20,0)") * HIGH / 100).cast("bigint"))
    per = window.groupBy("auid").agg(*[F.coalesce(F.max(F.when(F.col("slot") == k + 1, F.col(c))), F.lit(none)).alias(f"{c}{k}") for k in range(positives) for c, none in (("low", 1), ("high", 0))])
    w_rows = asking.join(per.withColumnRenamed("auid", "uid"), "uid").withColumn("lows", F.array(*[f"low{k}" for k in range(positives)])).withColumn("highs", F.array(*[f"high{k}" for k in range(positives)]))
    w_blocks, n_windows = _blocks(w_rows, ANCHORS, "asked", "pivot-windows")
    hard = _ranked(_search(sent, w_blocks, n_windows, blocks, n_rows, norms, False, negatives), ["auid", "slot"], negatives)
    hard = hard.select("auid", (F.col("slot") + 1).alias("slot"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(hard, ["auid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
