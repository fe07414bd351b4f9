"""Helpers shared by the operators: tables in the shared folder, batching of Arrow texts, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


#: Bytes of an Arrow batch between Spark and a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless the caller has set a bound.

    Each task holds a few batches outside the heap on the JVM's side and again in its worker; Spark's own bound is 64 MB.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
#: Tables in the shared folder that may still be read, in the order written.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of this machine (``local[n]``, tests) gets a temporary
    folder; any other is refused, because its executors would write to their own disks.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="palaver-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder; it is deleted by :func:`clear`, or when the driver's Python ends."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/palaver/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return stored(spark, path, df.schema)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that was written to a place of :func:`new_path`."""
    df = spark.read.schema(schema).parquet(path)
    df.__dict__["_palaver_path"] = path
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _delete(path: str, spark: SparkSession) -> None:
    _WRITTEN.pop(path, None)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(where, True)


def discard(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = df.__dict__.get("_palaver_path") if df is not None else None
    if path:
        _delete(path, df.sparkSession)


def clear() -> None:
    """Delete all intermediate tables; DataFrames that operators have returned and not yet run can't be run afterwards."""
    for path, spark in list(_WRITTEN.items()):
        _delete(path, spark)


@contextlib.contextmanager
def scratch():
    """Delete the intermediate tables written inside when the block ends: what it returns must have been stored by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path, spark in [x for x in _WRITTEN.items() if x[0] not in before]:
            _delete(path, spark)


@atexit.register
def _clear_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        clear()


# ---------------------------------------------------------------- what a Python worker keeps between tasks

_STATE: dict[tuple, object] = {}


def worker_state(owner: str, key, make):
    """``make()``, kept in this Python worker until another owner or key is asked for.

    Workers are reused by the stages of a job; what the stage before kept goes first, and its memory back to the system.
    """
    if (owner, key) not in _STATE:
        if _STATE:
            _STATE.clear()
            release()
        _STATE[owner, key] = make()
    return _STATE[owner, key]


def release() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- joins with a table of keys

#: A key with more than this share of the rows is heavy; there are fewer than 1 / share of them, whatever the input.
HEAVY = 1000


def look_up(rows: DataFrame, keys: DataFrame, on: list[str], copies: str) -> DataFrame:
    """``rows`` inner joined with ``keys`` (unique in ``on``); ``copies`` is the number of rows with a key.

    Heavy keys are fewer than ``HEAVY``, so they are broadcast and their rows stay where they are; all others are joined by a
    shuffle in which no key has more than a thousandth of the rows.  ``rows`` is read twice.
    """
    total = keys.agg(F.sum(copies)).first()[0] or 0
    heavy = F.col(copies) * F.lit(HEAVY) > F.lit(total)
    few = F.broadcast(keys.where(heavy).drop(copies))
    return rows.join(few, on).unionByName(rows.join(F.broadcast(keys.where(heavy).select(*on)), on, "left_anti").join(keys.where(~heavy).drop(copies), on))


def crc_mod(column: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


# ---------------------------------------------------------------- Arrow texts


def text_runs(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20):
    """Yield (first row, offsets, bytes) for runs of rows of at most ``limit`` bytes, or one longer row.

    ``offsets`` has one entry more than the run has rows; nulls are empty rows.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if chunk.type not in (pa.string(), pa.large_string()):
            chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if n:
            buffers = chunk.buffers()
            offsets = np.frombuffer(buffers[1], np.int32 if chunk.type == pa.string() else np.int64)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
                yield base + i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                i = j
        base += n


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=U64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes whose powers are tabled; longer runs repeat the table.
PERIOD = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(PERIOD, base, U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i before each place (one entry more than values)."""
    up, _ = _powers()
    out = np.zeros(len(values) + 1, U64)
    out[1:] = values
    for k, at in enumerate(range(0, len(values), PERIOD)):
        part = out[1 + at : 1 + at + PERIOD]
        part *= up[: len(part)]
        if k:
            part *= U64(pow(_BASE, at, 1 << 64))
    return np.cumsum(out, out=out)


def powers_down(at: np.ndarray) -> np.ndarray:
    """base**-i for each place."""
    _, down = _powers()
    if not len(at) or int(at.max()) < PERIOD:
        return down[at]
    far = np.array([pow(_INVERSE, int(k) * PERIOD, 1 << 64) for k in range(int(at.max()) // PERIOD + 1)], U64)
    return down[at % PERIOD] * far[at // PERIOD]


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of rows, A-Z lower-cased.

    Returns the 64-bit hash of each word, its first byte, the byte after it, and the number of words before
    each row (one entry more than rows).  Words never cross rows.  A long run is hashed in parts that end at white space,
    so memory beyond the words themselves is that of a part, or of the longest word.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if n <= 2 * PERIOD:
        hashes, first, end = _hash_words(offsets, data)
    else:
        parts, a = [], 0
        while a < n:
            b = min(a + PERIOD, n)
            while b < n:  # the next white space
                gap = np.flatnonzero(_SPACE[data[b : b + 4096]])
                b = b + int(gap[0]) if len(gap) else min(b + 4096, n)
                if len(gap):
                    break
            inside = offsets[(offsets > a) & (offsets < b)] - a
            h, x, y = _hash_words(inside, data[a:b])
            parts.append((h, x + a, y + a))
            a = b
        hashes, first, end = (np.concatenate(c) for c in zip(*parts, strict=True))
    return hashes, first, end, np.searchsorted(first, offsets)


def _hash_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = prefix_sums(_BYTE[data])
    return mix((total[last + 1] - total[first]) * powers_down(first)), first, last + 1


# ---------------------------------------------------------------- prefilters by a bitmap of keys

#: Bits of a key bitmap: sixteen for each key, at least and at most these (128 MB); a fuller one only filters less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30


class KeyBits:
    """A bitmap of the hashes of keys: tells for certain that a key is absent, and mostly that it is present.

    It replaces the shuffle of a wide table for the sake of few of its rows: rows whose bit is clear never leave the
    scan.  Executors build it; its size is bounded, and an exact join afterwards takes care of the false positives.
    """

    def __init__(self, keys: DataFrame, column: str, hashed: bool = False):
        spark = keys.sparkSession
        self.hashed = hashed  # the keys are random numbers already
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
        at = self.place(column) + 1
        parts = keys.where(F.col(column).isNotNull()).select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
        table = np.zeros(self.bits // 8, np.uint8)
        for r in parts:
            part = np.frombuffer(bytes(r.m), np.uint8)
            table[(r.n - 1) * 4096 : r.n * 4096] = part[: len(table) - (r.n - 1) * 4096]
        self.sent = spark.sparkContext.broadcast(table)

    def place(self, column: str):
        return F.pmod(F.col(column) if self.hashed else F.xxhash64(column), F.lit(self.bits))

    def maybe(self, df: DataFrame, column: str, present: bool = True, then=None, schema=None) -> DataFrame:
        """Rows of ``df`` whose key may be among the keys; with ``present=False`` the others, null keys included.

        ``then`` is a function of batches that is applied to these rows in the same worker and yields ``schema``.
        """
        sent, n = self.sent, len(df.columns)

        def rows(batches):
            table = sent.value
            for batch in batches:
                at = batch.column(n).fill_null(0).to_numpy(zero_copy_only=False)
                hit = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & np.asarray(batch.column(n).is_valid())
                kept = batch.select(list(range(n))).filter(pa.array(hit if present else ~hit))
                if kept.num_rows:
                    yield kept

        flagged = df.withColumn("_palaver_bit", F.when(F.col(column).isNotNull(), self.place(column)))
        return flagged.mapInArrow(rows if then is None else lambda batches: then(rows(batches)), schema or df.schema)
