"""Operator 9: MinHash near-duplicates.

A document is the set of its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer
than five words: the whole sequence is one shingle).  Texts of equal sets form one class first, so that copies cost
one representative.  128 universal hash minima per class are cut into 32 bands of 4; classes that share a band are
candidates, the agreement of their signatures drops the hopeless ones, and the full sets confirm the rest:
100 * intersection >= 75 * union.  A pair at exactly 0.75 shares no band with probability
(1 - 0.75**4)**32 = 5e-6.

Inside a band's bucket no pairs are expanded.  First every class is held against the bucket's smallest class; the
confirmed links give provisional components (large-star and small-star).  Only buckets that then still hold more than
one component are looked at again: their classes outside the bucket's main component are held against those of
other components.  Candidates inside one component can't change it, so the result is that of all pairs.  This second
look takes blocks of about ``BLOCK`` classes at a time and counts the shared shingles of two blocks by a matrix
product; only pairs that may reach the threshold leave a task.

Classes that hold more than a thousandth of all rows are broadcast to their rows, and so are bands; no key gathers more.

Cases: null and empty texts and texts without words have an empty set, link with nothing and are kept; rows without a
doc_id have a set size, no component and are not kept, since nothing names them; rows that repeat a doc_id are one
document with several texts: it links with whatever one of them links with, and each row has its own set size; ties don't
arise, since doc_ids name components; very long texts are hashed in parts, only their sets are held whole; an empty table gives
an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.components import components
from palaver.llm.shared import U64, KeyBits, discard, look_up, materialize, mix, table, text_runs, word_hashes, worker_state

WORDS, BANDS, ROWS = 5, 32, 4
SIMILARITY = (75, 100)
#: Classes, and members of their sets, that a block of the second look holds at most on average.
BLOCK, BLOCK_MEMBERS = 256, 400_000
_RNG = np.random.default_rng(977)
_TIMES = _RNG.integers(0, 1 << 63, WORDS, dtype=U64) * U64(2) + U64(1)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=U64)
_BAND = _RNG.integers(0, 1 << 63, ROWS, dtype=U64) * U64(2) + U64(1)
_SALT = mix(np.arange(1, BANDS + 1, dtype=U64))


def shingle_sets(column):
    """Yield the sorted distinct shingle hashes of each row of an Arrow column of texts, in order."""
    for _, offsets, data in text_runs(column):
        words, _, _, at = word_hashes(offsets, data)
        n = len(words)
        shingles = np.zeros(n, U64)
        if n >= WORDS:
            total = np.zeros(n - WORDS + 1, U64)
            for t in range(WORDS):
                total += words[t : n - WORDS + 1 + t] * _TIMES[t]
            shingles[: n - WORDS + 1] = mix(total)
        for r in range(len(offsets) - 1):
            i, j = int(at[r]), int(at[r + 1])
            if j - i >= WORDS:
                yield np.unique(shingles[i : j - WORDS + 1])
            elif j > i:
                yield mix(np.array([(words[i:j] * _TIMES[: j - i]).sum(dtype=U64) + U64(j - i)], U64))
            else:
                yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes a * x + b, high halves."""
    least = None
    for i in range(0, len(shingles), 256):
        block = (_A[:, None] * shingles[None, i : i + 256] + _B[:, None]).min(axis=1)
        least = block if least is None else np.minimum(least, block)
    return (least >> U64(32)).astype(np.uint32)


def _sign(batches):
    worker_state("minhash", 0, dict)
    for batch in batches:
        high, low, sizes, signs, bands = [], [], [], [], []
        for x in shingle_sets(batch.column(1)):
            sizes.append(len(x))
            if len(x):
                # the set's own name: two sums of differently mixed members and their number
                high.append(int(mix(x).sum(dtype=U64).view(np.int64)))
                low.append(int((mix(x ^ _SALT[0]) * _TIMES[0]).sum(dtype=U64).view(np.int64)) + 0)
                s = signature(x)
                signs.append(s.tobytes())
                keys = mix((s.astype(U64).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=U64) ^ _SALT)
                bands.append(keys.view(np.int64))
            else:
                high.append(None), low.append(None), signs.append(None), bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
        )


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1))], pa.large_binary()).cast(pa.binary())], ["doc_id", "members"])


def _confirm(batches):
    """Keep pairs whose signatures agree enough and whose full sets pass the threshold."""
    over, under = SIMILARITY
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U64) for v in (a, b))
            if len(x) > len(y):
                x, y = y, x
            if under * len(x) < over * len(y):
                keep.append(False)
                continue
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(under * shared >= over * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


#: Agreeing minima below which a pair at the threshold falls once in more than ten million (mean 96, deviation 4.9).
LEAST_AGREEING = 68


def _agree(batches):
    for batch in batches:
        keep = [int((np.frombuffer(a.as_buffer(), np.uint32) == np.frombuffer(b.as_buffer(), np.uint32)).sum()) >= LEAST_AGREEING for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, signed: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """Confirmed pairs (a, b) of candidates (a, b)."""
    pairs = materialize(pairs, f"{tag}-pairs")
    ids = lambda p: p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct()
    signs = KeyBits(ids(pairs), "doc_id").maybe(signed.select("doc_id", "sig"), "doc_id")
    likely = materialize(pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(signs.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(_agree, "a bigint, b bigint").distinct(), f"{tag}-likely")
    sets = materialize(KeyBits(ids(likely), "doc_id").maybe(docs.select("doc_id", "text"), "doc_id", then=_sets, schema="doc_id bigint, members binary"), f"{tag}-sets")
    held = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    links = materialize(held.mapInArrow(_confirm, "a bigint, b bigint").distinct(), f"{tag}-links")
    for done in (pairs, likely, sets):
        discard(done)
    return links


def _shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets in ``x`` with all in ``y``."""
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint32) for s in (x, y)]
    row = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), np.float32)
    at = [np.searchsorted(both, f) for f in flat]
    if not len(both):
        return out
    hit = [both[np.minimum(k, len(both) - 1)] == f for k, f in zip(at, flat, strict=True)]
    at = [k[h] for k, h in zip(at, hit, strict=True)]
    row = [r[h] for r, h in zip(row, hit, strict=True)]
    for low in range(0, len(both), width):
        parts = []
        for k, r, s in zip(at, row, (x, y), strict=True):
            inside = (k >= low) & (k < low + width)
            m = np.zeros((len(s), min(width, len(both) - low)), np.float32)
            m[r[inside], k[inside] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _compare_blocks(batches):
    """Pairs of classes of two blocks, in different components, whose shortened sets may reach the threshold."""
    over, under = SIMILARITY
    for batch in batches:
        found_a, found_b = [], []
        for r in range(batch.num_rows):
            sides = []
            for k in (0, 1):
                block = batch.column(k)[r].values
                sets = [np.frombuffer(v.as_buffer(), np.uint32) for v in block.field("members")]
                sides.append([block.field(name).to_numpy(zero_copy_only=False) for name in ("doc_id", "component")] + [np.array([len(v) for v in sets], np.int64), sets])
            (ids, parts, sizes, x), (ids2, parts2, sizes2, y) = sides
            # shared members with equal upper halves count once: at most as often as either set's own collide
            lost, lost2 = (np.array([len(v) - len(np.unique(v)) for v in sets], np.int64) for sets in (x, y))
            shared = _shared(x, y).astype(np.int64) + np.minimum(lost[:, None], lost2[None, :])
            good = (parts[:, None] != parts2[None, :]) & (under * shared >= over * (sizes[:, None] + sizes2[None, :] - shared))
            i, j = np.nonzero(good)
            found_a.append(np.minimum(ids[i], ids2[j]))
            found_b.append(np.maximum(ids[i], ids2[j]))
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a), pa.int64()), pa.array(np.concatenate(found_b), pa.int64())], ["a", "b"])


def _short_sets(batches):
    """Sets cut to 32 bits a member, collisions kept: the full sets settle what agrees by chance or is granted for them."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(x >> U64(32)).astype(np.uint32).tobytes() for x in shingle_sets(batch.column(1))], pa.binary())], ["doc_id", "members"])


def _second_look(settled: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates (a, b) in different components among rows (band, doc_id, component) that share a band."""
    sized = settled.join(sizes, "doc_id")
    open_bands = sized.groupBy("band").agg(F.min("component").alias("main"), F.max("component").alias("other"), F.count("*").alias("n"), F.sum("n_shingles").alias("m")).where("main < other")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_MEMBERS)).cast("bigint")
    open_bands = materialize(open_bands.select("band", "main", "n", parts.alias("parts")), "open-bands")
    still = materialize(look_up(settled, open_bands, ["band"], "n").select("band", "doc_id", "component", (F.col("component") == F.col("main")).alias("is_main"), F.pmod(F.xxhash64("doc_id"), "parts").alias("part")), "open")
    sets = materialize(KeyBits(still.select("doc_id").distinct(), "doc_id").maybe(docs, "doc_id", then=_short_sets, schema="doc_id bigint, members binary"), "open-sets")
    blocks = materialize(still.join(sets, "doc_id").groupBy("band", "is_main", "part").agg(F.collect_list(F.struct("doc_id", "component", "members")).alias("block")), "blocks")
    x = blocks.where("not is_main").select("band", F.col("part").alias("px"), F.col("block").alias("x"))
    y = blocks.select("band", "is_main", F.col("part").alias("py"), F.col("block").alias("y"))
    pairs = x.join(y, "band").where("is_main or px <= py").select("x", "y").mapInArrow(_compare_blocks, "a bigint, b bigint")
    out = materialize(pairs.distinct(), "second")
    for done in (open_bands, still, sets, blocks):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = ["h1", "h2", "n_shingles"]
    every = materialize(docs.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary, bands array<bigint>"), "signed")
    signed = every.where("n_shingles > 0 and doc_id is not null")
    again = None
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        # equal texts under one doc_id count once; different ones are classes of their own
        again = [materialize(signed.dropDuplicates(["doc_id", *key]), "signed-once"), materialize(docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]), "texts-once")]
        docs = again[1]
    once = signed if again is None else again[0]
    classes = materialize(signed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = materialize(look_up(signed.select("doc_id", *key), classes, key, "copies").select("doc_id", "n_shingles", "rep"), "member")
    # one row of each class, under the name of its smallest doc_id
    first = once.join(classes.select(*key, F.col("rep").alias("doc_id")), ["doc_id", *key], "left_semi")
    banded = materialize(first.select("doc_id", F.explode("bands").alias("band")), "bands")
    discard(classes)
    shared = materialize(banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("band", "least", "n"), "shared")
    hits = materialize(KeyBits(shared, "band", hashed=True).maybe(banded, "band"), "band-hits")
    discard(banded)
    crowded = materialize(look_up(hits, shared, ["band"], "n"), "crowded")
    discard(hits)
    links = _verify(crowded.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), once, docs, "first")
    if again is not None:
        # the texts of a document belong together
        several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
        links = links.unionByName(member.join(several, "doc_id").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    found = components(links, "a", "b")
    settled = materialize(crowded.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")).distinct(), "settled")
    likely = _second_look(settled, docs, member.where("doc_id = rep").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")))
    more = likely if likely.isEmpty() else _verify(likely, once, docs, "second")
    if more.isEmpty():
        final = found
    else:
        final = components(links.unionByName(more), "a", "b")
    for done in (crowded, settled, shared, *(again or ())):
        discard(done)
    named = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    if again is not None:
        # a text without words has the component of the document's other texts
        of = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        empty = every.where("n_shingles = 0").select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    else:
        empty = every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = every.where("n_shingles > 0 and doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return named.unionByName(empty).unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
