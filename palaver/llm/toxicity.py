"""Operator 2: toxicity by non-negative positive-unlabelled learning.

A linear NumPy classifier is learned from texts confirmed as toxic and from unlabelled text with the non-negative risk
estimator of Kiryo et al. (2017): pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1)), pi being the class prior, with the
sigmoid loss.  When the corrected negative risk falls below zero, the step goes the other way and undoes the overfit.

Features are hashed words and word beginnings of ``PREFIXES`` bytes (ASCII letters lower-cased); those whose document
frequency among the confirmed texts stands out most from that among the unlabelled ones are kept, and a text is the
set of those it holds.  Scores are sigmoids of the linear function and need nothing but the text.

What is learned from is bounded: about ``POSITIVES`` confirmed and ``UNLABELLED`` other texts by a hash of doc_id, never
held-out rows.  Scores cover every whole text.

Cases: null and empty texts have no features and get the score of the bias; labels that are null or refer to no
document are not used; several labels of a document count as toxic if one is; without any confirmed text every score
is 0; rows that repeat a doc_id are scored each by their own text; null doc_ids are scored too; ties don't arise; very
long texts are hashed in parts; further columns pass through ``score``, but for those named as its results, which are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import _BYTE, U64, KeyBits, crc_mod, mix, powers_down, prefix_sums, table, text_runs

POSITIVES, UNLABELLED = 2_000, 4_000
FEATURES = 1_024
BITS = 22
PREFIXES = (4, 5, 6, 7, 8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = mix(np.arange(1, 16, dtype=U64))


def features(offsets: np.ndarray, data: np.ndarray):
    """Yield (row of each feature, feature) arrays of a run of rows."""
    n = len(data)
    if not n:
        return
    word = _LETTER[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = prefix_sums(_BYTE[data])
    before, scale = total[first], powers_down(first)
    row = np.searchsorted(offsets, first, "right") - 1
    size = last - first + 1
    yield row, (mix((total[last + 1] - before) * scale + _KIND[0]) >> U64(64 - BITS)).astype(np.uint32)
    for k, length in enumerate(PREFIXES):
        long = size >= length
        at = first[long]
        yield row[long], (mix((total[at + length] - before[long]) * scale[long] + _KIND[k + 1]) >> U64(64 - BITS)).astype(np.uint32)


@dataclass
class Model:
    """Kept features, their weights and the bias."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        place = np.zeros(1 << BITS, np.int32)
        place[self.kept] = np.arange(1, len(self.kept) + 1)
        out = np.full(len(column), float(self.bias))
        for first, offsets, data in text_runs(column):
            keys = []
            for row, feature in features(offsets, data):
                at = place[feature]
                hit = at > 0
                keys.append(row[hit] * len(self.kept) + at[hit] - 1)
            if keys and len(self.kept):
                row, at = np.divmod(np.unique(np.concatenate(keys)), len(self.kept))
                n = len(offsets) - 1
                out[first : first + n] += np.bincount(row, self.weights[at], n)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int = FEATURES) -> np.ndarray:
    """Features whose document frequencies differ most, by the log-likelihood ratio, towards the positive side."""
    if not positive:
        return np.zeros(0, np.int64)
    p = np.bincount(np.concatenate(positive), minlength=1 << BITS).astype(float)
    u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.uint32)]).astype(np.int64), minlength=1 << BITS).astype(float)
    n, m = len(positive), max(1, len(unlabelled))
    q = (p + u) / (n + m)

    def part(k, total):
        x = k / total
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(x / q)) + np.nan_to_num((total - k) * np.log((1 - x) / (1 - q)))

    gain = 2 * (part(p, n) + part(u, m))
    gain[(p / n <= u / m) | (p < 3)] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(best[gain[best] > 12])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by the non-negative risk; rows are texts, columns kept features."""
    rng = np.random.default_rng(0)
    w, b = np.zeros(positive.shape[1], np.float32), -1.0
    m = v = np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        # half of each side at a time
        xp = positive[rng.random(len(positive)) < 0.5] if len(positive) > 20 else positive
        xu = unlabelled[rng.random(len(unlabelled)) < 0.5] if len(unlabelled) > 20 else unlabelled
        sp = 1 / (1 + np.exp(-np.clip(xp @ w + b, -40, 40)))
        su = 1 / (1 + np.exp(-np.clip(xu @ w + b, -40, 40)))
        # sigmoid loss: a text counted as positive costs 1 - s, as negative s
        slope_p, slope_u = sp * (1 - sp) / max(1, len(sp)), su * (1 - su) / max(1, len(su))
        negative = (su.mean() if len(su) else 0.0) - prior * sp.mean()
        towards = np.append(slope_p.astype(np.float32) @ xp, slope_p.sum()) * prior
        away = np.append(slope_u.astype(np.float32) @ xu, slope_u.sum()) - towards
        grad = away - towards if negative >= 0 else -away
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w.astype(float), float(b)


def _matrix(texts: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(kept)), np.float32)
    for i, x in enumerate(texts):
        at = np.searchsorted(kept, x)
        at = at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == x)] if len(kept) else at[:0]
        out[i, at] = 1
    return out


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A model of texts given as sorted distinct features."""
    kept = select(positive, unlabelled)
    if not positive:
        return Model(kept, np.zeros(0), -40.0)
    w, b = fit(_matrix(positive, kept), _matrix(unlabelled, kept), prior)
    return Model(kept, w, b)


def training_sets(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of confirmed and of unlabelled texts among ``docs`` (doc_id, text), and the class prior.

    The prior is the share of toxic documents among the labelled ones.  Known clean texts count as unlabelled.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = docs.select("doc_id").join(marks, "doc_id").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("bigint")).alias("k")).first()
    total = docs.where("text is not null").count()
    n, k = both.n, both.k or 0
    if not k:
        return [], [], 0.0
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    threshold = lambda most, of: F.lit(int((1 << 30) * min(1.0, most / max(1, of))))
    confirmed = marks.where("toxic = 1").select("doc_id")
    # neither side of the sample shuffles more than itself: a bitmap finds the confirmed texts, a hash the others
    some = docs.where(F.col("text").isNotNull()).select("doc_id", "text").withColumn("place", place)
    bad = KeyBits(confirmed, "doc_id").maybe(some.where(F.col("place") < threshold(positives, k)), "doc_id").join(confirmed, "doc_id", "left_semi")
    rest = some.where(F.col("place") < threshold(unlabelled, total - k)).join(confirmed, "doc_id", "left_anti")
    sample = bad.select("place", F.lit(1).alias("toxic"), "text").unionByName(rest.select("place", F.lit(0).alias("toxic"), "text"))

    def run(batches):
        for batch in batches:
            held = [[] for _ in range(batch.num_rows)]
            for first, offsets, data in text_runs(batch.column(2)):
                for row, feature in features(offsets, data):
                    cut = np.searchsorted(row, np.arange(len(offsets)))
                    for r in range(len(offsets) - 1):
                        held[first + r].append(feature[cut[r] : cut[r + 1]])
            packed = [np.unique(np.concatenate(x)).astype(np.uint32).tobytes() if x else b"" for x in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["place", "toxic", "features"])

    rows = sorted(sample.mapInArrow(run, "place bigint, toxic int, features binary").collect(), key=lambda r: (r.place, bytes(r.features)))
    sets = {flag: [np.frombuffer(r.features, np.uint32) for r in rows if r.toxic == flag][:most] for flag, most in ((1, 2 * positives), (0, 2 * unlabelled))}
    return sets[1], sets[0], k / n


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted in place of the text; columns of these names that it has go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*({"score", "predicted"} - {text_col}))
    at = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col) + ", score double, predicted int"

    def run(batches):
        for batch in batches:
            s = sent.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(docs_at) for docs_at in range(batch.num_columns) if docs_at != at), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    model = learn(*training_sets(docs.where(~held_out).select("doc_id", "text"), labels.where(~held_out)))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
