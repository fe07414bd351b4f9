"""Operator 12: phrase collocation mining.

All phrases of 1 to ``longest`` words become rows of a DataFrame, level by level, and are counted by hash aggregates for each
language; a phrase is joined with the counts of its beginning and its end, scored in decimals, and goes if a phrase of
one word more holds it nearly as often; the rest is ranked for each language.

* A phrase can only be frequent if its first and its last words but one are.  So each level emits those rows only whose two
  parts may be frequent, told by a bitmap of bounded size, which errs on the side of emitting.  Counts stay exact.
* What a batch of texts repeats is counted in the batch before it leaves the task; equal are phrases of one hash of two times
  64 bits and one length, and phrases of more than ``LONG`` bytes are never counted together there.
* A word such as the commonest article begins a large part of all phrases: heavy parts are broadcast, of which there are
  fewer than a thousand (``shared.look_up``).
* Only extensions by one word need be looked at: of a longer phrase that holds this one nearly as often, the part that is one
  word longer than this one is at least as frequent.
* Ranks come from one order that is cut into ranges (``operators.ordering``), not from a window over a language.

Cases: null texts count as empty; a null language is ``und``; texts of any length are read in one pass; repeated rows count
as often as they stand there; ties of the score go to the higher count, then to the smaller phrase by bytes; an empty table
gives an empty table; columns other than the text and the language are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import U64, KeyBits, discard, look_up, materialize, mix, powers_down, prefix_sums, release, table, text_runs
from palaver.operators.ordering import numbered

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase goes if a longer one has this share (in percent) of its count, or more.
HELD = 80
#: Bytes of the longest phrase that is counted inside a batch, and of the texts that are cut into phrases at a time.
LONG, RUN = 512, 1 << 20

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(12_2024)
_FIRST, _SECOND = (_RANDOM.integers(0, 1 << 64, 256, dtype=U64) for _ in range(2))
_SIZE = U64(0xD6E8FEB86659FD93)


class Words:
    """The words of a run of texts, lower-cased (A-Z) and parted by one space each, and how many follow each in its piece."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        word = ~(_BREAK | _GAP)[data]
        n = len(data)
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.row = np.searchsorted(offsets, first, "right") - 1
        # a word's piece: breaks and texts before it
        piece = np.cumsum(_BREAK[data])[first] if len(first) else first
        self.new = np.ones(len(first), bool)
        self.new[1:] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        size = last + 1 - first
        self.start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        self.end = self.start + size
        total = int(self.end[-1]) + 1 if len(size) else 0
        self.data = np.full(total, 32, np.uint8)
        if total:
            at = np.repeat(first - self.start, size) + _ranges(self.start, size)
            self.data[_ranges(self.start, size)] = _LOWER[data[at]]
        self.sums = [prefix_sums(h[self.data]) for h in (_FIRST, _SECOND)]

    def phrases(self, n: int) -> np.ndarray:
        """First words of the phrases of n words: none of the words after the first begins a piece."""
        count = len(self.start) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(count, bool)
        for k in range(1, n):
            whole &= ~self.new[k : k + count]
        return np.flatnonzero(whole)

    def hashes(self, at: np.ndarray, n: int, lang: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the phrases of n words from these words on, in their languages."""
        a, b = self.start[at], self.end[at + n - 1]
        return mix((self.sums[which][b] - self.sums[which][a]) * powers_down(a) + lang * _SIZE + (b - a).astype(U64))

    def strings(self, at: np.ndarray, n: int) -> pa.Array:
        a, size = self.start[at], self.end[at + n - 1] - self.start[at]
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        data = self.data[np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    before = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(start - before[:-1], size) + np.arange(before[-1])


def language_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8)
    return int(mix(prefix_sums(_FIRST[raw])[-1:] + U64(len(raw)))[0])


def _together(words: Words, at: np.ndarray, n: int, rows_lang: np.ndarray, hash_of: np.ndarray):
    """(word, count) of the different phrases of n words among those from ``at`` on."""
    lang = hash_of[rows_lang[words.row[at]]]
    h, h2 = words.hashes(at, n, lang), words.hashes(at, n, lang, 1)
    size = words.end[at + n - 1] - words.start[at]
    order = np.argsort(h, kind="stable")
    h, h2, size, at = h[order], h2[order], size[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (size[1:] != size[:-1]) | (size[1:] > LONG)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


ROWS = "lang string, phrase string, c bigint"


def level(docs: DataFrame, n: int, parts: KeyBits | None) -> DataFrame:
    """(lang, phrase, c): phrases of n words of (text, lang), counted inside batches; with ``parts`` those whose two parts of n - 1 words may be there."""
    sent, bits = (parts.sent, parts.bits) if parts else (None, 0)

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            for name in names:
                if name not in seen:
                    seen[name] = language_hash(name)
            hash_of = np.array([seen[name] for name in names], U64)
            of = np.asarray(langs.indices)
            for row, offsets, data in text_runs(batch.column(0), RUN):
                words = Words(offsets, data)
                rows_lang = of[row : row + len(offsets) - 1]
                at = words.phrases(n)
                if sent is not None and len(at):
                    lang = hash_of[rows_lang[words.row[at]]]
                    for shift in (0, 1):
                        place = words.hashes(at + shift, n - 1, lang) & U64(bits - 1)
                        hit = (sent.value[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1
                        at, lang = at[hit == 1], lang[hit == 1]
                if not len(at):
                    continue
                at, count = _together(words, at, n, rows_lang, hash_of)
                named = pa.array(names, pa.string()).take(pa.array(rows_lang[words.row[at]]))
                yield pa.RecordBatch.from_arrays([named, words.strings(at, n).cast(pa.string()), pa.array(count, pa.int64())], ["lang", "phrase", "c"])
        release()

    return docs.mapInArrow(run, ROWS)


def _bits(frequent: DataFrame) -> KeyBits:
    """A bitmap of phrases (lang, phrase)."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(phrase.encode("utf-8", "surrogatepass"), np.uint8)
                of = np.array([language_hash(lang)], U64) * _SIZE
                out.append(int(mix(prefix_sums(_FIRST[raw])[-1:] + of + U64(len(raw)))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out, U64).view(np.int64))], ["h"])

    return KeyBits(frequent.select("lang", "phrase").mapInArrow(run, "h bigint"), "h", hashed=True)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of the phrases of 1 to ``longest`` words with f >= ``least``, (lang, n) with all words of each language) of (text, lang)."""
    found, bits, totals = None, None, None
    for n in range(1, longest + 1):
        rows = level(docs, n, bits)
        counted = rows.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
        if n == 1:
            every = materialize(counted, "words")
            totals = materialize(every.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
            counted = every
        here = materialize(counted.where(F.col("f") >= least).withColumn("words", F.lit(n)), f"phrases{n}")
        if n == 1:
            discard(every)
        if bits is not None:
            bits.sent.unpersist()
        found = here if found is None else found.unionByName(here)
        if n < longest:
            bits = _bits(here)
    return found, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    a, l, r: how often the phrase, its first part and its rest occur; n: all words of the language; score:
    2,000,000 * a / (l + r), rounded down, at the cut where it is lowest, of those the one after the fewest words.
    """
    read = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    counts, totals = frequent_phrases(read, longest, least)
    counts = materialize(counts, "phrases")
    several = counts.where("words > 1")
    words = F.split("phrase", " ")
    # one-word extensions: the highest count of a phrase of which this one is all but the first or the last word
    inner = F.array(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))
    longer = several.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = several.join(longer.withColumnRenamed("phrase", "inside").withColumnRenamed("lang", "of"), (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inside")) & (F.col("held").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * held), "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), words.alias("w"))
    cuts = materialize(cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest")), "cuts")

    def with_count(rows: DataFrame, part: str, name: str) -> DataFrame:
        keys = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).join(cuts.groupBy("lang", part).agg(F.count("*").alias("copies")), ["lang", part])
        return look_up(rows, keys, ["lang", part], "copies")

    both = materialize(with_count(materialize(with_count(cuts, "first", "l"), "cuts-first"), "rest", "r"), "cuts-both")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    ratio = both.withColumn("_top", exact("a") * F.lit(2_000_000)).withColumn("_sum", exact("l") + exact("r")).withColumn("score", F.expr("_top div _sum"))
    scored = ratio.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    ranked = numbered(scored, [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "rank", ["lang"]).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
