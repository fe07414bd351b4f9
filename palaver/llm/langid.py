"""Operator 8: language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language.  A text is cross-parsed with each: the parser takes
the longest match that the automaton knows, starts again at the letter that broke it, and counts the phrases.  The
language with the fewest phrases, each weighted by the logarithm of that language's learned length (Ziv and Merhav's
estimate), wins.  The automata's moves stand in one sparse array, so that a NumPy step advances thousands of segments in
all languages at once, and an alphabet of thousands of letters costs no more than its moves.

What is learned is bounded: at most ``LETTERS_PER_LANGUAGE`` letters of each language, taken from about
``DOCS_PER_LANGUAGE`` training documents in the order of a hash of their ids.  Everything else covers whole texts:
they are cut into segments of ``SEGMENT`` letters, each parsed from the root.

Cases: null texts and texts without a letter get ``und`` and score 0; a language that only has null or letterless
training text isn't learned; without any training text every prediction is ``und``; ties go to the language that
sorts first; rows that repeat a doc_id, null ones too, are predicted each; very long texts are parsed whole, segment by
segment; further columns stay, but for those named as the results, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import crc_mod, table, worker_state

LETTERS_PER_LANGUAGE = 40_000
DOCS_PER_LANGUAGE = 200
SEGMENT = 1024
#: Letters parsed at once by a worker; bounds memory only.
BLOCK = 1 << 20
UNKNOWN = "und"


class Automaton:
    """Suffix automaton of a sequence of symbols."""

    def __init__(self, symbols):
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(c, last)

    def _extend(self, c: int, last: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters between letters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(_letter_table()[np.minimum(points, 0x10FFFF)], points, 32)
    space = kept == 32
    again = space.copy()
    again[1:] &= space[:-1]
    if len(again):
        again[0] = space[0]
    return kept[~again]


_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


@dataclass
class Model:
    """Languages in order, their weights, symbol of each known code point, and the automata's moves.

    The moves of all automata share one array: a state is named by its base, and its move by a symbol is the slot at
    base + symbol if that slot carries the base (row displacement).  So memory grows with the moves, not with states
    times letters.
    """

    languages: list[str]
    weights: np.ndarray
    alphabet: np.ndarray  # sorted code points; symbol i + 1; 0 is any other character
    roots: np.ndarray  # base of each root
    starts: np.ndarray  # by language and symbol: the state after a phrase that this symbol begins
    slots: bytes  # compressed: base << 32 | next base; -1 where empty


def displace(rows: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the rows (symbols, next rows), all different, and the array of slots."""
    sizes = np.array([len(x) for x, _ in rows], np.int64)
    base = np.full(len(rows), -1, np.int64)
    widest = max((max(x) for x, _ in rows if x), default=0) + 1
    room = int(sizes.sum()) + widest + 4096
    taken, used = np.zeros(room, bool), np.zeros(room, bool)

    def grow(least: int) -> None:
        nonlocal taken, used
        more = max(least, len(taken)) // 2 + 4096
        taken, used = (np.concatenate((x, np.zeros(more, bool))) for x in (taken, used))

    begin, window = 0, 512
    several = np.flatnonzero(sizes > 1)
    for k in several[np.argsort(-sizes[several], kind="stable")].tolist():
        symbols = np.array(rows[k][0])
        at = begin
        while True:
            if at + window + widest > len(taken):
                grow(at + window + widest)
            good = ~used[at : at + window]
            for s in symbols.tolist():
                good &= ~taken[at + s : at + s + window]
            found = int(good.argmax())
            if good[found]:
                break
            at += window
        base[k] = at + found
        used[at + found] = taken[at + found + symbols] = True
        if at > begin and used[begin : begin + window].mean() + taken[begin : begin + window].mean() > 1:
            begin += window
    # rows of one move, by symbol, take the free slots in order; bases that clash try again
    single = np.flatnonzero(sizes == 1)
    symbol = np.array([rows[k][0][0] for k in single.tolist()], np.int64)
    order = np.argsort(symbol, kind="stable")
    left, symbol = single[order], symbol[order]
    after = widest
    while len(left):
        free = np.flatnonzero(~taken[after:])[: len(left)] + after
        if len(free) < len(left):
            grow(len(taken) + len(left))
            continue
        wanted = free - symbol
        good = ~used[wanted]
        _, first = np.unique(wanted, return_index=True)
        once = np.zeros(len(wanted), bool)
        once[first] = True
        good &= once
        base[left[good]] = wanted[good]
        used[wanted[good]] = taken[free[good]] = True
        if not good.any():
            after = int(free[-1]) + 1
        left, symbol = left[~good], symbol[~good]
    none = np.flatnonzero(sizes == 0)
    top = int(base.max(initial=-1)) + 1
    base[none] = np.arange(top, top + len(none))
    slots = np.full(int(base.max(initial=0)) + widest + 1, -1, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    symbols = np.array([s for x, _ in rows for s in x], np.int64)
    target = np.array([t for _, x in rows for t in x], np.int64)
    slots[base[owner] + symbols] = base[owner] << 32 | base[target]
    return base, slots


def learn(samples: dict[str, list[str]], most: int = LETTERS_PER_LANGUAGE) -> Model:
    """Automata of at most ``most`` letters of each language's texts."""
    taken: dict[str, np.ndarray] = {}
    for lang in sorted(samples):
        parts, n = [], 0
        for text in samples[lang]:
            x = letters(text or "")
            if n >= most or not (x != 32).any():
                continue
            parts.append(x[: most - n])
            n += len(parts[-1])
        if parts:
            taken[lang] = np.concatenate(parts)
    alphabet = np.unique(np.concatenate([*taken.values(), np.array([32], np.uint32)]))
    rows, roots = [], []
    for x in taken.values():
        automaton = Automaton((np.searchsorted(alphabet, x) + 1).tolist())
        first = len(rows)
        roots.append(first)
        rows += [(list(row), [first + t for t in row.values()]) for row in automaton.moves]
    base, slots = displace(rows)
    starts = np.zeros((len(roots), len(alphabet) + 1), np.int64)
    for k, root in enumerate(roots):
        # a letter that the root doesn't know is a phrase itself
        starts[k] = base[root]
        starts[k, rows[root][0]] = base[rows[root][1]]
    weights = np.array([math.log2(len(x) + 1) for x in taken.values()])
    return Model(list(taken), weights, alphabet, base[np.array(roots, np.int64)], starts, zlib.compress(slots.tobytes(), 6))


class Parser:
    """Counts the phrases of many texts in all languages."""

    def __init__(self, model: Model):
        self.model = model
        self.slots = np.frombuffer(zlib.decompress(model.slots), np.int64)
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[model.alphabet] = np.arange(1, len(model.alphabet) + 1)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); texts are arrays of code points."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.model.languages)), np.int64)
        if not sizes.sum():
            return out
        flat = self.symbol[np.concatenate(texts)]
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * SEGMENT
        size = np.minimum(sizes[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        # one line of the matrix for each letter's place: all segments that reach it
        lanes = len(owner)
        count = np.zeros((len(self.model.languages), lanes), np.int32)
        state = np.repeat(self.model.roots[:, None], lanes, axis=1)
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        for step, n in enumerate(live.tolist()):
            symbol = flat[begin[:n] + step]
            now = state[:, :n]
            slot = self.slots[now + symbol]
            broken = (slot >> 32) != now
            count[:, :n] += broken
            # a letter that breaks a match begins the next phrase
            state[:, :n] = np.where(broken, self.model.starts[:, symbol], slot & 0xFFFFFFFF)
        np.add.at(out, owner, (count + 1).T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        block: list[np.ndarray] = []
        held = 0
        for text in texts:
            block.append(letters(text or ""))
            held += len(block[-1])
            if held >= BLOCK:
                out += self._predict(block)
                block, held = [], 0
        return out + self._predict(block)

    def _predict(self, block: list[np.ndarray]) -> list[tuple[str, float]]:
        if not block:
            return []
        languages = self.model.languages
        cost = self.phrases(block) * self.model.weights[None, :]
        out = []
        for x, c in zip(block, cost, strict=True):
            if not languages or not (x != 32).any():
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            out.append((languages[best], float(rest.min() / (rest.min() + c[best])) if len(rest) else 1.0))
        return out


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> dict[str, list[str]]:
    """About ``per_language`` texts of each language, by a hash of their ids (at most four times as many)."""
    if "lang" != lang_col or "doc_id" != id_col or "text" != text_col:
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, per_language / n))))])
    rows = known.where(place < F.try_element_at(share, F.col("lang"))).select("lang", "text", place.alias("place")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place, r.text)):
        if len(out.setdefault(r.lang, [])) < 4 * per_language:
            out[r.lang].append(r.text)
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names that it has are replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    docs = docs.drop(*({pred_col, score_col} - {text_col}))
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{pred_col}` string, `{score_col}` double"

    def run(batches):
        parser = worker_state("langid", name, lambda: Parser(sent.value))
        for batch in batches:
            found = parser.predict(batch.column(at).to_pylist())
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = learn(training_sample(docs.where(~held_out), "doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
