"""Names in texts replaced before the texts leave: whole words, the longest name at each place.

All known names are one Aho-Corasick automaton, which reads a text once however many names there are.  Up to ``MOST_NAMES`` names it
is sent to every worker.  Beyond that no worker needs all names: each text is joined with the names whose first word stands in it, and
its own automaton holds those.

Cases: letters match in either case; a name counts only where no letter, digit or underscore of it goes on before or after it; of names that
begin at one place the longest counts, and of overlapping ones the first; a name with several labels has the smallest; null names and
names without a letter, digit or underscore are none; null texts stay null; texts of any length are read whole; white space in a name is one space and matches one space.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from palaver.functions import text as T
from palaver.functions.arrow import map_in_arrow
from palaver.operators.joins import heavy_keys
from palaver.operators.ordering import quoted

#: Names that are sent to every worker, at most.
MOST_NAMES = 100_000


def _low(text: str) -> str:
    """Lower case of the same length, letter by letter."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Names:
    """An automaton of lower-cased names and their labels."""

    def __init__(self, labels: dict[str, str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for name, label in labels.items():
            self.machine.add_word(name, (len(name), label))
        if labels:
            self.machine.make_automaton()

    def redact(self, text: str) -> tuple[str, int]:
        """The text with labels in place of names, and how many."""
        if not len(self.machine):
            return text, 0
        low, longest = _low(text), {}
        for end, (size, label) in self.machine.iter(low):
            start = end + 1 - size
            if (start == 0 or not (_word(low[start - 1]) and _word(low[start]))) and (end + 1 == len(low) or not (_word(low[end]) and _word(low[end + 1]))) and size > longest.get(start, (0,))[0]:
                longest[start] = size, label
        out, at, n = [], 0, 0
        for start in sorted(longest):
            if start >= at:
                size, label = longest[start]
                out += [text[at:start], label]
                at, n = start + size, n + 1
        out.append(text[at:])
        return "".join(out), n


def clean_names(names: DataFrame) -> DataFrame:
    """(name, label) lower-cased, once each."""
    tidy = T.strip(F.regexp_replace("name", r"\s+", " "))
    lower = F.udf(lambda name: _low(name), "string")  # few rows; the workers' rule must be the same
    return names.where("name is not null").select(lower(tidy).alias("name"), F.coalesce("label", F.lit("[NAME]")).alias("label")).where(F.col("name").rlike(r"[\p{L}\p{N}_]")).groupBy("name").agg(F.min("label").alias("label"))


def redacted_turns(segments: DataFrame, names: DataFrame, text: str = "text", most: int = MOST_NAMES) -> DataFrame:
    """``segments`` with ``redacted`` and the number of names replaced, ``n_names``.  names: (name, label)."""
    known = clean_names(names)
    held = known.limit(most + 1).collect()
    n, columns = len(segments.columns), segments.columns
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in segments.schema.fields), StructField("redacted", StringType()), StructField("n_names", IntegerType())])

    def out(batch, texts, of):
        done = [(None, 0) if t is None else of(i).redact(t) for i, t in enumerate(texts)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], [str(k) for k in range(n + 2)])

    if len(held) <= most:
        sent = segments.sparkSession.sparkContext.broadcast({r.name: r.label for r in held})

        def run(batches):
            machine = Names(sent.value)
            for batch in batches:
                yield out(batch, batch.column(n).to_pylist(), lambda i: machine)

        return map_in_arrow(segments.select(*[quoted(c) for c in columns], F.col(text).cast("string")), run, schema)

    # names of a text: those whose first word (up to a character that is no letter, digit or underscore) stands in it
    key, words, first = "_redact_key", "_redact_text", r"[^\p{L}\p{N}_]+"
    rows = segments.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))
    texts = rows.select(key, F.col(text).cast("string").alias("t")).where("t is not null").dropDuplicates([key, "t"])
    split = F.array_distinct(F.split(F.lower("t"), first))
    wanted = texts.select(key, "t", F.explode(split).alias("w"))
    by_word = known.select("name", "label", F.lower(F.split_part(F.regexp_replace(F.lower("name"), "^" + first, ""), F.lit(" "), F.lit(1))).alias("f")).withColumn("w", F.regexp_extract("f", r"^[\p{L}\p{N}_]*", 0))
    common = F.broadcast(heavy_keys(by_word, "w"))
    few = wanted.join(common, "w", "left_anti").join(by_word, "w")
    many = wanted.join(common, "w", "left_semi").join(by_word.join(common, "w", "left_semi").repartition("name"), "w")
    found = few.unionByName(many).where(F.contains(F.lower("t"), F.lower("name"))).groupBy(key, "t").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "label")))).alias("_redact_names"))
    both = rows.join(found.select(F.col(key).alias("_redact_of"), F.col("t").alias("_redact_t"), "_redact_names"), (F.col(key) == F.col("_redact_of")) & (F.col(text) == F.col("_redact_t")), "left").select(*[quoted(c) for c in columns], F.col(text).cast("string").alias(words), "_redact_names")

    def own(batches):
        for batch in batches:
            held = batch.column(n + 1).to_pylist()
            yield out(batch, batch.column(n).to_pylist(), lambda i, held=held: Names(dict(held[i] or {})))

    return map_in_arrow(both, own, schema)
