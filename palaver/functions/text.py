"""Column expressions on text: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c: str | Column) -> Column:
    """Words between Unicode white space; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(col(c), F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def strip(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def is_question(c: str | Column, suffix: str = "?") -> Column:
    return F.endswith(strip(c), F.lit(suffix))


def lower(c: str | Column) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def hits(c: str | Column, terms: list[str]) -> Column:
    """The terms that are substrings of the text ``c`` (already lower-cased), in the order of the list."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(col(c), t))


def hit_count(c: str | Column, terms: list[str]) -> Column:
    """How many terms are substrings; plain columns are quicker here than a lambda over an array."""
    out = F.lit(0)
    for t in terms:
        out = out + F.contains(col(c), F.lit(t)).cast("int")
    return out


def any_hit(c: str | Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(col(c), F.lit(t))
    return out


def first_hit(c: str | Column, terms: list[str]) -> Column:
    """The first term of the list that is a substring, or null."""
    out = None
    for t in terms:
        out = F.when(F.contains(col(c), F.lit(t)), t) if out is None else out.when(F.contains(col(c), F.lit(t)), t)
    return F.lit(None).cast("string") if out is None else out


def truncate_words(c: str | Column, most: int = 4000, marker: str = "\n[...truncated...]") -> Column:
    """The text if it has at most ``most`` words; else its first words joined by a space, and the marker."""
    words = F.regexp_extract_all(col(c), F.lit(r"(?U)(\S+)"), F.lit(1))
    return F.when(word_count(c) <= most, col(c)).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(marker)))


def clock(seconds: str | Column) -> Column:
    """MM:SS with unbounded minutes; empty for null."""
    s = F.floor(col(seconds)).cast("bigint")
    return F.coalesce(F.format_string("%02d:%02d", F.floor(s / 60).cast("bigint"), s % 60), F.lit(""))


def markdown(c: str | Column) -> Column:
    """Escape what would break a Markdown table."""
    return F.replace(F.replace(F.replace(col(c), F.lit("|"), F.lit("\\|")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def slug(c: str | Column, most: int = 30) -> Column:
    return F.left(F.replace(F.lower(col(c)), F.lit(" "), F.lit("-")), F.lit(most))


def safe_name(c: str | Column) -> Column:
    """A partition or file name: other characters than letters, digits, _ and - become _; empty becomes unknown."""
    clean = F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^a-zA-Z0-9_-]", "_")
    return F.when(clean == "", "unknown").otherwise(clean)


def display_name(name: str | Column, confidence: str | Column, cluster: str | Column) -> Column:
    """A speaker's name with its doubt: from .80 as it is, from .60 likely, from .40 possible, else the cluster's id."""
    n, p = col(name), col(confidence)
    known = n.isNotNull() & (n != "")
    return F.when(known & (p >= 0.8), n).when(known & (p >= 0.6), F.concat(n, F.lit(" (likely)"))).when(known & (p >= 0.4), F.concat(n, F.lit(" (possible)"))).otherwise(col(cluster))


def names_match(a: str | Column, b: str | Column) -> Column:
    """Equal but for case, or the same first word, or one within the other; false for empty names."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    first = lambda v: F.split_part(v, F.lit(" "), F.lit(1))
    return (x != "") & (y != "") & ((x == y) | (first(x) == first(y)) | F.contains(x, y) | F.contains(y, x))


def is_upgrade(old: str | Column, new: str | Column) -> Column:
    """Whether a new display name is better: nothing before, a longer name with the old one in it, or less doubt."""
    base = lambda v: F.lower(F.trim(F.split_part(v, F.lit(" ("), F.lit(1))))
    rank = lambda v, plain: F.when(F.contains(v, F.lit("(likely)")), 2).when(F.contains(v, F.lit("(possible)")), 1).otherwise(plain)
    o, n = col(old), col(new)
    bo, bn = base(o), base(n)
    return F.coalesce(o.isNull() | (o == "") | (F.contains(bn, bo) & (F.length(bn) > F.length(bo))) | ((bo == bn) & (rank(n, 3) > rank(o, 0))), F.lit(True))


def content_hash(c: str | Column) -> Column:
    return F.left(F.sha2(col(c).cast("binary"), 256), F.lit(16))


def json_without_fence(c: str | Column) -> Column:
    """A model's reply without the Markdown fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
