"""How a call goes: speech, silence and overlap on its clock, who takes part, and how its mood moves.

Times become whole microseconds, so sums don't depend on the order of rows.  Everything is keyed by the call: windows and
aggregates share one exchange, and no call is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T

_MICROS = 1_000_000


def _micros(c: str) -> Column:
    return F.round(F.col(c).cast("double") * _MICROS).cast("bigint")


def _share(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), digits)


def speech_overlap(segments: DataFrame) -> DataFrame:
    """Per call of (call_id, ord, speaker, text, start, end): seconds of the call, of speech, of silence and of overlapped speech, their shares, words and changes of speaker a minute.

    A sweep over the segments' ends: each start opens one more voice, each end closes one; speech is where one is open at least,
    overlap where two are.  Every stretch adds its end and takes away its beginning, so what is summed are single events.

    Cases: a segment that ends before it starts or lacks one of both has no time, its words count; an empty one may stretch the
    call but holds no speech; segments that touch don't overlap; equal segments overlap wholly; of a call without times all seconds
    and shares are 0, and the rates too; without a speaker it is ``Unknown`` who speaks.
    """
    turn = Window.partitionBy("call_id").orderBy("ord")
    start, end = _micros("start"), _micros("end")
    speaker = F.coalesce("speaker", F.lit("Unknown"))
    rows = segments.select("call_id", F.coalesce(T.word_count("text"), F.lit(0)).alias("words"), F.coalesce((speaker != F.lag(speaker).over(turn)).cast("int"), F.lit(0)).alias("turned"), start.alias("a"), end.alias("b"))
    none = F.lit(None).cast("bigint")
    event = lambda t, d, w, c: F.struct(t.alias("t"), F.lit(d).alias("d"), w.alias("w"), c.alias("c"))
    words, turned, zero = F.col("words").cast("bigint"), F.col("turned").cast("bigint"), F.lit(0).cast("bigint")
    events = F.when(F.col("a") <= F.col("b"), F.array(event(F.col("a"), 1, words, turned), event(F.col("b"), -1, zero, zero))).otherwise(F.array(event(none, 0, words, turned)))
    sweep = Window.partitionBy("call_id").orderBy(F.col("t").asc_nulls_first(), F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.select("call_id", F.explode(events).alias("e")).select("call_id", "e.*").withColumn("depth", F.sum("d").over(sweep))
    before = F.col("depth") - F.col("d")
    stretch = lambda least: F.coalesce(F.sum(F.col("t") * ((before >= least).cast("int") - (F.col("depth") >= least).cast("int"))), F.lit(0))
    per = swept.groupBy("call_id").agg(F.coalesce(F.max("t") - F.min("t"), F.lit(0)).alias("span"), stretch(1).alias("speech"), stretch(2).alias("overlap"), F.sum("w").alias("words"), F.sum("c").alias("switches"))
    seconds = lambda c: F.round(c / F.lit(float(_MICROS)), 6)
    span, speech, overlap = F.col("span"), F.col("speech"), F.col("overlap")
    minutes = span / F.lit(60.0 * _MICROS)
    return per.select(
        "call_id",
        seconds(span).alias("duration_seconds"),
        seconds(speech).alias("speech_seconds"),
        seconds(span - speech).alias("silence_seconds"),
        seconds(overlap).alias("overlap_seconds"),
        _share(span - speech, span).alias("silence_share"),
        _share(overlap, speech).alias("overlap_share"),
        "words",
        F.round(F.when(span > 0, F.col("words") / minutes).otherwise(0.0), 3).alias("words_per_minute"),
        F.round(F.when(span > 0, F.col("switches") / minutes).otherwise(0.0), 3).alias("switches_per_minute"),
    )


def participation_gini(stats: DataFrame, share: str = "word_count") -> DataFrame:
    """Per call of (call_id, speaker, share): the speakers and the Gini coefficient of their shares, exact before it is rounded to six places.

    Shares are sorted by how many speakers have each, so speakers that tie count as one row and a call with many has few.

    Cases: 0 for one speaker, for equal shares, and where nobody says anything; null and negative shares count as 0.
    """
    x = F.greatest(F.coalesce(F.col(share), F.lit(0)), F.lit(0)).cast("bigint")
    same = stats.groupBy("call_id", x.alias("x")).agg(F.count("*").alias("m"))
    up = Window.partitionBy("call_id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = same.withColumn("upto", F.sum("m").over(up)).withColumn("n", F.sum("m").over(Window.partitionBy("call_id")))
    # the ranks upto - m + 1 ... upto, each counted as twice itself less n + 1
    weight = F.col("upto") * 2 - F.col("m") - F.col("n")
    sums = ranked.groupBy("call_id").agg(F.max("n").alias("n"), F.sum(wide("x") * (F.col("m") * weight).cast("decimal(19,0)")).alias("over"), F.sum(wide("x") * wide("m")).alias("total"))
    gini = F.when(F.col("total") > 0, F.col("over").cast("double") / (F.col("n") * F.col("total").cast("double"))).otherwise(0.0)
    return sums.select("call_id", F.col("n").alias("speakers"), F.round(gini, 6).alias("gini"))


def sentiment_arc(segments: DataFrame, positive: list[str], negative: list[str], hedges: list[str], parts: int = 10, least: int = 10) -> DataFrame:
    """Per call of (call_id, ord, text, start, end) and tenth of its time: valence, and per call where its mood changes most and the rate of hedge words.

    A segment's valence is (positive - negative) / (positive + negative) of its terms, 0 without any; it counts in each part by the
    time it spends there, so a part's valence is the mean over the time spoken in it; a part in which nobody speaks has no row.  The change point is the border
    between parts at which two means fit best (least squares): the one with the largest n1 * n2 / (n1 + n2) * (m1 - m2) ** 2, from sums
    before each border; of equal ones the first.

    Cases: calls of fewer than ``least`` segments with a time have parts but no change point; segments without a time or of no
    length have no part; null texts have no terms; a call that has no time at all has one row with a null part.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}']+", " "), F.lit(" "))
    hits = lambda terms: sum((F.regexp_count("_p", F.lit(f"(?<= ){t}(?= )")) for t in terms), F.lit(0))
    said = segments.withColumn("_p", padded).select("call_id", hits(positive).alias("p"), hits(negative).alias("g"), hits(hedges).alias("h"), T.word_count("text").alias("words"), _micros("start").alias("a"), _micros("end").alias("b"))
    timed = F.col("a") < F.col("b")
    call = Window.partitionBy("call_id")
    spans = said.withColumn("from", F.min(F.when(timed, F.col("a"))).over(call)).withColumn("to", F.max(F.when(timed, F.col("b"))).over(call)).withColumn("n", F.count(F.when(timed, 1)).over(call))
    spans = spans.withColumn("hedge", F.sum("h").over(call)).withColumn("all", F.sum("words").over(call))
    value = F.when(F.col("p") + F.col("g") > 0, (F.col("p") - F.col("g")) / (F.col("p") + F.col("g"))).otherwise(0.0)
    # the part of a time is parts * (t - from) div (to - from); an end belongs to the part before it
    first, last = F.expr(f"({parts} * (a - `from`)) div (`to` - `from`)"), F.expr(f"({parts} * (b - `from`) - 1) div (`to` - `from`)")
    inside = spans.withColumn("part", F.explode_outer(F.when(timed, F.sequence(first, last))))
    width = F.col("to") - F.col("from")
    left, right = F.greatest(F.col("a") * parts, F.col("from") * parts + F.col("part") * width), F.least(F.col("b") * parts, F.col("from") * parts + (F.col("part") + 1) * width)
    # times in parts of a microsecond, and valences in thousandths, are whole numbers
    time, thousandths = F.greatest(right - left, F.lit(0)), F.round(value * 1000).cast("bigint")
    keys = ["call_id", "n", "hedge", "all"]
    per = inside.groupBy(*keys, "part").agg(F.sum(time.cast("decimal(20,0)")).alias("t"), F.sum(time.cast("decimal(20,0)") * thousandths).alias("v")).where("part is not null or n = 0")
    order = Window.partitionBy("call_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    x = F.when(F.col("t") > 0, F.round(F.col("v").cast("double") / F.col("t").cast("double") / 1000, 6))
    # sums of millionths are exact in any order
    whole = F.round(F.col("valence") * 1_000_000).cast("bigint")
    sums = per.withColumn("valence", x).withColumn("n1", F.count("valence").over(order)).withColumn("s1", F.sum(whole).over(order)).withColumn("n0", F.count("valence").over(call)).withColumn("s0", F.sum(whole).over(call))
    n2 = F.col("n0") - F.col("n1")
    apart = F.col("s1") / F.col("n1") - (F.col("s0") - F.col("s1")) / n2
    fit = F.when((F.col("n1") > 0) & (n2 > 0), F.round(F.col("n1") * n2 / F.col("n0") * apart * apart / 1e12, 6))
    out = sums.withColumn("fit", fit).withColumn("best", F.max("fit").over(call))
    change = F.min(F.when((F.col("fit") == F.col("best")) & (F.col("best") > 0), F.col("part") + 1)).over(call)
    return out.select("call_id", "part", "valence", F.when(F.col("n") >= least, change).alias("change_point"), _share(F.col("hedge"), F.col("all")).alias("hedge_rate"))
