"""Registered queries on the dynamics of calls, budgets, identities that spread, trends and tests, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import communication, dynamics, identity, inference, redaction, usage
from palaver.plans.tables import SEG, USAGE, segments, table
from palaver.plans.tables import usage as usage_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- dynamics of calls

SPOKEN = r"""sp AS (SELECT user_id % 50 AS call_id, event_id AS ord, event_type AS speaker, len(regexp_extract_all(props, '\S+')) AS words, epoch_us(ts) AS a, CASE event_id % 10 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 1000000 WHEN 2 THEN NULL ELSE epoch_us(ts) + CAST(round(value * 20000000) AS BIGINT) END AS b FROM events)"""


def _spoken(spark, d):
    """Events as overlapping, empty, negative and open-ended segments of few calls."""
    a, k = F.unix_micros(F.col("ts").cast("timestamp")), F.pmod("event_id", F.lit(10))
    b = F.when(k == 0, a).when(k == 1, a - 1000000).when(k > 2, a + F.round(F.col("value") * 20000000).cast("bigint"))
    return table(spark, d, "events").select(F.pmod("user_id", F.lit(50)).alias("call_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker"), F.col("props").alias("text"), (a / 1e6).alias("start"), (b / 1e6).alias("end"))


@query(rf"""WITH {SPOKEN}, t AS (SELECT *, coalesce(CAST(speaker <> lag(speaker) OVER (PARTITION BY call_id ORDER BY ord) AS INT), 0) AS turned FROM sp),
e AS (SELECT call_id, a AS t, 1 AS d FROM sp WHERE a <= b UNION ALL SELECT call_id, b, -1 FROM sp WHERE a <= b), g AS (SELECT call_id, t, sum(d) AS d FROM e GROUP BY ALL),
s AS (SELECT call_id, t, sum(d) OVER w AS depth, lead(t) OVER w - t AS len FROM g WINDOW w AS (PARTITION BY call_id ORDER BY t)),
c AS (SELECT call_id, CAST(max(t) - min(t) AS BIGINT) AS span, CAST(coalesce(sum(len) FILTER (depth >= 1), 0) AS BIGINT) AS speech, CAST(coalesce(sum(len) FILTER (depth >= 2), 0) AS BIGINT) AS overlap FROM s GROUP BY call_id),
n AS (SELECT call_id, CAST(sum(words) AS BIGINT) AS words, CAST(sum(turned) AS BIGINT) AS switches FROM t GROUP BY call_id)
SELECT call_id, round(coalesce(span, 0) / 1e6, 6) AS duration_seconds, round(coalesce(speech, 0) / 1e6, 6) AS speech_seconds, round((coalesce(span, 0) - coalesce(speech, 0)) / 1e6, 6) AS silence_seconds, round(coalesce(overlap, 0) / 1e6, 6) AS overlap_seconds, round(CASE WHEN span > 0 THEN (span - speech) / span ELSE 0 END, 6)::DOUBLE AS silence_share, round(CASE WHEN speech > 0 THEN overlap / speech ELSE 0 END, 6)::DOUBLE AS overlap_share, words,
round(CASE WHEN span > 0 THEN words / (span / 60e6) ELSE 0 END, 3)::DOUBLE AS words_per_minute, round(CASE WHEN span > 0 THEN switches / (span / 60e6) ELSE 0 END, 3)::DOUBLE AS switches_per_minute FROM n LEFT JOIN c USING (call_id)""")
def speech_overlap(spark, d):
    """Silence, overlapped speech, words and changes of speaker a minute, by a sweep over the ends of segments."""
    return dynamics.speech_overlap(_spoken(spark, d))


@query("""WITH s AS (SELECT l_orderkey AS call_id, l_suppkey AS speaker, CAST(sum(l_quantity) AS BIGINT) // 10 AS x FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY x) AS i, count(*) OVER (PARTITION BY call_id) AS n FROM s)
SELECT call_id, n AS speakers, round(CASE WHEN sum(x) > 0 THEN CAST(sum((2 * i - n - 1) * x) AS DOUBLE) / (n * CAST(sum(x) AS DOUBLE)) ELSE 0 END, 6)::DOUBLE AS gini FROM r GROUP BY call_id, n""")
def participation_gini(spark, d):
    """How evenly suppliers share an order; many tie."""
    x = F.floor(F.sum("l_quantity").cast("bigint") / 10)
    return dynamics.participation_gini(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("speaker")).agg(x.alias("word_count")))


@query(rf"""WITH {SEG}, s AS (SELECT call_id, speaker, CAST(sum(words) AS BIGINT) AS x FROM seg GROUP BY ALL), p AS (SELECT a.call_id, sum(abs(a.x - b.x)) AS diff FROM s a JOIN s b USING (call_id) GROUP BY a.call_id)
SELECT s.call_id, count(*) AS speakers, round(CASE WHEN sum(x) > 0 THEN any_value(diff) / (2.0 * count(*) * sum(x)) ELSE 0 END, 6)::DOUBLE AS gini FROM s JOIN p USING (call_id) GROUP BY s.call_id""")
def words_gini(spark, d):
    """The same of words in conversations, checked by the mean difference of all pairs."""
    return dynamics.participation_gini(communication.speaker_stats(segments(spark, d)))


@query(rf"""WITH {SPOKEN}, tx AS (SELECT *, CASE WHEN ord % 17 > 0 THEN speaker || ' and ' || CASE ord % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'maybe signup' ELSE 'ok' END END AS text FROM sp), w AS (SELECT call_id, a, b, string_split(coalesce(text, ''), ' ') AS ws, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS words FROM tx),
v AS (SELECT *, len(list_filter(ws, lambda x: x IN ('purchase', 'signup'))) AS p, len(list_filter(ws, lambda x: x = 'error')) AS g, len(list_filter(ws, lambda x: x = 'maybe')) AS h FROM w),
s AS (SELECT call_id, min(a) FILTER (a < b) AS f, max(b) FILTER (a < b) AS t, count(*) FILTER (a < b) AS n, round(CASE WHEN sum(words) > 0 THEN sum(h) / sum(words) ELSE 0 END, 6)::DOUBLE AS hedge_rate FROM v GROUP BY call_id),
k AS (SELECT call_id, i AS part, CAST(CASE WHEN p + g > 0 THEN round(1000.0::DOUBLE * (p - g) / (p + g)) ELSE 0 END AS BIGINT) AS x, greatest(least(b * 10, f * 10 + (i + 1) * (t - f)) - greatest(a * 10, f * 10 + i * (t - f)), 0) AS len FROM v JOIN s USING (call_id), range(10) r(i) WHERE a < b),
q AS (SELECT call_id, part, round(CAST(sum(len * x) AS DOUBLE) / CAST(sum(len) AS DOUBLE) / 1000, 6) AS valence FROM k GROUP BY ALL HAVING sum(len) > 0), u AS (SELECT *, CAST(round(valence * 1e6::DOUBLE) AS BIGINT) AS m FROM q),
c AS (SELECT *, count(*) OVER o AS n1, sum(m) OVER o AS s1, count(*) OVER e AS n0, sum(m) OVER e AS s0 FROM u WINDOW o AS (PARTITION BY call_id ORDER BY part), e AS (PARTITION BY call_id)),
d AS (SELECT *, CASE WHEN n0 > n1 THEN CAST(s1 AS DOUBLE) / n1 - CAST(s0 - s1 AS DOUBLE) / (n0 - n1) END AS apart FROM c), z AS (SELECT *, round(CAST(n1 * (n0 - n1) AS DOUBLE) / n0 * apart * apart / 1e12::DOUBLE, 6) AS fit FROM d),
b AS (SELECT call_id, min(part) + 1 AS change_point FROM (SELECT *, max(fit) OVER (PARTITION BY call_id) AS best FROM z) WHERE fit = best AND best > 0 GROUP BY call_id)
SELECT s.call_id, part, valence, CASE WHEN n >= 10 THEN change_point END AS change_point, hedge_rate FROM s LEFT JOIN q USING (call_id) LEFT JOIN b USING (call_id)""")
def sentiment_arc(spark, d):
    """Valence of each tenth of a call, where it changes most, and the rate of hedge words; kinds of events are the words."""
    said = F.concat("speaker", F.lit(" and "), F.when(F.col("ord") % 4 == 0, "error").when(F.col("ord") % 4 == 1, "maybe signup").otherwise("ok"))
    rows = _spoken(spark, d).withColumn("text", F.when(F.col("ord") % 17 > 0, said))
    return dynamics.sentiment_arc(rows, ["purchase", "signup"], ["error"], ["maybe"])


# ---------------------------------------------------------------- budgets


@query(f"WITH {USAGE}, r AS (SELECT *, CAST(sum(CAST(cost_usd AS DECIMAL(20,6))) OVER (ORDER BY ts, session, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS DECIMAL(30,6)) AS total FROM usage) SELECT session, l_linenumber, l_partkey, l_suppkey, CAST(total AS DOUBLE) AS running_cost, total - CAST(cost_usd AS DECIMAL(20,6)) <= 100000000 AS admitted FROM r")
def budget_admission(spark, d):
    """E14, M: which calls of the whole log a budget admits, in order of time."""
    rows = usage.admit(usage_rows(spark, d), 1e8, ["timestamp", "key"])
    return rows.select("session", "key.l_linenumber", "key.l_partkey", "key.l_suppkey", F.col("running_cost").cast("double").alias("running_cost"), "admitted")


@query(f"WITH {USAGE}, r AS (SELECT *, sum(CAST(cost_usd AS DECIMAL(20,6))) OVER (PARTITION BY left(CAST(ts AS VARCHAR), 7) ORDER BY ts, session, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS total FROM usage) SELECT left(CAST(ts AS VARCHAR), 7) AS month, count(*) AS calls, count(*) FILTER (total - CAST(cost_usd AS DECIMAL(20,6)) <= 2000000) AS admitted FROM r GROUP BY ALL")
def monthly_budget(spark, d):
    """E14, M: how many calls of each month a monthly budget admits."""
    rows = usage_rows(spark, d).withColumn("month", F.left(F.col("timestamp").cast("string"), F.lit(7)))
    return usage.admit(rows, 2e6, ["timestamp", "key"], within=["month"]).groupBy("month").agg(F.count("*").alias("calls"), F.count_if("admitted").alias("admitted"))


# ---------------------------------------------------------------- identities that spread

MEMBERS = "m AS (SELECT DISTINCT l_orderkey AS call_id, l_partkey AS cluster_id FROM lineitem), k AS (SELECT cluster_id, count(*) AS calls FROM m GROUP BY 1), n0 AS (SELECT p_partkey AS cluster_id, p_brand AS name, round(0.6 + (p_partkey % 40) / 100.0, 2)::DOUBLE AS confidence, 0 AS hops FROM part WHERE p_partkey % 5 = 0)"


def _round(n: int) -> str:
    """One round of the SQL: calls take up the best label, unlabelled members the best of their calls."""
    return f"""b{n} AS (SELECT call_id, arg_min(name, (-confidence, name)) AS name, max(confidence) AS confidence FROM m JOIN n{n} USING (cluster_id) GROUP BY call_id),
h{n} AS (SELECT m.cluster_id, b.name, round(max(b.confidence) * 0.40::DOUBLE * count(*) / any_value(k.calls), 6) AS confidence FROM m JOIN b{n} b USING (call_id) JOIN k ON k.cluster_id = m.cluster_id WHERE m.cluster_id NOT IN (SELECT cluster_id FROM n{n}) GROUP BY m.cluster_id, b.name),
n{n + 1} AS (SELECT * FROM n{n} UNION ALL SELECT cluster_id, arg_min(name, (-confidence, name)), max(confidence), {n + 1} FROM h{n} WHERE confidence >= 0.01 GROUP BY cluster_id)"""


@query(f"WITH {MEMBERS}, {_round(0)}, {_round(1)}, {_round(2)} SELECT cluster_id, 'co_speaker' AS source, name, confidence, hops FROM n3 WHERE hops > 0")
def propagated_evidence(spark, d):
    """Names that spread over the graph of co-speakers: parts share orders, every fifth part is named."""
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("cluster_id"))
    part = table(spark, d, "part").where("p_partkey % 5 = 0")
    seeds = part.select(F.col("p_partkey").alias("cluster_id"), F.col("p_brand").alias("name"), F.round(F.lit(0.6) + F.pmod("p_partkey", F.lit(40)) / 100, 2).alias("confidence"))
    return identity.propagated_evidence(members, seeds)


@query("""WITH m AS (SELECT l_orderkey AS call_id, l_linenumber AS cluster_id, CASE WHEN l_suppkey % 3 > 0 THEN 'S' || CAST(l_suppkey % 4 AS VARCHAR) || ' Known' END AS name FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS call_id, 'S' || CAST(l_partkey % 4 AS VARCHAR) || ' Lee' AS name, 's' || CAST(l_partkey % 4 AS VARCHAR) AS k FROM lineitem),
t AS (SELECT DISTINCT call_id, split_part(lower(name), ' ', 1) AS k FROM m WHERE name IS NOT NULL), z AS (SELECT call_id, count(*) AS size FROM e GROUP BY 1), f AS (SELECT call_id, count(*) AS n, min(name) AS name FROM e ANTI JOIN t USING (call_id, k) GROUP BY call_id HAVING count(*) = 1),
a AS (SELECT call_id, min(cluster_id) AS cluster_id FROM m WHERE name IS NULL GROUP BY call_id HAVING count(DISTINCT cluster_id) = 1)
SELECT cluster_id, 'email' AS source, name, 0.70::DOUBLE AS confidence, 'thread=' || size AS detail, call_id FROM a JOIN f USING (call_id) JOIN z USING (call_id)""")
def email_evidence(spark, d):
    """The one unnamed speaker of a call and the one person of its thread whom nobody there is named after."""
    t = table(spark, d, "lineitem")
    name = F.when(F.pmod("l_suppkey", F.lit(3)) > 0, F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(4)).cast("string"), F.lit(" Known")))
    members = t.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("cluster_id"), name.alias("name"))
    emails = t.select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("S"), F.pmod("l_partkey", F.lit(4)).cast("string"), F.lit(" Lee")).alias("name"), F.col("l_linenumber").alias("pos"))
    return identity.email_evidence(members, emails).drop("pos")


@query("""WITH t AS (SELECT o_custkey AS cluster_id, o_orderpriority || CAST(o_custkey % 37 AS VARCHAR) AS topic, count(*) AS calls FROM orders GROUP BY ALL), l AS (SELECT cluster_id, arg_min(topic, (-calls, topic)) AS topic FROM t WHERE calls >= 3 GROUP BY 1), n AS (SELECT c_custkey AS cluster_id, c_name AS name FROM customer WHERE c_custkey % 11 = 0),
o AS (SELECT l.*, name FROM l LEFT JOIN n USING (cluster_id)), u AS (SELECT topic, min(name) AS name FROM o GROUP BY topic HAVING count(DISTINCT name) = 1) SELECT o.cluster_id, 'topic' AS source, u.name, 0.50::DOUBLE AS confidence, 'topic=' || topic AS detail FROM o JOIN u USING (topic) WHERE o.name IS NULL""")
def topic_evidence(spark, d):
    """Names of speakers from the topic that leads their calls, where one named speaker only has it."""
    topic = F.concat("o_orderpriority", F.pmod("o_custkey", F.lit(37)).cast("string"))
    topics = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster_id"), topic.alias("topic")).agg(F.count("*").alias("calls"))
    names = table(spark, d, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("name"))
    return identity.topic_evidence(topics, names)


@query()
def redacted_turns(spark, d):
    """Turns without names: the names are the first words of each conversation's first turn, each labelled by its length."""
    turns = table(spark, d, "conversations")
    words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0)
    first = turns.where("turn = 0").select(F.slice(words, 1, 3).alias("w")).select(F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.element_at("w", -1))).alias("name"))
    return redaction.redacted_turns(turns, first.select("name", F.concat(F.lit("[P"), F.length("name").cast("string"), F.lit("]")).alias("label"))).select("conv_id", "turn", "redacted", "n_names")


# ---------------------------------------------------------------- trends, outcomes, judges

_P = "round(greatest(least((t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-x * x), 1), 0), 7)::DOUBLE"


@query(f"""WITH o AS (SELECT o_custkey % 300 AS segment, o_orderdate AS date, round(o_totalprice / 50000, 1) AS score FROM orders), p AS (SELECT segment, year(date) * 12 + month(date) AS m, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(20,6))) AS DOUBLE) / count(*), 6) AS x FROM o GROUP BY ALL),
z AS (SELECT segment, CAST(sum(n) AS BIGINT) AS calls, count(*) AS months FROM p GROUP BY 1), r AS (SELECT a.segment, CAST(sign(b.x - a.x) AS BIGINT) AS sg, round((b.x - a.x) / (b.m - a.m), 6) AS sl FROM p a JOIN p b ON a.segment = b.segment AND a.m < b.m), s AS (SELECT segment, CAST(sum(sg) AS BIGINT) AS s, median(sl) AS slope FROM r GROUP BY 1),
t AS (SELECT segment, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT segment, x, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1), v AS (SELECT *, (months * (months - 1) * (2 * months + 5) - ties) / 18.0::DOUBLE AS v FROM z LEFT JOIN s USING (segment) LEFT JOIN t USING (segment)),
y AS (SELECT *, calls >= 10 AND months >= 2 AS ok, round(CASE WHEN s = 0 OR v <= 0 THEN 0 ELSE (s - sign(s)) / sqrt(v) END, 6)::DOUBLE AS zz FROM v), w AS (SELECT *, abs(zz) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * (abs(zz) / sqrt(2.0))) AS t FROM y), q AS (SELECT *, {_P} AS pp FROM w)
SELECT segment, calls, months, CASE WHEN ok THEN s END AS s, CASE WHEN ok THEN zz END AS z, CASE WHEN ok THEN pp END AS p, CASE WHEN ok THEN round(slope, 6) END AS slope, CASE WHEN ok THEN CASE WHEN pp < 0.05 AND zz > 0 THEN 'improving' WHEN pp < 0.05 AND zz < 0 THEN 'declining' ELSE 'stable' END END AS trend FROM q""")
def monthly_trend(spark, d):
    """Mann-Kendall test and Theil-Sen slope of monthly means, for segments of customers."""
    o = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(300)).alias("segment"), F.col("o_orderdate").alias("date"), F.round(F.col("o_totalprice") / 50000, 1).alias("score"))
    return inference.monthly_trend(o, ["segment"])


@query(f"""WITH c AS (SELECT o_orderkey AS call_id, o_orderpriority AS task_type, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS won FROM orders), k AS (SELECT * FROM c WHERE won IS NOT NULL), g AS (SELECT task_type, sum(won) AS w, count(*) AS n FROM k GROUP BY 1),
f AS (SELECT DISTINCT l_orderkey AS call_id, 'finding ' || CAST(l_partkey % 60 + CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_suppkey % 2 END AS VARCHAR) AS finding FROM lineitem), h AS (SELECT task_type, finding, CAST(sum(won) AS BIGINT) AS a, count(*) AS n1 FROM f JOIN k USING (call_id) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT task_type, finding, a AS won_with, n1 - a AS lost_with, CAST(w - a AS BIGINT) AS won_without, CAST(n - w - (n1 - a) AS BIGINT) AS lost_without FROM h JOIN g USING (task_type)),
l AS (SELECT *, round(ln((won_with + 0.5::DOUBLE) * (lost_without + 0.5::DOUBLE) / ((lost_with + 0.5::DOUBLE) * (won_without + 0.5::DOUBLE))), 6) AS log_odds FROM t), z AS (SELECT *, round(log_odds / sqrt(1 / (won_with + 0.5::DOUBLE) + 1 / (lost_with + 0.5::DOUBLE) + 1 / (won_without + 0.5::DOUBLE) + 1 / (lost_without + 0.5::DOUBLE)), 6) AS z FROM l),
w AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2.0))) AS t FROM z), p AS (SELECT *, {_P} AS p FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY p, abs(log_odds) DESC, finding) AS rank, count(*) OVER (PARTITION BY task_type) AS m FROM p), b AS (SELECT *, coalesce(max(CASE WHEN p <= rank * 0.05::DOUBLE / m THEN rank END) OVER (PARTITION BY task_type), 0) AS last FROM r)
SELECT task_type, finding, won_with, lost_with, won_without, lost_without, log_odds, z, p, rank, rank <= last AS kept, CASE WHEN rank <= last THEN CASE WHEN log_odds > 0 THEN 'works' WHEN log_odds < 0 THEN 'fails' END END AS side FROM b""")
def finding_lift(spark, d):
    """Findings that go with an outcome, with the false-discovery rate held: lines of orders that are finished or open."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("task_type"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("won"))
    k = F.pmod("l_partkey", F.lit(60)) + F.when(F.col("l_linestatus") == "O", 0).otherwise(F.pmod("l_suppkey", F.lit(2)))
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("finding "), k.cast("string")).alias("finding"))
    return inference.finding_lift(c, f)


@query("""WITH r AS (SELECT l_returnflag AS panel, l_orderkey AS unit, l_linenumber AS judge, CAST(round((4 + l_orderkey % 5 + l_quantity / 25) * 1000) AS HUGEINT) AS x FROM lineitem), u AS (SELECT panel, unit, count(*) AS m FROM r GROUP BY ALL HAVING count(*) > 1), v AS (SELECT r.*, m FROM r JOIN u USING (panel, unit)),
o AS (SELECT a.panel, sum(CAST((a.x - b.x) * (a.x - b.x) AS DOUBLE) / (a.m - 1)) AS apart FROM v a JOIN v b ON a.panel = b.panel AND a.unit = b.unit GROUP BY 1), s AS (SELECT panel, count(DISTINCT unit) AS units, count(*) AS n, sum(x)::DOUBLE AS s, sum(x * x)::DOUBLE AS q FROM v GROUP BY 1)
SELECT panel, units, n AS ratings, round(1 - (apart / n) / ((n * q - s * s) * 2 / (n * (n - 1.0))), 6)::DOUBLE AS alpha FROM s JOIN o USING (panel)""")
def judge_agreement(spark, d):
    """Krippendorff's alpha of three panels: lines of an order judge it."""
    score = F.lit(4) + F.pmod("l_orderkey", F.lit(5)) + F.col("l_quantity") / 25
    return inference.judge_agreement(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("panel"), F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("judge"), score.alias("score")), ["panel"])


@query()
def judge_strengths(spark, d):
    """Bradley-Terry strengths of brands: the parts of an order are compared by their price."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    r = table(spark, d, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("unit"), F.lit("price").alias("judge"), "model", F.col("l_extendedprice").alias("score"))
    return inference.judge_strengths(r)
