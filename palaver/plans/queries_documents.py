"""Registered queries on evidence, contacts, dashboards and replies, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import analyzers, classify, communication, evaluation, history, identity, incremental, reports, topics
from palaver.plans import documents as D
from palaver.plans.queries_rollups import CONF, FINDINGS, NAME, SOURCES, _evidence, _findings, _results
from palaver.plans.stored import cut
from palaver.plans.tables import EPISODES, SEG, calls, episodes, segments, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


EV = f"e AS (SELECT o_custkey AS cluster_id, {SOURCES} AS source, {NAME} AS name, {CONF} AS confidence, o_orderkey AS pos FROM orders)"


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, pos) AS place FROM e) SELECT cluster_id, source, name, confidence, pos, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def top_evidence(spark, d):
    """The three surest."""
    return identity.top_evidence(_evidence(spark, d))


@query("""WITH t AS (SELECT o_custkey AS cluster_id, CASE o_orderkey % 3 WHEN 0 THEN ' ' || upper(o_orderpriority) ELSE o_orderpriority || CAST(o_orderkey % 7 AS VARCHAR) END AS topic, o_orderkey AS pos FROM orders),
f AS (SELECT cluster_id, arg_min(topic, pos) AS topic, min(pos) AS pos FROM t GROUP BY cluster_id, left(lower(trim(topic)), 50)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS place FROM f) SELECT cluster_id, topic, pos, CAST(place AS INT) AS place FROM r WHERE place <= 20""")
def profile_topics(spark, d):
    """A speaker's first different topics."""
    topic = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.concat("o_orderpriority", F.pmod("o_orderkey", F.lit(7)).cast("string")))
    return identity.profile_topics(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id"), topic.alias("topic"), F.col("o_orderkey").alias("pos")))


@query("SELECT o_custkey AS cluster_id, 'speaker_db' AS source, c_name AS name, 0.90::DOUBLE AS confidence, 'calls=' || CAST(c_custkey % 31 AS VARCHAR) AS detail FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey")
def database_evidence(spark, d):
    """Names that the identity table already has."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("canonical_name"), F.pmod("c_custkey", F.lit(31)).cast("int").alias("total_calls"))
    return identity.database_evidence(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster_id")).distinct(), known).drop("call_id", "pos")


@query("""WITH e AS (SELECT l_orderkey AS call_id, l_suppkey AS cluster_id, CASE l_partkey % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bo' ELSE 'cy oh' END AS name, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem),
a AS (SELECT o_orderkey AS call_id, CASE o_custkey % 4 WHEN 0 THEN 'ann' WHEN 1 THEN 'Bo Ray' WHEN 2 THEN 'Cy Ohm' ELSE 'Dee' END AS attendee FROM orders),
m AS (SELECT DISTINCT e.cluster_id, e.call_id, e.name, e.pos, a.attendee FROM e JOIN a USING (call_id) WHERE lower(trim(name)) = lower(trim(attendee)) OR split_part(lower(trim(name)), ' ', 1) = split_part(lower(trim(attendee)), ' ', 1) OR contains(lower(name), lower(attendee)) OR contains(lower(attendee), lower(name)))
SELECT cluster_id, 'calendar' AS source, attendee AS name, 0.80::DOUBLE AS confidence, 'matched ' || name AS detail, call_id, pos FROM m""")
def attendee_evidence(spark, d):
    """Names that fit an attendee of the call."""
    t = table(spark, d, "lineitem")
    e = t.select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("cluster_id"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, "Ann Lee").when(F.pmod("l_partkey", F.lit(3)) == 1, "Bo").otherwise("cy oh").alias("name"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    k = F.pmod("o_custkey", F.lit(4))
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.when(k == 0, "ann").when(k == 1, "Bo Ray").when(k == 2, "Cy Ohm").otherwise("Dee").alias("name"), F.lit(0).alias("pos"))
    return identity.attendee_evidence(e, a)


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey AS cluster_id, 'p' || CAST(l_suppkey % 9 AS VARCHAR) AS likely_name FROM lineitem),
a AS (SELECT o_orderkey AS call_id, 'item ' || CAST(o_custkey AS VARCHAR) AS item, 'Mr P' || CAST(o_custkey % 9 AS VARCHAR) AS assignee FROM orders)
SELECT m.call_id, cluster_id, likely_name, count(item) AS n_items, coalesce(string_agg(item, '|' ORDER BY item), '') AS items FROM m LEFT JOIN a ON a.call_id = m.call_id AND contains(lower(assignee), lower(likely_name)) GROUP BY ALL""")
def contact_details(spark, d):
    """Calls of known speakers with the action items that name them."""
    t = table(spark, d, "lineitem")
    members = t.select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("cluster_id")).distinct()
    names = t.select(F.col("l_suppkey").alias("cluster_id"), F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(9)).cast("string")).alias("likely_name")).distinct()
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("item "), F.col("o_custkey").cast("string")).alias("item"), F.concat(F.lit("Mr P"), F.pmod("o_custkey", F.lit(9)).cast("string")).alias("assignee"))
    return reports.contact_details(members, names, items).withColumn("items", F.array_join("items", "|"))


PROFILE = """pr AS (SELECT o_custkey AS cluster_id, count(*) AS total_calls, round((o_custkey % 11) / 10.0, 1)::DOUBLE AS name_confidence, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'N' || CAST(o_custkey % 13 AS VARCHAR) END AS likely_name, CAST(max(o_orderdate) AS VARCHAR) AS last_contact FROM orders GROUP BY o_custkey)"""


def _profiles(spark, d):
    k = F.col("cluster_id")
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster_id")).agg(F.count("*").alias("total_calls"), F.max("o_orderdate").cast("string").alias("last_contact"))
    return p.withColumn("name_confidence", F.round(F.pmod(k, F.lit(11)) / 10, 1)).withColumn("likely_name", F.when(F.pmod(k, F.lit(5)) != 0, F.concat(F.lit("N"), F.pmod(k, F.lit(13)).cast("string"))))


@query(f"WITH {PROFILE} SELECT cluster_id, total_calls, '| [[' || likely_name || ']] | ' || total_calls || ' |  | ' || CAST(round(name_confidence * 100) AS INT) || '% | ' || last_contact || ' |' AS line FROM pr WHERE likely_name IS NOT NULL")
def contacts_summary(spark, d):
    """The lines of the index of contacts."""
    p = _profiles(spark, d)
    return D.contacts_summary(p.drop("last_contact").withColumn("display_name", F.col("likely_name")), p.select("cluster_id", "last_contact"))


@query(f"WITH {PROFILE} SELECT cluster_id, total_calls, name_confidence, CAST(row_number() OVER (ORDER BY name_confidence DESC NULLS LAST, total_calls DESC, cluster_id) AS INT) AS place FROM pr")
def profile_listing(spark, d):
    """Profiles in listing order."""
    return D.listing(_profiles(spark, d)).select("cluster_id", "total_calls", "name_confidence", "place")


@query(f"""WITH {PROFILE}, {EV}, u AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source, name ORDER BY confidence DESC, pos) AS k FROM e),
h AS (SELECT cluster_id, 'Evidence:' || chr(10) || string_agg('  - [' || source || '] ' || name || ' (' || CAST(round(confidence * 100) AS INT) || '%)', chr(10) ORDER BY confidence DESC, pos) AS ev FROM u WHERE k = 1 GROUP BY cluster_id)
SELECT cluster_id, total_calls, CASE WHEN likely_name IS NOT NULL THEN '### ' || likely_name || ' (' || cluster_id || ')' || chr(10) || '**Confidence:** ' || CAST(round(name_confidence * 100) AS INT) || '% | **Calls:** ' || total_calls || ' | **Role:** unknown' || chr(10) || ev ELSE '- ' || cluster_id || ': ' || total_calls || ' calls' END AS markdown FROM pr JOIN h USING (cluster_id)""")
def speaker_report(spark, d):
    """A part of the speakers' report per cluster."""
    return D.speaker_report(_profiles(spark, d), _evidence(spark, d)).select("cluster_id", "total_calls", "markdown")


@query("""WITH c AS (SELECT o_custkey AS cluster_id, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), co AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS calls FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY calls DESC, p) AS k FROM co),
w AS (SELECT s, string_agg('- ' || p || ' (' || calls || ')', chr(10) ORDER BY k) AS c FROM r WHERE k <= 8 GROUP BY s)
SELECT c.cluster_id, 'N_' || c.cluster_id || '.md' AS file, '# N ' || c.cluster_id || chr(10) || chr(10) || n || ' calls, ' || CAST(a AS VARCHAR) || ' to ' || CAST(b AS VARCHAR) || chr(10) || chr(10) || '## Often together with' || chr(10) || chr(10) || coalesce(w.c, '') AS markdown FROM c LEFT JOIN w ON w.s = c.cluster_id WHERE n >= 2""")
def contact_pages(spark, d):
    """A page per speaker with enough calls."""
    o, t = table(spark, d, "orders"), table(spark, d, "lineitem")
    seen = o.select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderdate").alias("date"))
    names = seen.select("cluster_id").distinct().withColumn("likely_name", F.concat(F.lit("N "), F.col("cluster_id").cast("string")))
    co = t.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count("*").alias("calls"))
    return reports.contact_pages(names, seen, co, 2)


@query(f"""WITH {EPISODES}, {FINDINGS}, a AS (SELECT count(*) AS n, round(avg(score), 1) AS m FROM ep), o AS (SELECT score, row_number() OVER (ORDER BY pos) AS k, count(*) OVER () AS n FROM ep), h AS (SELECT round(avg(CASE WHEN k <= n // 2 THEN score END), 1) AS x, round(avg(CASE WHEN k > n // 2 THEN score END), 1) AS y FROM o),
c AS (SELECT finding, count(*) AS n, min(pos) AS p FROM f GROUP BY finding), t AS (SELECT string_agg('- ' || finding || ' *(seen ' || n || 'x)*', chr(10) ORDER BY n DESC, p) AS s FROM (SELECT * FROM c ORDER BY n DESC, p LIMIT 10)), x AS (SELECT string_agg('- ' || finding || ' *(seen ' || n || 'x)*', chr(10) ORDER BY n DESC, p) AS s FROM (SELECT * FROM c WHERE contains(finding, 'anti-pmf') ORDER BY n DESC, p LIMIT 10))
SELECT '# PMF Dashboard — Generated from ' || a.n || ' customer calls' || chr(10) || chr(10) || '## PMF Score Trend' || chr(10) || chr(10) || '- Average: ' || a.m || '/10 across ' || a.n || ' calls' || chr(10) || '- First half avg: ' || h.x || ', second half avg: ' || h.y || ' → **' || CASE WHEN h.y > h.x THEN 'improving' WHEN h.y < h.x THEN 'declining' ELSE 'stable' END || '**' || chr(10) || chr(10) || '## Top Patterns' || chr(10) || chr(10) || t.s || chr(10) || chr(10) || '## Anti-PMF Flags' || chr(10) || chr(10) || x.s || chr(10) AS markdown FROM a, h, t, x""")
def pmf_dashboard(spark, d):
    """The page of all episodes."""
    found = _findings(spark, d).groupBy("pos").agg(F.collect_list("finding").alias("findings"))
    e = episodes(spark, d).select("pos", F.create_map(F.lit("overall"), F.col("score")).alias("scores")).join(found, "pos")
    return D.pmf_dashboard(e)


@query(f"""WITH {EPISODES}, {FINDINGS}, l AS (SELECT * FROM ep WHERE task_type = '1-URGENT' ORDER BY ts DESC, pos DESC LIMIT 10), n AS (SELECT finding, min(f.pos) AS p FROM f JOIN l ON l.pos = f.pos GROUP BY finding ORDER BY p LIMIT 5)
SELECT '# Call Prep: 1 Urgent' || chr(10) || chr(10) || '## Key Patterns from Previous Calls' || chr(10) || chr(10) || (SELECT string_agg('- ' || finding, chr(10) ORDER BY p) FROM n) || chr(10) || chr(10) || chr(10) || '*Recent avg score: ' || (SELECT round(avg(score), 1) FROM l) || '/10 across ' || (SELECT count(*) FROM l) || ' calls*' AS markdown""")
def call_prep(spark, d):
    """The page to prepare a call of one type."""
    from palaver.operators import episodes as E

    e = episodes(spark, d).where("task_type = '1-URGENT'")
    last = E.recent(e, ["task_type"], [F.col("timestamp").desc(), F.col("pos").desc()]).select("pos", "score")
    found = _findings(spark, d).groupBy("pos").agg(F.collect_list("finding").alias("findings"))
    none = spark.createDataFrame([], "pattern string"), spark.createDataFrame([], "task_type string, markdown string")
    return D.working_memory("1-URGENT", last.join(found, "pos"), *none)


@query("""WITH m AS (SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file_path, 'old' AS file_hash FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT 'f' || CAST(o_orderkey AS VARCHAR) AS file_path, 'new' AS file_hash FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(p.file_path, m.file_path) AS file_path, coalesce(p.file_hash, m.file_hash) AS file_hash FROM m FULL JOIN p ON m.file_path = p.file_path""")
def manifest_record(spark, d):
    """A manifest with processed files put in by path."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"))
    row = lambda h: [F.lit(h).alias("hash"), F.lit("completed").alias("status"), F.lit("2024").alias("analyzed_at"), F.lit("qbr").alias("call_type"), F.lit(1).alias("size"), F.lit(1.0).alias("mtime")]
    none = spark.createDataFrame([], "file_path string, file_hash string, status string, analyzed_at string, call_type string, file_size int, file_mtime double")
    before = incremental.record(none, o.where("o_orderkey % 2 = 0").select("path", *row("old")))
    return incremental.record(before, o.where("o_orderkey % 3 = 0").select("path", *row("new"))).select("file_path", "file_hash")


@query("""WITH r AS (SELECT event_id, event_id % 4 AS n, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL)
SELECT event_id, round(CASE WHEN n = 0 THEN 0 ELSE 0.5 END, 3)::DOUBLE AS schema_complete, CASE WHEN n = 0 THEN 1.0 ELSE round(1 / n, 3) END::DOUBLE AS grounding_rate, CASE WHEN n = 0 THEN 0 ELSE n - 1 END::INT AS hallucinated_count, round(n / 3, 3) AS evidence_quality,
round((0.10 + CASE WHEN n = 0 THEN 0 ELSE 0.5 END * 0.15 + 0.30 + CASE WHEN n = 0 THEN 1.0 ELSE round(1 / n, 3) END * 0.25 + n / 3 * 0.20) * 10, 2)::DOUBLE AS quality_score FROM r""")
def list_reply_quality(spark, d):
    """Replies that are lists; the first entry's text stands in the transcript, the others' don't."""
    n = F.pmod("event_id", F.lit(4)).cast("int")
    entry = lambda i: F.concat(F.lit('{"text":"'), F.when(i == 0, F.lit("send the report")).otherwise(F.concat(F.lit("zz"), i.cast("string"))), F.lit('","owner":1}'))
    items = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), entry))
    r = table(spark, d, "events").where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("response"), F.lit("I will send the report").alias("transcript"), F.lit(1.0).alias("accuracy"))
    return evaluation.score_replies(r, ["text", "when"]).select("event_id", "schema_complete", "grounding_rate", "hallucinated_count", "evidence_quality", "quality_score")


@query(r"""WITH w AS (SELECT doc_id, lower(text) AS low, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, (CAST(contains(low, 'the') AS INT) + CAST(contains(low, 'und') AS INT)) / 2 AS share, least(1.0, n / 30) AS len FROM w)
SELECT doc_id, round(share, 3) AS accuracy, round((0.10 + 0.15 + share * 0.30 + 0.25 + len * 0.20) * 10, 2) AS quality_score FROM s""")
def summary_quality(spark, d):
    """Summaries by the keywords they hold and their length (no transcript, so all count as grounded)."""
    r = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("response"), F.lit("").alias("transcript"), F.array(F.lit("The"), F.lit("und")).alias("keywords"))
    return evaluation.score_summaries(r).select("doc_id", "accuracy", "quality_score")


@query()
def ranking_page(spark, d):
    """The table of models."""
    return history.ranking_markdown(history.model_aggregates(_results(spark, d)))


# ---------------------------------------------------------------- whole analyses


def _analysed(spark, d):
    seg = segments(spark, d)
    stats = communication.speaker_stats(seg)
    found = classify.classify(calls(spark, d), None, "n_named")
    typed = cut(analyzers.analyze(found.select("call_id", "text", "call_type", "confidence", "scores")), "calls")
    return D.analyses(typed, typed.select("call_id", "text"), seg, stats), seg, stats


@query(rf"""WITH {SEG}, a AS (SELECT call_id, sum(words) AS n FROM seg GROUP BY call_id), t AS (SELECT call_id, count(DISTINCT speaker) AS speakers, count(*) FILTER (ends_with(regexp_replace(coalesce(text, ''), '\s+$', ''), '?')) AS asked FROM seg GROUP BY call_id)
SELECT call_id, CAST(n AS BIGINT) AS words, CAST(speakers AS BIGINT) AS attendees, asked AS questions FROM a JOIN t USING (call_id)""")
def call_sections(spark, d):
    """K1, L1: what of the business sections SQL can count, read from the analyses' JSON."""
    found, _, _ = _analysed(spark, d)
    get = lambda path, kind: F.try_variant_get(F.try_parse_json("analysis"), path, kind)
    size = lambda path: F.coalesce(F.size(get(path, "array<variant>")), F.lit(0)).cast("bigint")
    return found.select("call_id", get("$.summary.word_count", "bigint").alias("words"), size("$.attendees").alias("attendees"), size("$.questions").alias("questions"))


@query()
def full_documents(spark, d):
    """L3: nested JSON of every call."""
    found, seg, stats = _analysed(spark, d)
    return D.documents(found, stats, communication.call_metrics(stats), topics.topics(seg))


@query()
def full_reports(spark, d):
    """L4: the Markdown report of every call."""
    found, seg, stats = _analysed(spark, d)
    return D.reports(found, stats, communication.call_metrics(stats), topics.topics(seg))
