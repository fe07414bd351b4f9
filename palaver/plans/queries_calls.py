"""Registered queries on calls and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import lexicons as L
from palaver.functions import text as T
from palaver.operators import analyzers as A
from palaver.operators import classify, communication, enrich, extract, reports, topics
from palaver.plans.tables import CALLS, EVENTS, FRAGMENTS, SEG, calls, event_segments, fragments, segments, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_hits(col: str, terms) -> str:
    return "(" + " + ".join([f"CAST(contains({col}, {q(t)}) AS INT)" for t in terms] or ["0"]) + ")"


def list_hits(col: str, terms) -> str:
    return "concat_ws('|', " + ", ".join([f"CASE WHEN contains({col}, {q(t)}) THEN {q(t)} END" for t in terms] or ["NULL"]) + ")"


def any_hit(col: str, terms) -> str:
    return "(" + " OR ".join([f"contains({col}, {q(t)})" for t in terms]) + ")"


def first_hit(col: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {q(t)}) THEN {q(t)}" for t in terms) + " END"


def joined(c):
    return F.array_join(c, "|")


STATS = r"""runs0 AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT NULL AND lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS turned FROM {src} WINDOW w AS (PARTITION BY call_id ORDER BY ord)),
runs1 AS (SELECT *, sum(turned) OVER (PARTITION BY call_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM runs0),
runs AS (SELECT call_id, speaker, run, sum(words) AS w, count(*) AS n, sum(CASE WHEN ends_with(regexp_replace(coalesce(text, ''), '\s+$', ''), '{suffix}') THEN 1 ELSE 0 END) AS qs, sum(turned) AS turned FROM runs1 GROUP BY ALL),
per AS (SELECT call_id, speaker, sum(w) AS word_count, sum(n) AS segment_count, sum(qs) AS question_count, max(w) AS longest_monologue_words, sum(turned) AS turns FROM runs GROUP BY ALL),
stats AS (SELECT *, round(CASE WHEN sum(word_count) OVER (PARTITION BY call_id) > 0 THEN word_count / sum(word_count) OVER (PARTITION BY call_id) ELSE 0 END, 3) AS talk_ratio, round(word_count / segment_count, 1) AS avg_words_per_turn FROM per)"""
EV_WORDS = r"evw AS (SELECT *, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS words FROM ev)"
STAT_COLUMNS = "call_id, speaker, CAST(word_count AS BIGINT) AS word_count, CAST(segment_count AS BIGINT) AS segment_count, CAST(question_count AS BIGINT) AS question_count, talk_ratio, avg_words_per_turn, CAST(longest_monologue_words AS BIGINT) AS longest_monologue_words"


@query(f"WITH {SEG}, {STATS.format(src='seg', suffix='n.')} SELECT {STAT_COLUMNS} FROM stats")
def talk_time(spark, d):
    """Per conversation and speaker."""
    return communication.speaker_stats(segments(spark, d), "n.").drop("turns_taken")


@query(f"WITH {EVENTS}, {EV_WORDS}, {STATS.format(src='evw', suffix='e')} SELECT {STAT_COLUMNS} FROM stats")
def talk_time_events(spark, d):
    """E1, F1 where runs are longer than one segment."""
    return communication.speaker_stats(event_segments(spark, d), "e").drop("turns_taken")


METRICS = "m0 AS (SELECT *, abs(talk_ratio - 1.0 / count(*) OVER (PARTITION BY call_id)) AS spread FROM stats) SELECT call_id, count(*) AS total_speakers, CAST(sum(word_count) AS BIGINT) AS total_words, CAST(sum(segment_count) AS BIGINT) AS total_segments, CAST(sum(question_count) AS BIGINT) AS total_questions, round(CASE WHEN count(*) <= 1 OR sum(word_count) = 0 THEN 1.0 ELSE 1 - sum(spread) / 2 END, 3) AS speaking_balance, round(sum(turns) / sum(segment_count), 3) AS speaker_switches_per_segment FROM m0 GROUP BY call_id"


@query(f"WITH {SEG}, {STATS.format(src='seg', suffix='n.')}, {METRICS}")
def call_metrics(spark, d):
    """E2, F2."""
    return communication.call_metrics(communication.speaker_stats(segments(spark, d), "n."))


@query(f"WITH {EVENTS}, {EV_WORDS}, {STATS.format(src='evw', suffix='e')}, {METRICS}")
def call_metrics_events(spark, d):
    return communication.call_metrics(communication.speaker_stats(event_segments(spark, d), "e"))


@query(f"WITH {SEG} SELECT call_id, speaker, CAST(sum(words) AS BIGINT) AS word_count, count(*) AS segment_count, round(CASE WHEN sum(sum(words)) OVER (PARTITION BY call_id) > 0 THEN sum(words) / sum(sum(words)) OVER (PARTITION BY call_id) ELSE 0 END, 3) AS talk_ratio FROM seg GROUP BY call_id, speaker")
def attendees(spark, d):
    """E3, E5."""
    return extract.attendees(segments(spark, d))


@query(r"SELECT doc_id AS call_id, 'a' AS speaker, CAST(len(regexp_extract_all(lower(text), '\bthe\b')) AS BIGINT) AS the_count FROM documents WHERE lang = 'en'".replace(", 'a' AS speaker", ""))
def word_boundary_counts(spark, d):
    """I: whole words counted by a pattern."""
    return table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("call_id"), F.regexp_count(T.lower("text"), F.lit(r"\bthe\b")).cast("bigint").alias("the_count"))


@query(r"""WITH t AS (SELECT conv_id AS call_id, coalesce(role, 'Unknown') AS speaker, sum(len(regexp_extract_all(lower(coalesce(text, '')), '\bwe\b'))) AS we_count, sum(len(regexp_extract_all(lower(coalesce(text, '')), '\bi\b'))) AS i_count, min(turn) AS first_ord FROM conversations WHERE regexp_full_match(coalesce(text, ''), '[\x00-\x7f]*') GROUP BY ALL)
SELECT call_id, speaker, CAST(we_count AS BIGINT) AS we_count, CAST(i_count AS BIGINT) AS i_count, first_ord, round(CASE WHEN we_count + i_count > 0 THEN we_count / (we_count + i_count) ELSE 0 END, 3) AS collaborative_ratio FROM t""")
def we_i_language(spark, d):
    """E6, on turns in ASCII, where both engines agree on word boundaries."""
    return communication.we_i_language(segments(spark, d).where(F.coalesce("text", F.lit("")).rlike(r"^[\x00-\x7f]*$")))


@query(f"WITH {SEG} SELECT call_id, speaker, round(avg(words), 1) AS avg_words_per_turn, count_if(words <= 2) AS one_word_answers, count(*) AS total_turns FROM seg GROUP BY ALL".replace("count_if(words <= 2)", "CAST(count_if(words <= 2) AS BIGINT)"))
def engagement(spark, d):
    """E7."""
    return communication.engagement(segments(spark, d))


@query(f"WITH {SEG}, s AS (SELECT call_id, speaker, sum(words) AS w, min(ord) AS o FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY w, o) AS k, count(*) OVER (PARTITION BY call_id) AS n FROM s) SELECT call_id, max(CASE WHEN k = 1 THEN speaker END) AS guest, max(CASE WHEN k = 2 THEN speaker END) AS host FROM r WHERE n = 2 GROUP BY call_id")
def host_and_guest(spark, d):
    """E8."""
    return communication.host_and_guest(segments(spark, d))


@query(f"WITH {SEG}, r AS (SELECT call_id, ord, speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS quote FROM seg WHERE words > 20), k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY length(quote) DESC, ord) AS place FROM r) SELECT call_id, CAST(place AS INT) AS place, ord, speaker, quote FROM k WHERE place <= 5")
def key_quotes(spark, d):
    """G2."""
    return communication.key_quotes(segments(spark, d))


@query(f"""WITH {SEG} SELECT call_id, string_agg(printf('[%02d:%02d] %s: %s', CAST(floor(floor("start") / 60) AS BIGINT), CAST(floor("start") AS BIGINT) % 60, speaker, coalesce(text, '')), chr(10) ORDER BY ord) AS transcript FROM seg GROUP BY call_id""")
def numbered_turns(spark, d):
    """C8, C9."""
    return communication.numbered_turns(segments(spark, d))


# ---------------------------------------------------------------- lexicons

_LEX = fragments({k: v for k, v in L.CLASSIFICATION.items() if v}, 0, 5)
_SCORES = ", ".join(f"{n_hits('low', t)} / {len(t)}.0::DOUBLE AS s{i}" for i, t in enumerate(_LEX.values()))
_RANK = " UNION ALL ".join(f"SELECT call_id, {i} AS place, {q(k)} AS call_type, s{i} AS score, words, n_named FROM sc" for i, k in enumerate(_LEX))


def _classify_sql(lex: dict, source: str) -> str:
    scores = ", ".join(f"{n_hits('low', t)} / {len(t)}.0::DOUBLE AS s{i}" for i, t in enumerate(lex.values()))
    rank = " UNION ALL ".join(f"SELECT call_id, {i} AS place, {q(k)} AS call_type, s{i} AS score, words, n_named FROM sc" for i, k in enumerate(lex))
    return rf"""WITH {source}, sc AS (SELECT call_id, n_named, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS words, {scores} FROM calls),
r0 AS ({rank}), r1 AS (SELECT *, max(score) OVER (PARTITION BY call_id) AS best FROM r0),
r2 AS (SELECT call_id, place, call_type, score FROM r1 UNION ALL SELECT DISTINCT call_id, {len(lex)}, 'voice-memo', 0.7 FROM r1 WHERE n_named = 1 AND words < 200 AND best < 0.3),
r3 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, place) AS k FROM r2)
SELECT call_id, CASE WHEN score > 0 THEN call_type ELSE 'unknown' END AS call_type, CASE WHEN score > 0 THEN round(least(score, 1.0), 3) ELSE 0 END AS confidence FROM r3 WHERE k = 1"""


@query(_classify_sql(_LEX, CALLS))
def classify_calls(spark, d):
    """J, G1, F11 with a custom lexicon."""
    return classify.classify(calls(spark, d), _LEX, "n_named").select("call_id", "call_type", "confidence")


@query(_classify_sql({k: v for k, v in L.CLASSIFICATION.items() if v}, "calls AS (SELECT doc_id AS call_id, text, lower(coalesce(text, '')) AS low, 1 AS n_named FROM documents)"))
def classify_documents(spark, d):
    """J with the built-in lexicon over documents of one speaker."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), "text", F.lit(1).alias("n_named"))
    return classify.classify(docs, None, "n_named").select("call_id", "call_type", "confidence")


_GROUPS = fragments(L.PMF, 3)


@query(f"WITH {CALLS} " + " UNION ALL ".join(f"SELECT call_id, {q(g)} AS grp, {i} AS place, {q(t)} AS term FROM calls WHERE contains(low, {q(t)})" for g, ts in _GROUPS.items() for i, t in enumerate(ts)))
def matched_terms(spark, d):
    """C3, C4."""
    return classify.matched_terms(calls(spark, d), _GROUPS)


_MERGED = classify.merge_lexicons({"qbr": ["HEST", "Stou"], "own": ["Uing"]}, {"found": ["lein"], "qbr": ["never"]}, {"qbr": ["ered"], "podcast": ["gble", "tien"]})


@query(_classify_sql({"qbr": ["hest", "stou"], "podcast": ["gble", "tien"], "found": ["lein"], "own": ["uing"]}, CALLS))
def classify_merged(spark, d):
    """H2: built-in, discovered and custom lexicons merged."""
    return classify.classify(calls(spark, d), _MERGED, "n_named").select("call_id", "call_type", "confidence")


@query(f"WITH {SEG} SELECT call_id, ord, speaker, \"start\", quote, keyword FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS quote, {first_hit('lower(text)', FRAGMENTS[:6])} AS keyword FROM seg) WHERE keyword IS NOT NULL")
def first_keyword_segments(spark, d):
    """validation and criticism detection."""
    return extract.keyword_segments(segments(spark, d), FRAGMENTS[:6])


@query(f"WITH {SEG}, k AS (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS quote, {first_hit('lower(text)', FRAGMENTS[6:16])} AS keyword FROM seg), u AS (SELECT *, row_number() OVER (PARTITION BY call_id, lower(left(quote, 50)) ORDER BY ord) AS n FROM k WHERE keyword IS NOT NULL) SELECT call_id, ord, speaker, \"start\", quote, keyword FROM u WHERE n = 1")
def pain_points(spark, d):
    """pain points with one per beginning."""
    return extract.keyword_segments(segments(spark, d), FRAGMENTS[6:16], True)


_PAT = [r"(?i)\b(?:the|and)\s+(.+?)(?:\.|$)", r"(?i)\b(?:of|is)\b[:\s]*(.+?)(?:\.|$)"]


@query(rf"""WITH t AS (SELECT conv_id AS call_id, turn AS ord, coalesce(role, 'Unknown') AS speaker, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM conversations WHERE regexp_full_match(coalesce(text, ''), '[\x00-\x7f]*')),
m AS (SELECT call_id, ord, speaker, 0 AS pattern, regexp_extract_all(body, '(?i)\b(?:the|and)\s+(.+?)(?:\.|$)', 1) AS l FROM t UNION ALL SELECT call_id, ord, speaker, 1, regexp_extract_all(body, '(?i)\b(?:of|is)\b[:\s]*(.+?)(?:\.|$)', 1) FROM t),
r AS (SELECT call_id, ord, speaker, pattern, unnest(range(len(l))) AS place, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS item FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id, left(lower(item), 50) ORDER BY ord, pattern, place) AS n FROM r WHERE length(item) >= 5)
SELECT call_id, ord, CAST(pattern AS INT) AS pattern, CAST(place AS INT) AS place, item, speaker FROM k WHERE n = 1""")
def action_items(spark, d):
    """Items found by patterns, each key once."""
    return extract.action_items(segments(spark, d).where(F.coalesce("text", F.lit("")).rlike(r"^[\x00-\x7f]*$")), _PAT).drop("start")


@query(f"WITH {SEG} SELECT call_id, ord, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question, speaker, \"start\" FROM seg WHERE ends_with(regexp_replace(coalesce(text, ''), '\\s+$', ''), 'n.')")
def questions(spark, d):
    """C2, K1."""
    return extract.questions(segments(spark, d), "n.")


def _family(name: str, build, lex, columns: dict[str, str], suffix: str = ""):
    def run(spark, d):
        made = build(F.col("_low"), *lex)
        out = []
        for c in columns:
            x = made[c]
            out.append(x.alias(c))
        of = table(spark, d, "documents").withColumnRenamed("doc_id", "call_id") if suffix else calls(spark, d)
        rows = of.withColumn("_low", T.lower("text")).select("call_id", *out)
        return rows.select("call_id", *[joined(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "string" else joined(F.transform(f.name, lambda e: F.concat_ws("=", e["signal"], e["keyword"]))).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema if f.name != "call_id"])

    run.__doc__ = f"The {name} family with {'its built-in terms' if suffix else 'fragments for terms'}."
    QUERIES[f"analyze_{name}{suffix}"] = run
    source = "calls AS (SELECT doc_id AS call_id, coalesce(lower(text), '') AS low FROM documents)" if suffix else CALLS
    SQL[f"analyze_{name}{suffix}"] = f"WITH {source} SELECT call_id, " + ", ".join(f"{sql} AS {c}" for c, sql in columns.items()) + " FROM calls"


def _groups_sql(groups) -> str:
    return "concat_ws('|', " + ", ".join(f"{q(g + '=')} || {first_hit('low', ts)}" for g, ts in groups.items()) + ")"


def _families(fragments, hypotheticals, rivals, _family) -> None:
    """Register every family with lists of terms that ``fragments`` makes of the built-in ones."""
    _b, _r = fragments(L.SALES, 0), fragments(L.SALES_RISK, 7)
    _family("sales", A.sales, (_b, _r, list(rivals)), {"buying_signals": _groups_sql(_b), "risk_signals": _groups_sql(_r), "competitor_mentions": "concat_ws('|', " + ", ".join(f"CASE WHEN contains(low, {q(x.lower())}) THEN {q(x)} END" for x in rivals) + ")"})
    _c = fragments(L.COMMITMENTS, 4)
    _family("discovery", A.discovery, (_c, hypotheticals), {"commitment_signals": _groups_sql(_c), "hypothetical_questions": list_hits("low", hypotheticals)})
    _p, _f = fragments(L.PMF, 5), fragments(L.FEATURES, 11)
    _s = {k: f"least({n_hits('low', t)} * 2.5::DOUBLE, 10.0)" for k, t in _p.items()}
    _i, _u = n_hits("low", _f["incremental"]), n_hits("low", _f["fundamental"])
    _fq = f"(CASE WHEN {_i} + {_u} > 0 THEN round({_i} / ({_i} + {_u}) * 10, 1) ELSE 5.0 END)"
    _pm = f"round(({_s['dependency']} + {_s['workflow_depth']} + {_s['evangelism']} + {_s['switching_cost']} + {_fq} + {_s['wtp']}) / 8, 1)"
    _family("pmf", A.pmf, (_p, _f), {
        "pmf_score": _pm, "emotional_intensity": _s["dependency"], "workflow_integration": _s["workflow_depth"], "feature_request_quality": _fq,
        "ellis_classification": f"CASE WHEN {_pm} >= 7 AND {_s['anti_pmf']} <= 2 THEN 'very_disappointed' WHEN {_pm} >= 4 THEN 'somewhat_disappointed' ELSE 'not_disappointed' END",
        "strongest_signals": "concat_ws('|', " + ", ".join(f"CASE WHEN {any_hit('low', t)} THEN {q(k + ': ')} || concat_ws(', ', {', '.join(f'CASE WHEN contains(low, {q(x)}) THEN {q(x)} END' for x in t)}) END" for k, t in _p.items() if k != "anti_pmf") + ")",
        "anti_pmf_flags": list_hits("low", _p["anti_pmf"]),
    })
    _st = fragments(L.STAR, 2, 3)
    _pres = "(" + " + ".join(f"CAST({n_hits('low', t)} > 0 AS INT)" for t in _st.values()) + ")"
    _family("interview", A.interview, (_st,), {**{k: f"CAST(least({n_hits('low', t)}, 3) AS INT)" for k, t in _st.items()}, "components_present": f"CAST({_pres} AS INT)", "assessment": f"CASE WHEN {_pres} = 4 THEN 'complete' WHEN {_pres} >= 2 THEN 'partial' ELSE 'incomplete' END", "overall_star_score": f"round({_pres} / 4 * 10, 1)"})
    _is, _su = fragments(L.ISSUES, 0, 3), fragments(L.SUPPORT, 9, 3)
    _max = "greatest(" + ", ".join(n_hits("low", t) for t in _is.values()) + ")"
    _bad, _good = n_hits("low", _su["frustration"]), n_hits("low", _su["satisfaction"])
    _family("support", A.support, (_is, _su), {
        "issue_type": "CASE " + " ".join(f"WHEN {n_hits('low', t)} = {_max} AND {_max} > 0 THEN {q(k)}" for k, t in _is.items()) + " ELSE 'other' END",
        "severity": f"CASE WHEN {_bad} > 2 THEN 'high' ELSE 'medium' END",
        "start_emotion": f"CASE WHEN {_bad} > {_good} THEN 'frustrated' ELSE 'neutral' END",
        "end_emotion": f"CASE WHEN {_bad} > {_good} THEN CASE WHEN {_good} = 0 THEN 'frustrated' ELSE 'neutral' END WHEN {_good} > 0 THEN 'satisfied' ELSE 'neutral' END",
        "frustration_signals": f"CAST({_bad} AS INT)", "resolution_status": f"CASE WHEN {any_hit('low', _su['resolution'])} THEN 'resolved' WHEN {any_hit('low', _su['escalation'])} THEN 'escalated' ELSE 'unresolved' END",
        "empathy_score": f"CAST(least({n_hits('low', _su['empathy'])} * 2, 10) AS INT)",
    })
    _qb = fragments(L.QBR, 1, 5)
    _ch = n_hits("low", _qb["churn"])
    _family("qbr", A.qbr, (_qb,), {"health_score": f"CAST(greatest(0, least(10, 5 + {n_hits('low', _qb['positive'])} - {n_hits('low', _qb['negative'])})) AS INT)", "expansion_signals": list_hits("low", _qb["expansion"]), "churn_level": f"CASE WHEN {_ch} >= 3 THEN 'high' WHEN {_ch} >= 1 THEN 'medium' ELSE 'low' END", "churn_indicators": list_hits("low", _qb["churn"])})
    _re = fragments(L.RELATIONSHIP, 6, 6)
    _gp, _gn = n_hits("low", _re["positive"]), n_hits("low", _re["negative"])
    _family("relationship", A.relationship, (_re,), {"positive_count": f"CAST({_gp} AS INT)", "negative_count": f"CAST({_gn} AS INT)", "ratio": f"CAST({_gp} AS VARCHAR) || ':' || CAST({_gn} AS VARCHAR)", "appreciation": f"CASE WHEN {_gn} = 0 THEN CASE WHEN {_gp} > 0 THEN 'healthy' ELSE 'neutral' END WHEN {_gp} / {_gn} >= 5 THEN 'healthy (5:1+)' WHEN {_gp} / {_gn} >= 3 THEN 'approaching (3:1-5:1)' ELSE 'concerning (<3:1)' END"})
    for _name, _build, _groups, _off in (("pitch", A.pitch, L.PITCH, 3), ("customer", A.customer, L.CUSTOMER, 8), ("therapy", A.therapy, L.THERAPY, 12)):
        _x = fragments(_groups, _off)
        _family(_name, _build, (_x,), {k: list_hits("low", t) for k, t in _x.items()})
    _rc = fragments(L.RECRUITING, 10)
    _family("recruiting", A.recruiting, (_rc,), {"qualification_signals": list_hits("low", _rc["qualification_signals"]), "red_flags": list_hits("low", _rc["red_flags"]), "compensation_discussed": any_hit("low", _rc["compensation"])})
    _mg = fragments(L.MANAGEMENT, 13)
    _family("management", A.management, (_mg,), {**{k: f"CAST({n_hits('low', _mg[k])} AS INT)" for k in ("career", "status", "blockers")}, **{k: list_hits("low", _mg[k]) for k in ("burnout_indicators", "alignment_signals", "advice_given")}})
    _op = fragments(L.OPERATIONS, 15)
    _family("operations", A.operations, (_op,), {**{k: list_hits("low", t) for k, t in _op.items()}, "blamelessness": f"CASE WHEN {any_hit('low', _op['blame_signals'])} THEN 'concerning' ELSE 'healthy' END"})
    _ed = fragments(L.EDUCATION, 17)
    _family("education", A.education, (_ed,), {k: f"CAST({n_hits('low', t)} AS INT)" for k, t in _ed.items()})


_families(fragments, FRAGMENTS[2:8], ["Hest", "Zzz"], _family)


def _builtin(name: str, build, lex, columns: dict[str, str]):
    _family(name, build, lex, columns, "_documents")


# the built-in lists themselves, over whole documents
_families(lambda groups, *_: groups, L.HYPOTHETICALS, ["The", "Une", "Zzz"], _builtin)


@query(f"""WITH {SEG}, c AS (SELECT call_id, arg_min("start", ord) AS a, arg_max("end", ord) AS b FROM seg GROUP BY call_id) SELECT call_id, round(b - a, 1) AS duration_seconds, CASE WHEN b - a <= 60 THEN 'good' ELSE 'over_time' END AS time_discipline FROM c""")
def time_discipline(spark, d):
    """A standup's length, with a limit that the test calls reach."""
    c = segments(spark, d).groupBy("call_id").agg(F.min_by("start", "ord").alias("a"), F.max_by("end", "ord").alias("b"))
    return c.select("call_id", *[x.alias(n) for n, x in A.time_discipline(F.col("a"), F.col("b"), 60).items()])


_KINDS = ["qbr", "sales-demo", "standup", "family", "nothing-known", "podcast", "lecture"]
_FAM = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(f)}" for k, f in A.DISPATCH.items()) + " ELSE 'simple' END"


@query(f"WITH t AS (SELECT DISTINCT conv_id AS call_id, (['{chr(39) + ', ' + chr(39)}'])[1] AS x FROM conversations), k AS (SELECT call_id, CASE WHEN g IN ('family', 'partner', 'personal') THEN 'business-meeting' ELSE g END AS kind FROM (SELECT call_id, list_extract([{', '.join(map(q, _KINDS))}], CAST(call_id % {len(_KINDS)} + 1 AS INT)) AS g FROM t)) SELECT call_id, kind, {_FAM} AS family FROM k".replace(f", (['{chr(39) + ', ' + chr(39)}'])[1] AS x", ""))
def dispatch(spark, d):
    """K registry and C18: families by call type behind the privacy gate."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("call_id")).distinct()
    kind = classify.privacy_gate(F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("call_id", F.lit(len(_KINDS))) + 1).cast("int")))
    return t.select("call_id", kind.alias("kind"), A.family_of(kind).alias("family"))


@query()
def analyze_mixed(spark, d):
    """K, L1: classified calls with their families' sections as JSON (built-in lexicons)."""
    found = classify.classify(calls(spark, d), _LEX, "n_named")
    return A.analyze(found.select("call_id", "text", "call_type")).select("call_id", "call_type", "family", "sections")


# ---------------------------------------------------------------- topics and speakers

_TOPIC = (
    f"""{EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ord) AS nth, "start" - coalesce(lag("end") OVER (PARTITION BY call_id ORDER BY ord), 0) AS gap FROM ev),
cand AS (SELECT call_id, ord, "start" FROM o WHERE nth = 1 OR gap > 43200 OR contains(lower(coalesce(text, '')), 'purch')),
acc AS (SELECT call_id, list_reduce(list_prepend([NULL::DOUBLE], list({{'o': ord, 'at': "start"}} ORDER BY ord).list_transform(lambda x: [x.at, x.o::DOUBLE])), lambda a, x: CASE WHEN len(a) = 1 THEN [x[1], x[2]] WHEN x[1] - a[1] >= 172800 THEN list_concat([x[1]], list_concat(a[2:], [x[2]])) ELSE a END) AS l FROM cand GROUP BY call_id),
kept AS (SELECT call_id, CAST(unnest(l[2:]) AS BIGINT) AS ord FROM acc)"""
)


@query(f"WITH {_TOPIC} SELECT call_id, count(*) AS n_spans, min(ord) AS first_ord, max(ord) AS last_ord FROM kept GROUP BY call_id")
def topic_boundaries(spark, d):
    """accepted boundaries of each call."""
    s = topics.spans(event_segments(spark, d), 172800, 43200, ["purch"])
    firsts = s.groupBy("call_id", "span").agg(F.min("ord").alias("ord"))
    return firsts.groupBy("call_id").agg(F.count("*").alias("n_spans"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(f"""WITH {_TOPIC}, sp AS (SELECT o.*, sum(CASE WHEN k.ord IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY o.call_id ORDER BY o.ord ROWS UNBOUNDED PRECEDING) - 1 AS span FROM o LEFT JOIN kept k ON k.call_id = o.call_id AND k.ord = o.ord)
SELECT call_id, CAST(span AS BIGINT) AS span, arg_min(text, ord) AS name, arg_min("start", ord) AS start_seconds, arg_max("end", ord) AS end_seconds, array_to_string(list_sort(list_distinct(list(speaker))), '|') AS speakers, regexp_replace(split_part(string_agg(text, ' ' ORDER BY ord), '.', 1), '^\\s+|\\s+$', '', 'g') || '.' AS summary, count(*) AS n_segments FROM sp WHERE span < 5 GROUP BY call_id, span""")
def topic_segments(spark, d):
    """F5, G6."""
    t = topics.topics(event_segments(spark, d), 172800, 5, 43200, ["purch"])
    return t.withColumn("speakers", joined(F.col("speakers"))).withColumn("span", F.col("span").cast("bigint"))


@query(f"""WITH {SEG}, line AS (SELECT call_id, ord, "start" - 0.5 AS a, "end" - 0.5 AS b, 'S' || CAST(ord % 3 AS VARCHAR) AS label FROM seg WHERE ord % 4 <> 3),
m AS (SELECT s.call_id, s.ord, line.label, row_number() OVER (PARTITION BY s.call_id, s.ord ORDER BY line.ord) AS k FROM seg s JOIN line ON line.call_id = s.call_id AND (s."start" + s."end") / 2 BETWEEN line.a AND line.b) SELECT call_id, ord, label FROM m WHERE k = 1""")
def labels_by_time(spark, d):
    """Interval join, the first match of each segment."""
    s = segments(spark, d)
    line = s.where("ord % 4 <> 3").select("call_id", "ord", (F.col("start") - 0.5).alias("start"), (F.col("end") - 0.5).alias("end"), F.concat(F.lit("S"), F.pmod("ord", F.lit(3)).cast("string")).alias("label"))
    return enrich.labels_by_time(s, line)


@query(f"""WITH {EVENTS}, t AS (SELECT *, CASE WHEN "start" - coalesce(lag("end") OVER (PARTITION BY call_id ORDER BY ord), 0) > 20000 THEN 1 ELSE 0 END AS step FROM ev), u AS (SELECT *, sum(step) OVER (PARTITION BY call_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS turns FROM t) SELECT call_id, ord, 'S' || CAST(turns % (call_id % 3 + 1) AS VARCHAR) AS label FROM u""".replace("CAST(turns % (call_id % 3 + 1) AS VARCHAR)", "CAST(CAST(turns % (call_id % 3 + 1) AS BIGINT) AS VARCHAR)"))
def labels_by_pause(spark, d):
    """labels in turn, the next after each longer pause."""
    e = event_segments(spark, d)
    labels = e.select("call_id").distinct().select("call_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.pmod("call_id", F.lit(3)).cast("int")), lambda i: F.concat(F.lit("S"), i.cast("string")))).alias("place", "label"))
    return enrich.labels_by_pause(e, labels, 20000)


@query("SELECT o_custkey AS call_id, 'L' || CAST(o_orderkey % 3 AS VARCHAR) AS label, arg_max(coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END, ''), o_orderstatus), o_orderkey) AS speaker, arg_max(o_orderstatus, o_orderkey) AS speaker_cluster_id, arg_max(o_totalprice, o_orderkey) AS speaker_confidence FROM orders GROUP BY ALL")
def label_map(spark, d):
    """The last of repeated labels wins."""
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("L"), F.pmod("o_orderkey", F.lit(3)).cast("string")).alias("local_label"), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_orderpriority")).otherwise("").alias("display_name"), F.col("o_orderstatus").alias("speaker_cluster_id"), F.col("o_totalprice").alias("confidence"))
    return enrich.label_map(r)


# ---------------------------------------------------------------- texts and documents


@query(r"""SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS words, CASE WHEN len(regexp_extract_all(text, '\S+')) <= 20 THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 20), ' ') || ' [cut]' END AS short, left(replace(lower(text), ' ', '-'), 30) AS slug, replace(replace(replace(text, '|', '\|'), '<', '&lt;'), '>', '&gt;') AS safe, left(sha256(text), 16) AS hash FROM documents""")
def text_functions(spark, d):
    """C1, C6, C7, C10, C17 and content hashes."""
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), T.truncate_words("text", 20, " [cut]").alias("short"), T.slug("text").alias("slug"), T.markdown("text").alias("safe"), T.content_hash("text").alias("hash"))


@query(rf"""WITH {SEG}, t AS (SELECT DISTINCT call_id, 'call/' || CASE WHEN call_id % 2 = 0 THEN 'qbr' ELSE 'podcast' END AS tag FROM seg UNION SELECT call_id, 'speaker/' || speaker FROM seg UNION SELECT call_id, 'topic/' || left(replace(lower(coalesce(text, '')), ' ', '-'), 30) FROM seg) SELECT call_id, array_to_string(list_sort(list(tag)), ' ') AS tags FROM t GROUP BY call_id""")
def tags(spark, d):
    """L2, H4."""
    s = segments(spark, d)
    c = s.select("call_id", F.when(F.pmod("call_id", F.lit(2)) == 0, "qbr").otherwise("podcast").alias("call_type")).distinct()
    t = reports.tags(c, s.select("call_id", F.coalesce("speaker", F.lit("Unknown")).alias("speaker")), s.select("call_id", F.coalesce("text", F.lit("")).alias("name")))
    return t.withColumn("tags", F.array_join("tags", " "))


@query("""SELECT event_id, json_object('k', json_extract(props, '$.k'))::VARCHAR AS props FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def filter_fields(spark, d):
    """C11: dotted paths of JSON documents."""
    return reports.filter_fields(table(spark, d, "events").where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", "props"), "props", ["k", "missing.path"])


@query()
def call_reports(spark, d):
    """L4: Markdown per call."""
    s = segments(spark, d)
    c = classify.classify(calls(spark, d), _LEX, "n_named")
    return reports.call_report(c.select("call_id", "call_type"), communication.speaker_stats(s), topics.topics(s))


@query()
def call_documents(spark, d):
    """One JSON document per call."""
    c = classify.classify(calls(spark, d), _LEX, "n_named")
    return c.select("call_id", reports.document(["call_id", "call_type", "confidence", "scores"], ["call_type", "confidence"]).alias("document"))


@query(rf"""WITH {CALLS} SELECT call_id, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS BIGINT) AS word_count, 12.5::DOUBLE AS duration_seconds FROM calls""")
def summaries(spark, d):
    """Words and duration (the opening's lookbehind has no counterpart in RE2; tests cover it)."""
    return extract.summary(calls(spark, d).select("call_id", "text", F.lit(0.0).alias("first_start"), F.lit(12.5).alias("last_end"))).select("call_id", "word_count", "duration_seconds")
