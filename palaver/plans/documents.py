"""The full analysis of calls as documents: sections by family, nested JSON, Markdown reports, dashboards.

A call's sections are gathered per call because a document holds them; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import lexicons as L
from palaver.functions import text as T
from palaver.operators import communication, extract, ordering


def gather(rows: DataFrame, name: str, order: list[str], fields: dict[str, str | Column]) -> DataFrame:
    """Per call the rows' fields as an array of structs, in order."""
    kept = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()])
    return rows.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct(*order, kept.alias("_row")))).alias("_all")).select("call_id", F.transform("_all", lambda r: r["_row"]).alias(name))


SAID = {"text": "item", "speaker": "speaker", "timestamp": "start"}


def business(transcripts: DataFrame, segments: DataFrame, stats: DataFrame) -> DataFrame:
    """Sections of every call but private ones: summary, action items, decisions, questions, attendees."""
    ends = segments.groupBy("call_id").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    calls = transcripts.select("call_id", "text").join(ends, "call_id", "left")
    s = extract.summary(calls).select("call_id", F.struct(F.col("opening").alias("text"), "word_count", "duration_seconds", "topic_shifts", F.lit("rule-based").alias("method")).alias("summary"))
    parts = [
        gather(extract.action_items(segments), "action_items", ["ord", "pattern", "place"], SAID),
        gather(extract.decisions(segments), "decisions", ["ord", "pattern", "place"], SAID),
        gather(extract.questions(segments), "questions", ["ord"], {"text": "question", "speaker": "speaker", "timestamp": "start"}),
        gather(stats, "attendees", ["speaker"], {"speaker": "speaker", "word_count": "word_count", "segment_count": "segment_count", "talk_ratio": "talk_ratio"}),
    ]
    for p in parts:
        s = s.join(p, "call_id", "left")
    return s


def by_segments(calls: DataFrame, segments: DataFrame, stats: DataFrame) -> DataFrame:
    """Sections that come from single segments, for calls (call_id, family): pain points of discovery calls, quotes, host and
    guest of podcasts, and what a relationship analysis looks at.  Only the families that want them are computed."""
    of = lambda family, df: df.join(calls.where(F.col("family") == family).select("call_id"), "call_id", "left_semi")
    close, talk, cast = of("relationship", segments), of("relationship", stats), of("podcast", segments)
    quoted = {"text": "quote", "speaker": "speaker", "keyword": "keyword", "timestamp": "start"}
    starts = cast.select("call_id", "ord", "start")
    parts = [
        gather(extract.keyword_segments(of("discovery", segments), L.PAINS, True), "pain_points", ["ord"], {"pain": "quote", "keyword": "keyword", "speaker": "speaker", "timestamp": "start"}),
        gather(communication.key_quotes(cast).join(starts, ["call_id", "ord"]), "key_quotes", ["place"], {"text": "quote", "speaker": "speaker", "timestamp": "start"}),
        communication.host_and_guest(cast),
        gather(talk, "listening_balance", ["speaker"], {"speaker": "speaker", "talk_ratio": "talk_ratio", "questions_asked": "question_count"}),
        gather(communication.we_i_language(close), "we_i_language", ["first_ord"], {k: k for k in ("speaker", "we_count", "i_count", "collaborative_ratio")}),
        gather(extract.keyword_segments(close, L.RELATIONSHIP["validation"]), "validation_moments", ["ord"], quoted),
        gather(communication.engagement(close), "engagement_signals", ["speaker"], {k: k for k in ("speaker", "avg_words_per_turn", "one_word_answers", "total_turns")}),
        gather(extract.keyword_segments(close, L.RELATIONSHIP["criticism"]), "gottman_indicators", ["ord"], quoted),
    ]
    out = calls.select("call_id")
    for p in parts:
        out = out.join(p, "call_id", "left")
    return out


FAMILY_SECTIONS = ("pain_points", "key_quotes", "guest", "host", "listening_balance", "we_i_language", "validation_moments", "engagement_signals", "gottman_indicators")
BUSINESS_SECTIONS = ("summary", "action_items", "decisions", "questions", "attendees")


def analyses(calls: DataFrame, transcripts: DataFrame, segments: DataFrame, stats: DataFrame) -> DataFrame:
    """``calls`` (call_id, call_type, family, sections, ...) with every section, and all of them as the JSON object ``analysis``."""
    out = calls.join(business(transcripts, segments, stats), "call_id", "left").join(by_segments(calls, segments, stats), "call_id", "left")
    open_to_all = F.col("family") != "relationship"
    for name in BUSINESS_SECTIONS:
        out = out.withColumn(name, F.when(open_to_all, F.col(name)))
    own = F.to_json(F.struct("call_type", *BUSINESS_SECTIONS, *FAMILY_SECTIONS))
    # two JSON objects made one; the family's comes last
    both = F.when(F.col("sections") == "{}", own).otherwise(F.concat(F.expr("left(_own, length(_own) - 1)"), F.lit(","), F.expr("substring(sections, 2)")))
    return out.withColumn("_own", own).withColumn("analysis", both).drop("_own")


def documents(analysed: DataFrame, stats: DataFrame, metrics: DataFrame, topics: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """Per call one nested JSON document: classification, communication, topics, analysis.

    ``sections`` keeps only those named; the analysis goes if nothing of it is named.
    """
    wanted = lambda name: sections is None or name in sections
    speakers = gather(stats, "speakers", ["speaker"], {c: c for c in ("speaker", "word_count", "segment_count", "question_count", "talk_ratio", "avg_words_per_turn", "longest_monologue_words")})
    spans = gather(topics, "topics", ["span"], {c: c for c in ("name", "start_seconds", "end_seconds", "speakers", "summary")})
    numbers = [c for c in metrics.columns if c != "call_id"]
    out = analysed.join(metrics.join(speakers, "call_id", "left").select("call_id", F.struct(*numbers, "speakers").alias("communication")), "call_id", "left").join(spans, "call_id", "left")
    plain = F.to_json(F.struct("source", F.struct("call_type", "confidence", "scores").alias("classification"), *[c for c in ("communication", "topics") if wanted(c)])) if "source" in out.columns else F.to_json(F.struct(F.col("call_id").alias("source"), F.struct("call_type", "confidence", "scores").alias("classification"), *[c for c in ("communication", "topics") if wanted(c)]))
    if sections is None:
        analysis = F.col("analysis")
    else:
        own = [c for c in (*BUSINESS_SECTIONS, *FAMILY_SECTIONS) if c in sections]
        rest = [F.try_variant_get(F.try_parse_json("sections"), f"$.{c}", "variant").alias(c) for c in sections if c not in own and c not in ("communication", "topics")]
        chosen = F.to_json(F.struct(*own, *rest)) if own or rest else F.lit("{}")
        analysis = F.when(chosen != "{}", F.concat(F.lit('{"call_type":'), F.to_json(F.array("call_type")).substr(F.lit(2), F.length(F.to_json(F.array("call_type"))) - 2), F.lit(","), F.expr("substring(_chosen, 2)")))
        out = out.withColumn("_chosen", chosen)
    return out.withColumn("_plain", plain).select("call_id", F.when(analysis.isNull(), F.col("_plain")).otherwise(F.concat(F.expr("left(_plain, length(_plain) - 1)"), F.lit(',"analysis":'), analysis, F.lit("}"))).alias("document"))


# ---------------------------------------------------------------- Markdown


def _lines(items: Column, line) -> Column:
    """Items as lines; null without items."""
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.array_join(F.transform(items, line), "\n"))


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))


def _at(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.concat(F.lit(" ("), T.clock(seconds), F.lit(")"))).otherwise("")


def _said(r) -> Column:
    return F.concat(F.lit("**"), r["speaker"], F.lit("**"), _at(r["timestamp"]), F.lit(": "), r["text"])


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _facts(title: str, facts: dict[str, str]) -> Column:
    """A section of single values; it is left out if the first is missing."""
    rows = [F.when(_get(k).isNotNull(), F.concat(F.lit(f"- **{label}:** "), _get(k))) for k, label in facts.items()]
    return F.when(_get(next(iter(facts))).isNotNull(), _section(title, F.concat_ws("\n", *rows)))


def _terms(title: str, names: dict[str, str]) -> Column:
    """A section of lists of terms; empty lists are left out, and so is a section of empty lists."""
    rows = [F.when(F.size(F.coalesce(_get(k, "array<string>"), F.array())) > 0, F.concat(F.lit(f"- **{label}:** "), F.array_join(_get(k, "array<string>"), ", "))) for k, label in names.items()]
    body = F.concat_ws("\n", *rows)
    return F.when(body != "", _section(title, body))


def _signals(title: str, name: str, level: str) -> Column:
    return _section(title, _lines(_get(name, "array<struct<signal:string,keyword:string>>"), lambda s: F.concat(F.lit(f"- [{level}] "), s["signal"], F.lit(': *"'), s["keyword"], F.lit('"*'))))


def reports(analysed: DataFrame, stats: DataFrame, metrics: DataFrame, topics: DataFrame) -> DataFrame:
    """Per call a Markdown report; sections that a call lacks are left out, their order is fixed."""
    speakers = gather(stats, "_speakers", ["speaker"], {"line": F.concat(F.lit("| "), F.concat_ws(" | ", T.markdown("speaker"), F.col("word_count").cast("string"), F.concat(F.round(F.col("talk_ratio") * 100, 1).cast("string"), F.lit("%")), F.col("question_count").cast("string"), F.concat(F.col("longest_monologue_words").cast("string"), F.lit(" words"))), F.lit(" |"))})
    spans = gather(topics, "_topics", ["span"], {"line": F.concat(F.concat_ws(" | ", T.markdown("name"), T.clock("start_seconds"), T.markdown(F.array_join("speakers", ", "))), F.lit(" |"))})
    out = analysed.join(metrics, "call_id", "left").join(speakers, "call_id", "left").join(spans, "call_id", "left").withColumn("_v", F.try_parse_json("sections"))
    line = lambda r: r["line"]
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    minutes = F.col("summary.duration_seconds")
    parts = [
        F.concat(F.lit("# "), F.col("call_id").cast("string"), F.lit("\n\n**Type:** "), F.col("call_type"), F.lit(" (confidence: "), F.col("confidence").cast("string"), F.lit(")\n")),
        F.when(F.coalesce("total_speakers", F.lit(0)) > 0, _section("Communication", F.concat_ws("\n", F.concat(F.lit("- **Speakers:** "), number("total_speakers")), F.concat(F.lit("- **Total words:** "), number("total_words")), F.concat(F.lit("- **Questions asked:** "), number("total_questions")), F.concat(F.lit("- **Speaking balance:** "), number("speaking_balance")), F.lit("\n| Speaker | Words | Talk % | Questions | Longest Monologue |\n|-|-|-|-|-|"), _lines(F.col("_speakers"), line)))),
        _section("Topics Index", F.concat(F.lit("| # | Topic | Time | Speakers |\n|-|-|-|-|\n"), F.when(F.size(F.coalesce("_topics", F.array())) > 0, F.array_join(F.transform("_topics", lambda r, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), r["line"])), "\n")))),
        _section("Summary", F.concat(F.col("summary.text"), F.when(minutes > 0, F.concat(F.lit("\n\n*Duration: "), F.floor(minutes / 60).cast("string"), F.lit("m "), F.floor(minutes % 60).cast("string"), F.lit("s | "), F.col("summary.word_count").cast("string"), F.lit(" words*"))).otherwise(""))),
        _section("Action Items", _lines(F.col("action_items"), lambda r: F.concat(F.lit("- [ ] "), _said(r)))),
        _section("Key Decisions", _lines(F.col("decisions"), lambda r: F.concat(F.lit("- **"), r["speaker"], F.lit(":** "), r["text"]))),
        _section("Questions Raised", _lines(F.col("questions"), lambda r: F.concat(F.lit("- "), _said(r)))),
        _signals("Buying Signals", "buying_signals", "moderate"),
        _signals("Risk Signals", "risk_signals", "medium"),
        _terms("Competitors", {"competitor_mentions": "Mentioned"}),
        _section("Pain Points", F.concat(F.lit("| Pain | Keyword | Speaker |\n|-|-|-|\n"), _lines(F.col("pain_points"), lambda r: F.concat(F.lit("| "), T.markdown(F.left(r["pain"], F.lit(60))), F.lit(" | "), r["keyword"], F.lit(" | "), T.markdown(r["speaker"]), F.lit(" |"))))),
        _section("Commitment Signals", _lines(_get("commitment_signals", "array<struct<signal:string,keyword:string>>"), lambda s: F.concat(F.lit("- ["), s["signal"], F.lit("] "), s["keyword"], F.lit(" (moderate)")))),
        _terms("Hypothetical Questions", {"hypothetical_questions": "Asked"}),
        _facts("Product-Market Fit", {"pmf_score": "Score", "ellis_classification": "Ellis", "emotional_intensity": "Emotional intensity", "workflow_integration": "Workflow integration", "referral_evangelism": "Referral", "switching_cost": "Switching cost", "feature_request_quality": "Feature requests", "willingness_to_pay": "Willingness to pay"}),
        _terms("Product-Market Fit Signals", {"strongest_signals": "Strongest", "anti_pmf_flags": "Against"}),
        _facts("Interview", {"overall_star_score": "STAR score", "assessment": "Assessment", "components_present": "Components present"}),
        _facts("Support", {"issue_type": "Issue", "severity": "Severity", "start_emotion": "At the start", "end_emotion": "At the end", "resolution_status": "Resolution", "empathy_score": "Empathy"}),
        _facts("Account Health", {"health_score": "Score", "churn_level": "Churn risk", "positive_signals": "Positive signals", "negative_signals": "Negative signals"}),
        _terms("Account Signals", {"expansion_signals": "Expansion", "churn_indicators": "Churn"}),
        _section("Listening Balance", _lines(F.col("listening_balance"), lambda r: F.concat(F.lit("- **"), r["speaker"], F.lit(":** "), F.round(r["talk_ratio"] * 100, 1).cast("string"), F.lit("%, "), r["questions_asked"].cast("string"), F.lit(" questions")))),
        _section("We and I", _lines(F.col("we_i_language"), lambda r: F.concat(F.lit("- **"), r["speaker"], F.lit(":** we "), r["we_count"].cast("string"), F.lit(", I "), r["i_count"].cast("string")))),
        _section("Validation Moments", _lines(F.col("validation_moments"), lambda r: F.concat(F.lit("- "), _said(r)))),
        _facts("Appreciation", {"appreciation": "Assessment", "ratio": "Ratio"}),
        _section("Criticism", _lines(F.col("gottman_indicators"), lambda r: F.concat(F.lit("- "), _said(r)))),
        _section("Key Quotes", _lines(F.col("key_quotes"), lambda r: F.concat(F.lit("- "), _said(r)))),
        F.when(F.col("guest").isNotNull(), _section("Cast", F.concat(F.lit("- **Host:** "), F.col("host"), F.lit("\n- **Guest:** "), F.col("guest")))),
        _section("Attendees", _lines(F.col("attendees"), lambda r: F.concat(F.lit("- **"), r["speaker"], F.lit(":** "), r["word_count"].cast("string"), F.lit(" words")))),
    ]
    return out.select("call_id", F.concat_ws("\n", *parts).alias("markdown"))


# ---------------------------------------------------------------- dashboards and indexes


def pmf_dashboard(episodes: DataFrame, threshold: float = 0.40) -> DataFrame:
    """One row: a Markdown page of episodes (pos, scores, findings): answers, trend of the scores, patterns, counter-signs.

    Each part is an aggregate of one row or of ten; the parts meet as one row.
    """
    from palaver.operators import episodes as E

    found = episodes.select("pos", F.posexplode("findings").alias("place", "finding")).select(F.struct("pos", "place").alias("pos"), "finding")
    n = episodes.agg(F.count("*").alias("calls"))
    kinds = E.ellis_distribution(found, threshold)
    label = F.create_map(*[F.lit(x) for k in (("very_disappointed", "Very Disappointed"), ("somewhat_disappointed", "Somewhat Disappointed"), ("not_disappointed", "Not Disappointed")) for x in k])
    place = F.when(F.col("answer") == "very_disappointed", 0).when(F.col("answer") == "somewhat_disappointed", 1).otherwise(2)
    said = F.concat(F.lit("- "), label[F.col("answer")], F.lit(": "), F.col("pct").cast("string"), F.lit("% ("), F.col("n").cast("string"), F.lit(")"), F.when(F.col("answer") == "very_disappointed", F.lit(f" — target: {int(threshold * 100)}%+")).otherwise(""), F.when(F.col("on_target"), " ✅").otherwise(""))
    answers = kinds.agg(_lines(F.sort_array(F.collect_list(F.struct(place.alias("p"), said.alias("line")))), lambda r: r["line"]).alias("answers"))
    scored = episodes.select("pos", F.try_element_at("scores", F.lit("overall")).alias("score")).where("score is not null")
    t = E.overall_trend(scored, ["pos"])
    trend = t.agg(F.max(F.concat(F.lit("- Average: "), F.col("average").cast("string"), F.lit("/10 across "), F.col("n").cast("string"), F.lit(" calls"), F.coalesce(F.concat(F.lit("\n- First half avg: "), F.col("first_half").cast("string"), F.lit(", second half avg: "), F.col("second_half").cast("string"), F.lit(" → **"), F.col("trend"), F.lit("**")), F.lit("")))).alias("trend"))

    def top(rows: DataFrame, name: str) -> DataFrame:
        counted = E.top_findings(rows, 10)
        line = F.format_string("- %s *(seen %dx)*", "finding", "n")
        return counted.agg(_lines(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "first_pos", line.alias("line")))), lambda r: r["line"]).alias(name))

    low = F.lower("finding")
    against = found.where(F.contains(low, F.lit("anti-pmf")) | F.contains(low, F.lit("anti_pmf")))
    one = n
    for part in (answers, trend, top(found, "patterns"), top(against, "against")):
        one = one.join(F.broadcast(part), how="cross")  # one row each
    page = F.concat_ws("\n", F.concat(F.lit("# PMF Dashboard — Generated from "), F.col("calls").cast("string"), F.lit(" customer calls\n")), _section("Ellis Distribution", F.col("answers")), _section("PMF Score Trend", F.col("trend")), _section("Top Patterns", F.col("patterns")), _section("Anti-PMF Flags", F.col("against")))
    return one.select(F.when(F.col("calls") == 0, "# PMF Dashboard\n\nNo PMF episodes found.\n").otherwise(page).alias("markdown"))


def _percent(c: Column) -> Column:
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def contacts_summary(profiles: DataFrame, last_contact: DataFrame | None = None) -> DataFrame:
    """Named speakers in the order of an index page, the most calls first: place, and the page's line.

    The page itself is these lines in order; they stay rows, since an index has no bound.
    """
    named = profiles.where("coalesce(likely_name, '') <> ''")
    role = F.coalesce("role", F.lit("")) if "role" in profiles.columns else F.lit("")
    last = F.lit("")
    if last_contact is not None:
        named = named.join(last_contact, "cluster_id", "left")
        last = F.coalesce(F.col("last_contact").cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.lit("[["), "display_name", F.lit("]]")), F.col("total_calls").cast("string"), role, _percent(F.col("name_confidence")), last), F.lit(" |"))
    return named.select("cluster_id", "total_calls", line.alias("line")).orderBy(F.col("total_calls").desc(), "cluster_id")


def speaker_report(profiles: DataFrame, evidence: DataFrame, co: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """Per cluster a part of a report, the named ones first and surest first, then the others by calls (listing order)."""
    from palaver.operators import identity

    proof = identity.unique_evidence(evidence)
    line = F.concat(F.lit("  - ["), F.col("source"), F.lit("] "), F.col("name"), F.lit(" ("), _percent(F.col("confidence")), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.left("detail", F.lit(80))), F.lit("")) if "detail" in evidence.columns else F.lit(""))
    held = proof.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "pos", line.alias("line")))).alias("_evidence"))
    out = profiles.join(held, "cluster_id", "left")
    rest = []
    if topics is not None:
        out = out.join(topics.where("place <= 5").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "topic"))).alias("_topics")), "cluster_id", "left")
        rest.append(F.when(F.size("_topics") > 0, F.concat(F.lit("Topics: "), F.array_join(F.transform("_topics", lambda r: r["topic"]), ", "))))
    if co is not None:
        top = identity.top_co_speakers(co, 3).groupBy(F.col("a").alias("cluster_id")).agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.col("b").cast("string"), F.lit(" ("), F.col("calls").cast("string"), F.lit("x)")).alias("line")))).alias("_co"))
        out = out.join(top, "cluster_id", "left")
        rest.append(F.when(F.size("_co") > 0, F.concat(F.lit("Co-speakers: "), F.array_join(F.transform("_co", lambda r: r["line"]), ", "))))
    role = F.coalesce("role", F.lit("unknown")) if "role" in profiles.columns else F.lit("unknown")
    cluster = F.col("cluster_id").cast("string")
    known = F.concat_ws("\n", F.concat(F.lit("### "), "likely_name", F.lit(" ("), cluster, F.lit(")\n**Confidence:** "), _percent(F.col("name_confidence")), F.lit(" | **Calls:** "), F.col("total_calls").cast("string"), F.lit(" | **Role:** "), role), F.concat(F.lit("Evidence:\n"), _lines(F.col("_evidence"), lambda r: r["line"])), *rest)
    named = F.coalesce("likely_name", F.lit("")) != ""
    return out.select("cluster_id", F.when(named, F.lit(0)).otherwise(F.lit(1)).alias("part"), "name_confidence", "total_calls", F.when(named, known).otherwise(F.concat(F.lit("- "), cluster, F.lit(": "), F.col("total_calls").cast("string"), F.lit(" calls"))).alias("markdown")).orderBy("part", F.when(named, -F.col("name_confidence")).otherwise(-F.col("total_calls")), "cluster_id")


def working_memory(task_type: str, recent: DataFrame, dead_ends: DataFrame, playbooks: DataFrame, budget_words: int = 2000) -> DataFrame:
    """One row: a page to prepare a call of a type from its last ten episodes (pos, score, findings), its dead ends (pattern) and its playbook (task_type, markdown)."""
    from palaver.operators import episodes as E

    found = recent.select("pos", F.posexplode(F.slice("findings", 1, 5)).alias("place", "finding")).select(F.struct("pos", "place").alias("pos"), "finding", F.lit(task_type).alias("task_type"))
    notes = E.prep_notes(found, ["task_type"]).agg(_lines(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.col("finding")).alias("line")))), lambda r: r["line"]).alias("notes"))
    ends = dead_ends.agg(_lines(F.collect_list(F.concat(F.lit("- "), F.col("pattern"))), lambda x: x).alias("ends"))
    book = playbooks.where(F.col("task_type") == task_type).agg(F.max(T.truncate_words("markdown", budget_words // 2)).alias("book"))
    score = recent.agg(F.when(F.count("score") > 0, F.concat(F.lit("\n*Recent avg score: "), F.round(F.avg("score"), 1).cast("string"), F.lit("/10 across "), F.count("score").cast("string"), F.lit(" calls*"))).alias("score"))
    one = notes
    for part in (ends, book, score):
        one = one.join(F.broadcast(part), how="cross")  # one row each
    title = F.lit(f"# Call Prep: {task_type.replace('-', ' ').title()}\n")
    page = F.concat_ws("\n", title, _section("Key Patterns from Previous Calls", F.col("notes")), _section("Avoid (Dead Ends)", F.col("ends")), _section("Playbook Reference", F.col("book")), F.col("score"))
    none = F.col("notes").isNull() & F.col("ends").isNull() & F.col("book").isNull()
    return one.select(F.when(none, F.concat(title, F.lit("\nNo previous call data available."))).otherwise(page).alias("markdown"))


def tag_properties(calls: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per call what goes beside its tags: type, confidence, number of speakers and balance, as a map."""
    of = calls.join(metrics, "call_id", "left")
    return of.select("call_id", F.map_filter(F.create_map(F.lit("call_type"), F.col("call_type"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("speakers"), F.col("total_speakers").cast("string"), F.lit("balance"), F.col("speaking_balance").cast("string")), lambda k, v: v.isNotNull()).alias("properties"))


def listing(profiles: DataFrame) -> DataFrame:
    """Profiles in listing order: the surest names first, then those with the most calls."""
    order = [F.col("name_confidence").desc_nulls_last(), F.col("total_calls").desc(), F.col("cluster_id").asc()]
    return ordering.numbered(profiles, order, "place").withColumn("place", F.col("place").cast("int"))
