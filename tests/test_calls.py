"""Operators on small calls with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import analyzers, chunks, classify, communication, enrich, extract, identity, topics
from palaver.plans import calls as plan
from palaver.sources import sinks
from palaver.sources import transcripts as S
from palaver.streaming import incremental as stream

SEG = "call_id string, ord int, start double, end double, speaker string, text string"


def seg(spark, *rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], SEG)


def test_alternating_speakers(spark):
    s = communication.speaker_stats(seg(spark, (0.0, 1.0, "A", "one two"), (1.0, 2.0, "B", "three?"), (2.0, 3.0, "A", "four"), (3.0, 4.0, "B", "")))
    m = communication.call_metrics(s).first()
    assert (m.total_speakers, m.total_words, m.total_questions, m.speaker_switches_per_segment) == (2, 4, 1, 0.75)
    assert {r.speaker: (r.word_count, r.longest_monologue_words) for r in s.collect()} == {"A": (3, 2), "B": (1, 1)}


def test_one_speaker_and_nulls(spark):
    s = communication.speaker_stats(seg(spark, (0.0, 1.0, None, None), (1.0, 2.0, None, "a b"), (2.0, 3.0, None, "c ? ")))
    r = s.first()
    assert (r.speaker, r.word_count, r.longest_monologue_words, r.question_count) == ("Unknown", 4, 4, 1)
    m = communication.call_metrics(s).first()
    assert (m.speaking_balance, m.speaker_switches_per_segment) == (1.0, 0.0)
    assert communication.call_metrics(communication.speaker_stats(seg(spark, (0.0, 1.0, "A", "x")).limit(0))).count() == 0


def test_classification(spark):
    df = spark.createDataFrame([("a", "Hello.", 0), ("b", "just a short note", 1), ("c", "Our ROI and pricing and budget and deal and contract", 2), ("d", None, 0)], "call_id string, text string, n int")
    out = {r.call_id: r for r in classify.classify(df, None, "n").collect()}
    assert (out["a"].call_type, out["a"].confidence) == ("unknown", 0.0) and out["d"].call_type == "unknown"
    assert (out["b"].call_type, out["b"].confidence) == ("voice-memo", 0.7)
    assert (out["c"].call_type, out["c"].confidence) == ("sales-call", round(5 / 15, 3))
    assert out["c"].scores[0].call_type == "sales-call" and len(out["c"].scores) == 23
    custom = classify.merge_lexicons({"mine": ["HELLO"]})
    assert classify.classify(df, custom, "n").where("call_id = 'a'").first().call_type == "mine"


def test_items(spark):
    s = seg(spark, (0.0, 1.0, "A", "I will send the report. We should send it."), (1.0, 2.0, "B", "Action item: call Bob today"), (2.0, 3.0, "B", "We agreed to ship it. will send the report"), (3.0, 4.0, "B", "Ok?"))
    assert [(r.ord, r.item) for r in extract.action_items(s).orderBy("ord", "pattern", "place").collect()] == [(0, "send the report"), (0, "send it"), (1, "call Bob today")]
    assert [r.item for r in extract.decisions(s).collect()] == ["to ship it"]
    assert [r.question for r in extract.questions(s).collect()] == ["Ok?"]


def test_summary(spark):
    df = spark.createDataFrame([("c", "First one here. Moving on now! Third is this? Short. Fourth and last one.", 1.0, 61.04), ("d", "tiny", None, None)], "call_id string, text string, first_start double, last_end double")
    a, b = extract.summary(df).orderBy("call_id").collect()
    assert (a.opening, a.duration_seconds, a.topic_shifts) == ("First one here. Moving on now! Third is this?", 60.0, 1)
    assert (b.opening, b.duration_seconds, b.topic_shifts) == ("tiny", None, 0)


def test_topic_boundaries(spark):
    at = (0.0, 10.0, 70.0, 80.0, 140.0)
    s = seg(spark, *((x, x + 1, "A", "moving on" if i else " First.. ") for i, x in enumerate(at)))
    t = topics.topics(s).orderBy("span").collect()
    assert [(r.start_seconds, r.end_seconds) for r in t] == [(0.0, 11.0), (70.0, 81.0), (140.0, 141.0)]
    assert t[0].name == "First" and t[1].summary == "moving on moving on."
    # a gap of exactly five seconds is no pause; the least duration itself is enough
    assert topics.topics(seg(spark, (0.0, 55.0, "A", ""), (60.0, 61.0, "A", "x"))).count() == 1
    assert topics.topics(seg(spark, (0.0, 54.9, "A", ""), (60.0, 61.0, "B", "x"))).orderBy("span").first().name == "Topic 1"


def test_enrichment(spark):
    s = spark.createDataFrame([("t", 0, 0.0, 2.0, None, "a"), ("t", 1, 2.0, 4.0, None, "b"), ("t", 2, 9.0, 10.0, None, "c"), ("p", 0, 2.5, 3.0, None, "x"), ("p", 1, 5.0, 6.0, None, "y"), ("p", 2, 9.0, 9.5, None, "z"), ("h", 0, 0.0, 1.0, "Zoe", "q")], SEG)
    resolved = spark.createDataFrame([("t", 0, "S0", "k0", "Ann", 0.9), ("p", 0, "S0", "k0", "Ann", 0.9), ("p", 1, "S1", "k1", None, 0.5), ("h", 0, "S0", "k9", "Other", 0.1)], "call_id string, ord int, local_label string, speaker_cluster_id string, display_name string, confidence double")
    line = spark.createDataFrame([("t", 0, 0.0, 1.0, "S0"), ("t", 1, 1.0, 3.0, "S7")], "call_id string, ord int, start double, end double, label string")
    out = {(r.call_id, r.ord): r.speaker for r in enrich.enrich(s, resolved, line).collect()}
    # a middle on a border belongs to the first interval; unknown labels stay names; exactly two seconds are no pause
    assert out == {("t", 0): "Ann", ("t", 1): "S7", ("t", 2): None, ("p", 0): "k1", ("p", 1): "k1", ("p", 2): "Ann", ("h", 0): "Zoe"}


def test_families(spark):
    df = spark.createDataFrame([("q", "We love it but want to cancel. Add-on please.", "qbr"), ("r", "went well, next time improve", "sprint-retro"), ("x", "anything", "nothing")], "call_id string, text string, call_type string")
    out = {r.call_id: (r.family, json.loads(r.sections)) for r in analyzers.analyze(df).collect()}
    assert out["q"][0] == "qbr" and out["q"][1]["health_score"] == 6 and out["q"][1]["churn_level"] == "medium" and out["q"][1]["expansion_signals"] == ["add-on"]
    assert out["r"][1]["went_well"] == ["went well"] and out["r"][1]["to_improve"] == ["improve", "next time"] and "blamelessness" not in out["r"][1]
    assert out["x"] == ("simple", {}) and len(analyzers.DISPATCH) == 46


def test_text_functions(spark):
    df = spark.createDataFrame([("", None), ("a b\xa0c", "Ann"), (" x? ", "Ann Lee")], "t string, n string")
    rows = df.select(T.word_count("t").alias("w"), T.is_question("t").alias("q"), T.clock(F.lit(3725.9)).alias("c"), T.safe_name("n").alias("s"), T.names_match("n", F.lit("ann  ")).alias("m")).collect()
    assert [(r.w, r.q, r.c, r.s, r.m) for r in rows] == [(0, False, "62:05", "unknown", False), (3, False, "62:05", "Ann", True), (1, True, "62:05", "Ann_Lee", True)]
    pairs = [(None, "Ann", True), ("Ann", "Ann Lee", True), ("Ann Lee", "Ann", False), ("Ann (possible)", "Ann (likely)", True), ("Ann (likely)", "Ann", True), ("Bo", "Ann", False)]
    up = spark.createDataFrame(pairs, "o string, n string, want boolean")
    assert up.where(T.is_upgrade("o", "n") != F.col("want")).count() == 0


def test_history_and_aliases(spark):
    entry = "struct<name:string,confidence:double>"
    df = spark.createDataFrame([(None, [("x", 0.5)]), ([("a", 0.5)], [("a", 0.5)]), ([(str(i), 0.1) for i in range(20)], [("n", 0.9)])], f"h array<{entry}>, e array<{entry}>")
    got = [r.h for r in df.select(identity.add_history("h", F.get("e", F.lit(0))).alias("h")).collect()]
    assert [len(h) for h in got] == [1, 1, 20] and got[2][-1].name == "n" and got[2][0].name == "1"
    al = df.limit(1).select(identity.aliases(F.array(F.lit("Zed")), F.lit("Ann (likely)"), F.lit("Ann Lee"), F.lit("Annie"), F.lit("Ann Lee")).alias("a")).first().a
    assert al == ["Ann", "Annie", "Zed"]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "calls"
    (d / "sub").mkdir(parents=True)
    doc = {"segments": [{"start": 0, "end": 2, "text": "Hello there.", "speaker": "A"}, {"start": 2, "end": 3, "text": "I will call you.", "speaker": "B"}]}
    (d / "one.json").write_text(json.dumps(doc))
    chunked = {"text": "x", "segments": [{"start": 0, "end": 1, "text": "x", "speaker": "A"}], "llm_analysis": {"chunked": True, "chunk_count": 2, "classification": {"type": "qbr"}, "chunks": [{"title": "", "action_items": ["Do it now", {"text": "do it now"}, {"action": "Other thing"}], "end_time": 5, "duration_seconds": 5}, {"title": "Two", "speakers_identified": ["A"], "duration_seconds": 2.5}]}}
    (d / "sub/two.json").write_text(json.dumps(chunked))
    (d / "bad.json").write_text("{nope")
    (d / "manifest.json").write_text("{}")
    (d / "empty.json").write_text("{}")
    return d


def test_whole_plan(spark, folder):
    t = S.read_transcripts(spark, str(folder))
    assert {r.call_id: r.text for r in t.collect()} == {"one": "Hello there. I will call you.", "sub/two": "x"}
    out = plan.analyze(t)
    kinds = {r.call_id: (r.call_type, r.confidence) for r in out["calls"].collect()}
    assert kinds["sub/two"] == ("qbr", 0.9) and kinds["one"][0] == "unknown"
    assert sorted((r.call_id, r.item) for r in out["actions"].collect()) == [("one", "call you"), ("sub/two", "Do it now"), ("sub/two", "Other thing")]
    assert sorted((r.call_id, r.name) for r in out["topics"].collect()) == [("one", "Hello there"), ("sub/two", "Part 1"), ("sub/two", "Two")]
    assert {r.call_id: r.tags for r in out["tags"].collect()}["one"] == ["call/unknown", "speaker/A", "speaker/B", "topic/hello-there"]
    m = chunks.metadata(t.where("call_id = 'sub/two'")).first()
    assert (m.chunk_count, m.total_duration, m.chunk_titles) == (2, 7.5, ["", "Two"])
    assert plan.with_model(out["calls"]).where("reply is not null").count() == 0
    assert {r.reply for r in plan.with_model(out["calls"], lambda p: None if p == "x" else p.upper()).collect()} == {None, "HELLO THERE. I WILL CALL YOU."}


def test_stream_processes_each_file_once(spark, folder, tmp_path):
    run = lambda: stream.process_new(stream.new_transcripts(spark, str(folder)), lambda df: df.select("call_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    (folder / "three.json").write_text(json.dumps({"text": "late"}))
    run()
    assert sorted(r.call_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "sub/two", "three"]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a/b", "x", 1), ("", "y", 2)], "task_type string, f string, n int")
    sinks.append_episodes(e, str(tmp_path / "ep"))
    sinks.append_episodes(e, str(tmp_path / "ep"))
    assert {r.task_type: r["count"] for r in spark.read.json(str(tmp_path / "ep")).groupBy("task_type").count().collect()} == {"a_b": 2, "unknown": 2}
    sinks.append_usage(spark.createDataFrame([("m", None)], "model string, call_type string"), str(tmp_path / "u"), "f.json", "qbr")
    assert S.read_usage(spark, str(tmp_path / "u")).first().call_type == "qbr"
    assert sinks.clear(spark, str(tmp_path / "u")) == 1 and not (tmp_path / "u").exists()
    for n in (1, 2):
        sinks.replace_table(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_calendar_events(spark):
    from palaver.sources import calendars

    row = [("Sync", (("Ann", "a@x"),), [((None, "b@x"),), (("Cy", "c@x"),)], ("weekly",), ("Room",), "hello"), (None, None, None, None, None, None)]
    a, b = calendars.parse(spark.createDataFrame(row, calendars.EVENT)).collect()
    assert (a.subject, a.organizer, a.attendees, a.is_recurring, a.series_name, a.location) == ("Sync", "Ann", ["b@x", "Cy"], True, "Sync", "Room")
    assert (b.subject, b.organizer, b.attendees, b.is_recurring, b.series_name) == ("", "", [], False, None)


def test_model_calls(spark):
    from palaver.plans import model

    tried = []

    def flaky(p):
        tried.append(p)
        if len(tried) < 3:
            raise ConnectionError
        return "ok"

    waits = []
    assert model.with_retries(flaky, sleep=waits.append)("x") == "ok" and waits == [1.0, 2.0]
    assert model.with_retries(lambda p: 1 / 0, sleep=waits.append)("x") is None and len(waits) == 2
    assert model.exit_code(FileNotFoundError("x")) == 3 and model.exit_code(RuntimeError("request timed out")) == 6
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    grid = model.run_benchmark(one("model", "a", "b"), one("task", "t").withColumn("template", F.lit("say {transcript}")), one("fixture", "f").withColumn("transcript", F.lit("hi")), lambda p: p)
    assert sorted(r.response for r in grid.collect()) == ["a\nsay hi", "b\nsay hi"]
    assert spark.range(1).select(model.render("{a}-{b}", a="x", b=F.lit("y")).alias("p")).first().p == "x-y"


def test_profiles(spark):
    resolved = spark.createDataFrame([("c1", "k1", "Ann Lee", "ok", 0), ("c2", "k1", None, None, 1), ("c2", "k2", None, None, 2)], "call_id string, speaker_cluster_id string, display_name string, status string, pos int")
    p = identity.profiles(resolved, identity.confirmed_evidence(resolved))
    assert {r.cluster_id: (r.total_calls, r.display_name) for r in p.collect()} == {"k1": (2, "Ann Lee"), "k2": (1, "k2")}
    assert [r.cluster_id for r in identity.find_profile(p, "ann").collect()] == ["k1"]


def test_settings(tmp_path):
    from palaver.sources import config

    f = tmp_path / "s.json"
    f.write_text('{"competitors": ["X"], "max_topics": 3}')
    s = config.settings(str(f), max_topics=5, methodology=None)
    assert (s.competitors, s.max_topics, s.methodology) == (("X",), 5, "meddic")
    with pytest.raises(ValueError):
        config.settings(methodology="none")
    with pytest.raises(ValueError):
        config.settings(colour="red")


def test_command_line(spark, folder, capsys):
    from palaver.__main__ import main

    assert main(["classify", str(folder)]) == 0
    assert '"call_id":"one"' in capsys.readouterr().out
    assert main(["analyze", str(folder), "--table", "topics", "--format", "markdown"]) == 0
    assert "Hello there" in capsys.readouterr().out
    assert main(["list-types"]) == 0 and main(["usage", str(folder / "none")]) != 0 and main(["prep", str(folder)]) == 2


def test_commands_over_stored_data(spark, tmp_path, capsys):
    from palaver.__main__ import main

    def run(*args):
        assert main([str(x) for x in args]) == 0, capsys.readouterr().err
        return capsys.readouterr().out

    # the same file name in two folders, and a name that is special to the speakers' scan only
    d = tmp_path / "in"
    for sub, who in (("a", "Ann Lee"), ("b", None)):
        (d / sub).mkdir(parents=True)
        doc = {"segments": [{"start": 0, "end": 2, "text": "We have pricing and budget to discuss?", "speaker": "S0"}], "diarization": {"speakers_resolved": [{"local_label": "S0", "speaker_cluster_id": "k1", "display_name": who, "status": "ok"}]}, "metadata": {"audio": {"creation_time": "2024-01-01"}}}
        (d / sub / "call.json").write_text(json.dumps(doc))
    (d / "embeddings-talk.json").write_text(json.dumps({"text": "hello"}))
    out = tmp_path / "out"
    assert run("analyze", d, "--dry-run").count("call_id") == 3
    assert run("analyze", d, "--out", out, "--table", "reports").count("**Type:**") == 3
    assert run("analyze", d, "--out", out, "--new-only") == "\n"
    docs = [json.loads(r.document) for r in spark.read.parquet(str(out / "documents")).collect()]
    assert sorted(x["source"] for x in docs) == ["a/call", "b/call", "embeddings-talk"]
    one = next(x for x in docs if x["source"] == "a/call")
    assert one["analysis"]["questions"][0]["text"].endswith("discuss?") and one["communication"]["speakers"][0]["word_count"] == 7
    assert {r.call_id: r.total_segments for r in spark.read.parquet(str(out / "metrics")).collect()}["embeddings-talk"] == 0
    assert "### Ann Lee (k1)" in run("speakers", d, "-o", "markdown").replace("\\n", "\n")
    assert '"display_name":"Ann Lee"' in run("speakers", d, "--find", "ann") and "Ann_Lee.md" in run("speakers", d, "--pages", "--out", out)
    # episodes
    ep = tmp_path / "ep"
    ep.mkdir()
    rows = [{"episode_id": str(k), "timestamp": f"2024-01-0{k}", "context": {"task_type": "pmf-call"}, "outcome": {"scores": {"overall": float(k)}, "findings": ["very disappointed", "anti-pmf flag" if k == 2 else "workflow signal"]}} for k in range(1, 5)]
    (ep / "x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    page = run("dashboard", ep, "--out", out)
    for part in ("from 4 customer calls", "Very Disappointed: 100% (4)", "✅", "Average: 2.5/10 across 4", "1.5, second half avg: 3.5 → **improving**", "anti-pmf flag *(seen 1x)*"):
        assert part in page, part
    assert (out / "semantic/playbooks").exists()
    prep = run("prep", ep, "--type", "pmf-call")
    assert "# Call Prep: Pmf Call" in prep and "- very disappointed" in prep and "Recent avg score: 2.5/10 across 4 calls" in prep and "## Playbook Reference" in prep
    # runs
    b = tmp_path / "b"
    b.mkdir()
    for k, q in ((1, 5.0), (2, 6.0)):
        (b / f"benchmark-2024010{k}.json").write_text(json.dumps({"timestamp": f"2024-01-0{k}", "models_tested": 1, "results": [{"model": "m", "avg_quality": q, "tier": 2, "avg_latency_ms": 10 * k}]}))
    (b / "benchmark-latest.json").write_text(json.dumps({"timestamp": "x", "in_progress": True, "results": []}))
    assert run("benchmark", b).count("file_name") == 2
    assert '"status":"improved"' in run("benchmark", b, "--compare") and '"latency_delta_ms":10' in run("benchmark", b, "--compare", "benchmark-20240101.json,benchmark-20240102.json")
    assert "improving (5.0 → 6.0)" in run("benchmark", b, "--trend", "m", "-o", "markdown")
    # usage
    u = tmp_path / "u.jsonl"
    u.write_text(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "model": "m", "input_tokens": 1, "output_tokens": 2, "cost_usd": 0.5, "latency_ms": 3}))
    assert '"calls":1' in run("usage", u, "--all") and '"calls":0' in run("usage", u) and "p50_latency" in run("usage", u, "--all", "--table", "models", "-o", "yaml")


def test_swap_brings_back_what_a_crash_left(spark, tmp_path):
    sinks.replace_table(spark.range(1), str(tmp_path / "t"))
    (tmp_path / "t").rename(tmp_path / "t.old")  # the old version was moved aside, then the run died
    sinks.replace_table(spark.range(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and not (tmp_path / "t.old").exists()


def test_emit_says_what_it_leaves_out(spark):
    assert sinks.emit(spark.range(5), most=2).endswith("(3 more rows; write them to a folder to see all)")
    assert sinks.emit(spark.range(1).selectExpr("id", "'x' as t"), "yaml") == '- id: 0\n  t: "x"'


def test_sections_of_families(spark):
    from palaver.plans import documents

    s = spark.createDataFrame([("d", 0, 0.0, 1.0, "A", "It is frustrating to wait."), ("p", 0, 0.0, 1.0, "A", " ".join(["word"] * 30)), ("p", 1, 1.0, 2.0, "B", "Yes."), ("f", 0, 0.0, 1.0, "A", "I hear you, we agree. You never listen")], SEG)
    t = s.groupBy("call_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    kinds = F.when(F.col("call_id") == "d", "discovery-call").when(F.col("call_id") == "p", "podcast").otherwise("family")
    typed = analyzers.analyze(t.withColumn("call_type", kinds).withColumn("confidence", F.lit(0.5)).withColumn("scores", F.array().cast("array<struct<call_type:string,score:double>>")))
    st = communication.speaker_stats(s)
    out = documents.analyses(typed, t, s, st)
    got = {r.call_id: json.loads(r.analysis) for r in out.collect()}
    assert got["d"]["pain_points"][0]["keyword"] == "frustrating" and got["d"]["commitment_signals"] == []
    assert got["p"]["guest"] == "B" and got["p"]["host"] == "A" and len(got["p"]["key_quotes"]) == 1 and got["p"]["summary"]["word_count"] == 31
    f = got["f"]
    assert "summary" not in f and f["we_i_language"][0]["we_count"] == 1 and f["validation_moments"][0]["keyword"] == "i hear you" and f["gottman_indicators"][0]["keyword"] == "you never" and f["appreciation"] == "neutral"
    pages = {r.call_id: r.markdown for r in documents.reports(out, st, communication.call_metrics(st), topics.topics(s)).collect()}
    assert "## Pain Points" in pages["d"] and "## Cast" in pages["p"] and "## Validation Moments" in pages["f"] and "## Attendees" not in pages["f"]
    only = {r.call_id: json.loads(r.document) for r in documents.documents(out, st, communication.call_metrics(st), topics.topics(s), ["pain_points", "communication"]).collect()}
    assert set(only["d"]) == {"source", "classification", "communication", "analysis"} and set(only["d"]["analysis"]) == {"call_type", "pain_points"} and "analysis" not in only["p"]
    sold = analyzers.analyze(t.withColumn("call_type", F.lit("sales-call")), competitors=["Agree"]).where("call_id = 'f'").first()
    assert json.loads(sold.sections)["competitor_mentions"] == ["Agree"]
