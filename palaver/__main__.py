"""Command line: python -m palaver COMMAND [PATH] [options]; see ``--help``."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palaver")
    p.add_argument("command", choices=["analyze", "classify", "list-types", "usage", "playbook", "dashboard", "prep", "speakers", "benchmark"])
    p.add_argument("path", nargs="?")
    p.add_argument("--out", help="folder for results")
    p.add_argument("--config")
    p.add_argument("--type", help="call type: override, or the one to look at")
    p.add_argument("--no-recursive", action="store_true", help="analyze: only the folder itself")
    p.add_argument("--new-only", action="store_true", help="analyze: only files that the manifest in --out doesn't cover")
    p.add_argument("--days", type=int, help="usage: entries of the last days")
    p.add_argument("--month", help="usage: entries of a month YYYY-MM (default: the current one)")
    p.add_argument("--all", action="store_true", help="usage: all entries")
    p.add_argument("--clear", action="store_true", help="usage: delete the log")
    p.add_argument("--find", help="speakers: profiles of a cluster id or a name")
    p.add_argument("--pages", action="store_true", help="speakers: contact pages")
    p.add_argument("--identities", help="speakers: identity file")
    p.add_argument("--contacts", help="speakers: JSON lines with display_name")
    p.add_argument("--writeback", action="store_true", help="speakers: what writing the names into the identities does")
    p.add_argument("--min-confidence", type=float, default=0.40)
    p.add_argument("--compare", nargs="?", const="", help="benchmark: two runs FILE,FILE (default: the latest against the one before)")
    p.add_argument("--trend", help="benchmark: a model over all runs")
    p.add_argument("--relationship-insights", action="store_true", default=None)
    p.add_argument("--table", default="calls", help="table of an analysis to show")
    p.add_argument("--fields", help="columns to show, by commas")
    p.add_argument("--dry-run", action="store_true", help="analyze: list the files and stop")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-o", "--format", choices=["json", "markdown", "yaml"], default="json")
    return p


def _analyze(spark, a, settings, lexicon):
    from pyspark.sql import functions as F

    from palaver.functions import text as T
    from palaver.operators import incremental
    from palaver.plans import calls
    from palaver.plans.stored import cut
    from palaver.sources import sinks, transcripts

    found = transcripts.read_transcripts(spark, a.path, not a.no_recursive)
    files = found.withColumn("hash", T.content_hash("text")).withColumn("mtime", F.unix_micros("file_mtime") / 1e6).withColumn("path", F.col("source")).withColumn("size", F.col("file_size"))
    manifest = None
    if a.out:
        place = f"{a.out}/manifest"
        at = spark._jvm.org.apache.hadoop.fs.Path(place)
        known = "file_path string, file_hash string, status string, analyzed_at string, call_type string, file_size bigint, file_mtime double"
        manifest = spark.read.schema(known).parquet(place) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], known)
        if a.new_only:
            files = cut(incremental.pending(files, manifest), "pending")
    if a.dry_run:
        return files.select("call_id", "path", "size")
    tables = calls.analyze(files.drop("hash", "mtime", "path", "size"), lexicon, a.type, settings.relationship_insights, settings.min_topic_seconds, settings.max_topics, list(settings.competitors), list(settings.channels))
    if a.out:
        for name, df in tables.items():
            if a.new_only:
                # a file whose content changed takes its old rows with it
                sinks.merge_table(df, f"{a.out}/{name}", files.select("call_id"))
            else:
                df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        done = files.select("call_id", "path", "mtime", "size", "hash").join(tables["calls"].select("call_id", "call_type"), "call_id").select("path", "hash", F.lit("completed").alias("status"), F.current_timestamp().cast("string").alias("analyzed_at"), "call_type", "size", "mtime")
        sinks.replace_table(cut(incremental.record(manifest, done), "manifest"), f"{a.out}/manifest")
    return tables[a.table]


def _usage(spark, a, settings):
    from pyspark.sql import functions as F

    from palaver.operators import usage
    from palaver.sources import sinks, transcripts

    if a.clear:
        return spark.createDataFrame([(sinks.clear(spark, a.path),)], "cleared bigint")
    entries = transcripts.read_usage(spark, a.path)
    if a.days is not None:
        entries = usage.in_days(entries, a.days, F.current_timestamp())
    elif not a.all:
        entries = entries.where(F.startswith("timestamp", F.lit(a.month) if a.month else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM")))
    if a.table == "models":
        return usage.by_model(entries, "timestamp")
    if a.table == "types":
        return usage.by_call_type(entries)
    return usage.totals(entries, settings.budget_usd, "timestamp")


def _episodes(spark, a):
    """Playbooks, the dashboard, or the preparation of a call."""
    from pyspark.sql import functions as F

    from palaver.operators import episodes as E
    from palaver.plans import documents
    from palaver.sources import sinks, transcripts

    kind = a.type or ("pmf-call" if a.command == "dashboard" else None)
    read = transcripts.read_episodes(spark, a.path, kind)
    # lines of a file have no number; the time of an episode, then its id, orders them
    read = read.select(F.struct("timestamp", "episode_id").alias("pos"), F.col("context.task_type").alias("task_type"), F.col("outcome.scores").alias("scores"), F.col("outcome.findings").alias("findings"))
    listed = read.select("task_type", "pos", F.posexplode("findings").alias("place", "finding")).select("task_type", "finding", F.struct("pos", "place").alias("pos"))
    books = E.playbook_markdown(E.benchmarks(read), E.finding_counts(listed, 20), read)
    if a.command == "dashboard":
        out, name = documents.pmf_dashboard(read), "pmf-dashboard"
    elif a.command == "prep":
        last = E.recent(read.withColumn("score", F.try_element_at("scores", F.lit("overall"))), ["task_type"], [F.col("pos").desc()])
        none = spark.createDataFrame([], "pattern string")
        return documents.working_memory(a.type, last.select("pos", "score", "findings"), none, books)
    else:
        out, name = books, None
    if a.out:
        pages = out.select((F.lit(name) if name else F.col("task_type")).alias("file"), "markdown")
        sinks.write_pages(pages.withColumn("file", F.concat("file", F.lit(".md"))), f"{a.out}/semantic/playbooks")
    return out


def _speakers(spark, a):
    from pyspark.sql import functions as F

    from palaver.operators import identity, reports
    from palaver.plans import documents
    from palaver.plans.stored import cut
    from palaver.sources import sinks, transcripts

    calls = transcripts.read_for_speakers(spark, a.path)
    resolved = cut(transcripts.resolved_speakers(calls).withColumn("pos", F.struct("call_id", "ord")), "resolved")
    evidence = identity.confirmed_evidence(resolved)
    members = resolved.select("call_id", F.col("speaker_cluster_id").alias("cluster_id")).where("coalesce(cluster_id, '') <> ''").distinct()
    known = transcripts.read_identities(spark, a.identities) if a.identities else None
    last = F.struct(F.lit("￿").alias("call_id"), F.lit(0).alias("ord"))
    if known is not None:
        evidence = evidence.unionByName(identity.database_evidence(members.select("cluster_id").distinct(), known).withColumn("pos", last))
    if a.contacts:
        people = spark.read.schema("display_name string, role string").json(a.contacts).withColumn("pos", F.col("display_name"))
        hits = identity.contact_matches(evidence.select("cluster_id", "name", "call_id", "pos"), people).where("contact is not null")
        evidence = evidence.unionByName(hits.select("cluster_id", "source", F.col("contact").alias("name"), "confidence", F.concat(F.lit("matched "), F.col("name")).alias("detail"), "call_id", "pos"))
    evidence = cut(evidence, "evidence")
    found = cut(identity.profiles(resolved, evidence), "profiles")
    if a.find:
        return identity.find_profile(found, a.find)
    if a.writeback and known is not None:
        return identity.writeback(found.select("cluster_id", "likely_name", "name_confidence", "full_name"), known.select("cluster_id", "canonical_name"), F.current_timestamp().cast("string"), a.min_confidence)
    co = identity.co_speakers(members)
    if a.pages:
        when = members.join(calls.select("call_id", F.col("metadata.audio.creation_time").alias("date")), "call_id")
        pages = reports.contact_pages(found, when, co)
        if a.out:
            index = documents.contacts_summary(found)
            sinks.write_pages(pages.select("file", "markdown"), f"{a.out}/contacts")
            index.select("line").write.mode("overwrite").text(f"{a.out}/contacts-index")
        return pages
    return documents.speaker_report(found, evidence, co) if a.format == "markdown" else documents.listing(found)


def _benchmark(spark, a):
    from pyspark.sql import functions as F

    from palaver.operators import history
    from palaver.sources import transcripts

    runs = transcripts.read_runs(spark, a.path)
    points = runs.select("file_name", "timestamp", F.explode("results").alias("r")).select("file_name", "timestamp", "r.*")
    if a.trend:
        rows = points.where(F.col("model") == a.trend).select("model", "file_name", "timestamp", F.col("avg_quality").alias("quality"), F.col("avg_latency_ms").alias("latency_ms"), "tier", F.col("total_cost_usd").alias("cost_usd"), "success_rate")
        trend = history.model_trend(rows, ["file_name"])
        return history.trend_markdown(trend) if a.format == "markdown" else trend
    if a.compare is not None:
        names = a.compare.split(",") if a.compare else [r.file_name for r in runs.select("file_name").limit(2).collect()][::-1]
        if len(names) != 2:
            raise ValueError("two runs are needed")
        both = history.compare_runs(*[points.where(F.col("file_name") == n) for n in names])
        return history.comparison_markdown(both) if a.format == "markdown" else both
    return history.history_markdown(runs) if a.format == "markdown" else runs.drop("results")


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)

    from palaver.operators import analyzers

    if a.command == "list-types":
        print("\n".join(sorted(analyzers.DISPATCH)))
        return 0

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from palaver.operators import classify
    from palaver.plans import model
    from palaver.sources import config, sinks, transcripts

    try:
        if a.command == "prep" and not a.type:
            raise ValueError("prep needs --type")
        settings = config.settings(a.config, relationship_insights=a.relationship_insights)
        spark = SparkSession.builder.getOrCreate()
        lexicon = classify.merge_lexicons(settings.custom_lexicons)
        if a.command == "analyze":
            out = _analyze(spark, a, settings, lexicon)
        elif a.command == "classify":
            found = transcripts.read_transcripts(spark, a.path)
            named = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("segments", F.array()), lambda s: s["speaker"]), lambda s: s.isNotNull() & (s != ""))))
            out = classify.classify(found.select("call_id", "text", named.alias("n")), lexicon, "n").drop("text", "n")
        elif a.command == "usage":
            out = _usage(spark, a, settings)
        elif a.command == "speakers":
            out = _speakers(spark, a)
        elif a.command == "benchmark":
            out = _benchmark(spark, a)
        else:
            out = _episodes(spark, a)
        if a.fields:
            out = out.select(*[f.strip() for f in a.fields.split(",")])
        text = sinks.emit(out, a.format)
        if not a.quiet:
            print(text)
        return 0
    except Exception as e:
        print(f"palaver: {e}", file=sys.stderr)
        return model.exit_code(e)


if __name__ == "__main__":
    sys.exit(main())
