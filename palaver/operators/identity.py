"""Speaker identities across calls: evidence, profiles, names, co-speakers and the identity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import ordering
from palaver.operators.joins import heavy_keys, look_up
from palaver.plans.stored import cut

TRUSTED = ("contacts", "calendar", "diarisation_confirmed", "speaker_db")
EVIDENCE = ["cluster_id", "source", "name", "confidence", "detail", "call_id", "pos"]


def confirmed_evidence(resolved: DataFrame) -> DataFrame:
    """Names that the transcripts' own diarisation confirmed."""
    return resolved.where("coalesce(speaker_cluster_id, '') <> '' and coalesce(display_name, '') <> ''").select(
        F.col("speaker_cluster_id").alias("cluster_id"), F.lit("diarisation_confirmed").alias("source"), F.col("display_name").alias("name"), F.lit(0.95).alias("confidence"), F.concat(F.lit("status="), F.coalesce("status", F.lit("None"))).alias("detail"), "call_id", "pos"
    )


def match_labels(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """Labels (call_id, label, ...) with the cluster of the call's speaker they name: by local label, cluster id or display name.

    One equi-join per call with the three comparisons as a rank; the first best match is an aggregate.
    """
    r = resolved.select(F.col("call_id").alias("_call"), "local_label", F.col("speaker_cluster_id").alias("_cluster"), "display_name", F.col("pos").alias("_pos"))
    rank = F.when(F.col("label") == F.col("local_label"), 1).when(F.col("label") == F.col("_cluster"), 2).when(F.col("label") == F.col("display_name"), 3)
    keys = labels.columns
    hit = labels.join(r, F.col("call_id") == F.col("_call")).withColumn("_rank", rank).where("_rank is not null")
    best = hit.groupBy("call_id", "label").agg(F.min_by("_cluster", F.struct("_rank", "_pos")).alias("cluster_id"))
    return labels.join(best, ["call_id", "label"], "left").select(*keys, "cluster_id")


#: Pairs of one call that a task lists and counts, about.
PAIRS_A_TASK = 500_000


def co_speakers(members: DataFrame, call: str = "call_id", member: str = "cluster_id") -> DataFrame:
    """Pairs of different members of a call and the number of calls they share (both directions).

    Each pair is counted once, the smaller member first, and mirrored after its count.  Memberships are dealt out by call to so many
    tasks that each makes about ``PAIRS_A_TASK`` pairs: what a task holds to count them does not grow with the input.
    """
    once = cut(members.select(F.col(call).alias("call_id"), F.col(member).alias("a")).where("a is not null and call_id is not null").distinct(), "members")
    size = F.col("n").cast("double")
    listed = once.groupBy("call_id").agg(F.count("*").alias("n")).agg(F.sum(size * (size - 1) / 2)).first()[0] or 0
    dealt = once.repartition(int(listed // PAIRS_A_TASK) + 1, "call_id")
    pairs = dealt.join(dealt.withColumnRenamed("a", "b"), "call_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("calls"))
    return pairs.select(F.explode(F.array(F.struct("a", "b", "calls"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "calls"))).alias("p")).select("p.*")


#: How far evidence of a kind is trusted.
EMAIL, TOPIC, CO_SPEAKER = 0.70, 0.50, 0.40


def email_evidence(members: DataFrame, emails: DataFrame) -> DataFrame:
    """Evidence for the speakers of a call (call_id, cluster_id) who have no name of their own there: the people of the email thread about it.

    emails: (call_id, name, pos).  Where a call has one unnamed speaker and one person in its thread that no speaker of the call is
    named after, that person is the speaker; else nothing can be told.  members may have a ``name``; ``detail`` tells the thread's size.

    Cases: null names in a thread are nobody; persons who are named twice count once; ties go to the first place.
    """
    known = F.coalesce(F.col("name"), F.lit("")) != "" if "name" in members.columns else F.lit(False)
    key = lambda c: F.split_part(F.lower(T.strip(c)), F.lit(" "), F.lit(1))
    taken = members.where(known).select("call_id", key("name").alias("k")).distinct() if "name" in members.columns else None
    people = emails.where("coalesce(name, '') <> ''").groupBy("call_id", key("name").alias("k")).agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    size = people.groupBy("call_id").agg(F.count("*").alias("size"))
    free = people if taken is None else people.join(taken, ["call_id", "k"], "left_anti")
    one = free.groupBy("call_id").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("pos").alias("pos")).where("n = 1")
    alone = members.where(~known).select("call_id", "cluster_id").distinct().groupBy("call_id").agg(F.count("*").alias("n"), F.min("cluster_id").alias("cluster_id")).where("n = 1").drop("n")
    return alone.join(one.drop("n"), "call_id").join(size, "call_id").select("cluster_id", F.lit("email").alias("source"), "name", F.lit(EMAIL).alias("confidence"), F.format_string("thread=%d", "size").alias("detail"), "call_id", "pos")


def topic_evidence(topics: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """Evidence for unnamed clusters from what they always talk about: the name of the one named cluster with the same leading topic.

    topics: (cluster_id, topic, calls); names: (cluster_id, name).  A cluster's leading topic is that of most calls (at least
    ``least``, ties: the smaller topic).  A topic that leads for more than one name tells nothing.

    Cases: null topics are none; a cluster with a null or empty name is unnamed; a topic led by unnamed clusters only gives nothing.
    """
    lead = topics.where(F.col("topic").isNotNull() & (F.col("calls") >= least)).groupBy("cluster_id").agg(F.min_by("topic", F.struct((-F.col("calls")).alias("n"), "topic")).alias("topic"))
    named = names.where("coalesce(name, '') <> ''").groupBy("cluster_id").agg(F.min("name").alias("name"))
    own = lead.join(named, "cluster_id", "left")
    # the smallest and the greatest name of a topic are enough to tell whether there is only one; no topic's clusters are gathered
    only = own.groupBy("topic").agg(F.min("name").alias("name"), F.max("name").alias("other")).where("name = other").drop("other")
    unnamed = own.where("name is null").drop("name")
    heavy = heavy_keys(unnamed, "topic")
    return look_up(unnamed, only, "topic", heavy).select("cluster_id", F.lit("topic").alias("source"), "name", F.lit(TOPIC).alias("confidence"), F.concat(F.lit("topic="), F.col("topic")).alias("detail"))


def propagated_evidence(members: DataFrame, seeds: DataFrame, rounds: int = 3, damping: float = CO_SPEAKER, least: float = 0.01) -> DataFrame:
    """Evidence that spreads over the graph of who speaks with whom: (cluster_id, source, name, confidence, hops) of clusters that no seed names.

    members: (call_id, cluster_id); seeds: (cluster_id, name, confidence), the surest of a cluster counts.  In a round each call takes
    up the surest label of its speakers, and each unlabelled speaker the label for which confidence times the share of the speaker's
    calls that bring it is highest, damped.  A speaker who got a label keeps it: the nearest evidence counts.  Spreading ends after
    ``rounds`` rounds, or where confidences fall below ``least``.

    Labels go from speakers to calls and from calls to speakers, so a round's work grows with the memberships and no call's pairs
    are ever listed; calls and speakers with more than a thousandth of the rows are looked up by broadcast (``joins.look_up``).

    Cases: ties go to the smaller name; null ids, names and confidences take no part; repeated memberships count once; a cluster
    that meets no label has no row; an empty table gives an empty table.
    """
    links = cut(members.where("call_id is not null and cluster_id is not null").select("call_id", "cluster_id").distinct(), "members")
    calls_of = cut(links.groupBy("cluster_id").agg(F.count("*").alias("calls")), "calls-of")
    busy, crowded = cut(heavy_keys(links, "cluster_id"), "busy"), cut(heavy_keys(links, "call_id"), "crowded")
    key = F.struct((-F.col("confidence")).alias("c"), "name")
    named = seeds.where("cluster_id is not null and coalesce(name, '') <> '' and confidence is not null").groupBy("cluster_id").agg(F.min(key).alias("k")).select("cluster_id", F.col("k.name").alias("name"), (-F.col("k.c")).alias("confidence"), F.lit(0).alias("hops"))
    now = cut(named, "labels")
    for n in range(rounds):
        spoken = look_up(links, now.select("cluster_id", "name", "confidence"), "cluster_id", busy)
        best = spoken.groupBy("call_id").agg(F.min(key).alias("k")).select("call_id", F.col("k.name").alias("name"), (-F.col("k.c")).alias("confidence"))
        open_ = links.join(now.select("cluster_id"), "cluster_id", "left_anti")
        heard = look_up(open_, best, "call_id", crowded).groupBy("cluster_id", "name").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
        share = heard.join(calls_of, "cluster_id").withColumn("confidence", F.round(F.col("confidence") * damping * F.col("n") / F.col("calls"), 6)).where(F.col("confidence") >= least)
        new = share.groupBy("cluster_id").agg(F.min(key).alias("k")).select("cluster_id", F.col("k.name").alias("name"), (-F.col("k.c")).alias("confidence"), F.lit(n + 1).alias("hops"))
        now = cut(now.unionByName(new), "labels")
    return now.where("hops > 0").select("cluster_id", F.lit("co_speaker").alias("source"), "name", "confidence", "hops")


def top_co_speakers(pairs: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.col("calls").desc(), "b")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def speaker_context(resolved: DataFrame, identities: DataFrame) -> DataFrame:
    """Resolved speakers with what is known of them, and whether any of a call's speakers has been heard before."""
    known = resolved.join(identities.select("cluster_id", "canonical_name", "total_calls"), resolved["speaker_cluster_id"] == F.col("cluster_id"), "left")
    return known.withColumn("is_returning", F.max(F.coalesce(F.col("total_calls") > 1, F.lit(False))).over(Window.partitionBy("call_id"))).drop("cluster_id")


def database_evidence(profiles: DataFrame, identities: DataFrame) -> DataFrame:
    return profiles.join(identities, "cluster_id").where("coalesce(canonical_name, '') <> ''").select("cluster_id", F.lit("speaker_db").alias("source"), F.col("canonical_name").alias("name"), F.lit(0.90).alias("confidence"), F.format_string("calls=%d", F.coalesce("total_calls", F.lit(0))).alias("detail"), F.lit(None).cast("string").alias("call_id"), F.lit(1 << 40).cast("bigint").alias("pos"))


def calendar_matches(calls: DataFrame, events: DataFrame, minutes: int = 30) -> DataFrame:
    """Per call (call_id, recorded_at, duration_seconds) the earliest event that overlaps it, ``minutes`` wider on both sides.

    Of the events that end at or after a call's beginning the earliest is the only one that can be the answer: if it begins too late,
    so do the others.  So calls and events stand in one order of times, the latest first, and each call takes the least
    (start, id) before it: no pairs of calls and events are made, however many of them fall into an hour.

    Cases: ties go to the smaller event_id; events without a start or an end, and calls without a time, match nothing; a null duration is 0.
    """
    at = calls.select(
        (F.col("recorded_at") - F.expr(f"interval {minutes} minutes")).alias("_at"), F.lit(1).alias("_kind"), "call_id",
        (F.col("recorded_at") + F.make_dt_interval(secs=F.coalesce("duration_seconds", F.lit(0.0))) + F.expr(f"interval {minutes} minutes")).alias("_to"),
    )
    ends = events.where("event_start is not null and event_end is not null").select(F.col("event_end").alias("_at"), F.lit(0).alias("_kind"), F.struct("event_start", "event_id").alias("_event"))
    rows = at.where("_at is not null and call_id is not null").unionByName(ends, allowMissingColumns=True)
    # events before calls of the same time; the rest only splits equal times
    order = [F.col("_at").desc(), F.col("_kind").asc(), F.col("_event").asc(), F.col("call_id").asc()]
    hit = ordering.least_so_far(rows, order, F.col("_event"), "_first").where("_kind = 1 and _first.event_start <= _to")
    best = hit.groupBy("call_id").agg(F.min("_first").alias("e"))
    return calls.join(best, "call_id", "left").select(*calls.columns, F.col("e.event_id").alias("event_id"), F.col("e.event_start").alias("event_start"))


def attendee_evidence(evidence: DataFrame, attendees: DataFrame) -> DataFrame:
    """Evidence with a name that fits an attendee of the call: a second, calendar, evidence with the attendee's name.

    Names are compared within a call only.  The first attendee that fits counts, and added rows are not compared again.
    """
    a = attendees.select(F.col("call_id").alias("_call"), F.col("name").alias("_attendee"), F.col("pos").alias("_pos"))
    hit = evidence.join(a, (F.col("call_id") == F.col("_call")) & T.names_match("name", "_attendee"))
    return hit.groupBy("cluster_id", "call_id", "name", "pos").agg(F.min_by("_attendee", "_pos").alias("attendee")).select("cluster_id", F.lit("calendar").alias("source"), F.col("attendee").alias("name"), F.lit(0.80).alias("confidence"), F.concat(F.lit("matched "), F.col("name")).alias("detail"), "call_id", "pos")


def contact_matches(names: DataFrame, contacts: DataFrame) -> DataFrame:
    """Names with the contact of the same full name (.75), or else the first contact of that first name (.60)."""
    low = F.lower(T.strip("name"))
    full = contacts.groupBy(F.lower(T.strip("display_name")).alias("_full")).agg(F.min_by("display_name", "pos").alias("_by_full"))
    first = contacts.groupBy(F.lower(F.split_part(T.strip("display_name"), F.lit(" "), F.lit(1))).alias("_first")).agg(F.min_by("display_name", "pos").alias("_by_first"))
    out = names.withColumn("_low", low).join(full, F.col("_low") == F.col("_full"), "left").join(first, F.split_part("_low", F.lit(" "), F.lit(1)) == F.col("_first"), "left")
    return out.select(*names.columns, F.coalesce("_by_full", "_by_first").alias("contact"), F.when(F.col("_by_full").isNotNull(), "contacts").when(F.col("_by_first").isNotNull(), "contacts_partial").alias("source"), F.when(F.col("_by_full").isNotNull(), 0.75).when(F.col("_by_first").isNotNull(), 0.60).alias("confidence"))


def resolve_names(evidence: DataFrame) -> DataFrame:
    """Per cluster: the name with the most summed confidence, its mean confidence, and the best full name.

    Ties go to the name that was seen first; the spelling is that of the last evidence above .8, or else the first.
    """
    named = evidence.where("coalesce(name, '') <> ''").withColumn("_key", F.lower(T.strip("name")))
    per = named.groupBy("cluster_id", "_key").agg(
        F.round(F.sum("confidence"), 9).alias("score"),
        F.count("*").alias("n"),
        F.min("pos").alias("first_pos"),
        F.coalesce(F.max_by("name", F.when(F.col("confidence") > 0.8, F.col("pos"))), F.min_by("name", "pos")).alias("spelling"),
    )
    best = per.groupBy("cluster_id").agg(F.min_by(F.struct("spelling", "score", "n"), F.struct((-F.col("score")).alias("s"), "first_pos")).alias("b"))
    trusted = F.col("source").isin(*TRUSTED) & (F.col("confidence") >= 0.70)
    spaced = F.contains("name", F.lit(" "))
    key = F.struct((-F.length("name")).alias("l"), "pos")
    full = named.groupBy("cluster_id").agg(F.min_by("name", F.when(spaced & trusted, key)).alias("_trusted"), F.min_by("name", F.when(spaced & (F.col("confidence") >= 0.60), key)).alias("_any"), F.count("*").alias("evidence_count"))
    return best.join(full, "cluster_id").select("cluster_id", F.col("b.spelling").alias("likely_name"), F.round(F.least(F.lit(1.0), F.col("b.score") / F.col("b.n")), 3).alias("name_confidence"), F.coalesce("_trusted", "_any", "b.spelling").alias("full_name"), "evidence_count")


def unique_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence once per source and name, the surest first."""
    w = Window.partitionBy("cluster_id", "source", "name").orderBy(F.col("confidence").desc(), "pos")
    return evidence.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def candidate(likely: Column, full: Column, confidence: Column) -> tuple[Column, Column]:
    """The name to write for a confidence, and its status."""
    name = F.when(confidence >= 0.80, F.coalesce(full, likely)).when(confidence >= 0.60, F.concat(likely, F.lit(" (likely)"))).otherwise(F.concat(likely, F.lit(" (possible)")))
    return name, F.when(confidence >= 0.80, "confident").when(confidence >= 0.60, "likely").otherwise("possible")


def writeback(profiles: DataFrame, identities: DataFrame, now: Column, least: float = 0.40) -> DataFrame:
    """The outcome of writing names (cluster_id, likely_name, name_confidence, full_name) into identities (cluster_id, canonical_name, ...).

    One full outer join yields every identity with its new name, and for profiles the action: skipped_low_confidence,
    not_in_db, conflict, kept, updated or upgraded; identities without a profile are unchanged.
    """
    i = identities.withColumn("_known", F.lit(True))
    out = profiles.withColumn("_profile", F.lit(True)).join(i, "cluster_id", "full_outer")
    name, status = candidate(F.col("likely_name"), F.col("full_name"), F.col("name_confidence"))
    out = out.withColumn("candidate", name).withColumn("status", status)
    base = lambda c: F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(" ("), F.lit(1))))
    a, b = base(F.col("canonical_name")), base(F.col("candidate"))
    conflict = (a != "") & (b != "") & (a != b) & ~F.contains(b, a) & ~F.contains(a, b)
    had = F.coalesce("canonical_name", F.lit("")) != ""
    action = (
        F.when(F.col("_profile").isNull(), "unchanged")
        .when(F.coalesce("likely_name", F.lit("")) == "", "unchanged")
        .when(F.col("name_confidence") < least, "skipped_low_confidence")
        .when(F.col("_known").isNull(), "not_in_db")
        .when(had & conflict, "conflict")
        .when(had & ~T.is_upgrade("canonical_name", "candidate"), "kept")
        .when(had, "upgraded")
        .otherwise("updated")
    )
    out = out.withColumn("action", action)
    written = F.col("action").isin("upgraded", "updated")
    return out.select("cluster_id", "action", F.col("canonical_name").alias("old_name"), F.when(written, F.col("candidate")).otherwise(F.col("canonical_name")).alias("new_name"), F.when(F.col("action").isin("conflict", "kept", "upgraded", "updated"), F.col("candidate")).alias("proposed_name"), "name_confidence", "status", F.when(written, now).alias("updated_at"))


def add_history(history: str, entry: Column, most: int = 20) -> Column:
    """A name history with an entry appended unless the last one has the same name and confidence; the last ``most`` stay."""
    h = F.coalesce(F.col(history), F.array())
    last = F.try_element_at(h, F.lit(-1))
    same = F.coalesce((last["name"] == entry["name"]) & (last["confidence"] == entry["confidence"]), F.lit(False))
    longer = F.array_append(h, entry)
    kept = F.when(F.size(longer) > most, F.slice(longer, -most, most)).otherwise(longer)
    return F.when(same, h).otherwise(kept)


def aliases(old: Column, canonical: Column, full: Column, likely: Column, new: Column) -> Column:
    """Known names of a speaker, sorted: earlier ones, the former canonical name, the first name, the likely name."""
    clean = lambda c: F.trim(F.split_part(c, F.lit(" ("), F.lit(1)))
    added = F.array(F.when(F.coalesce(canonical, F.lit("")) != "", clean(canonical)), F.when(F.contains(full, F.lit(" ")), F.split_part(full, F.lit(" "), F.lit(1))), F.when(likely != new, clean(likely)))
    return F.sort_array(F.array_distinct(F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), added), lambda x: x.isNotNull() & (x != ""))))


def profiles(resolved: DataFrame, evidence: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Per cluster: calls it was resolved in, name, confidence, full name, evidence and display name, the surest first.

    ``roles`` (cluster_id, role, pos): the first one that is not empty counts.
    """
    calls = resolved.where("coalesce(speaker_cluster_id, '') <> ''").groupBy(F.col("speaker_cluster_id").alias("cluster_id")).agg(F.count("*").alias("total_calls"))
    out = calls.join(resolve_names(evidence), "cluster_id", "left")
    if roles is not None:
        out = out.join(roles.where("coalesce(role, '') <> ''").groupBy("cluster_id").agg(F.min_by("role", "pos").alias("role")), "cluster_id", "left")
    return out.withColumn("display_name", T.display_name("likely_name", F.coalesce("name_confidence", F.lit(0.0)), "cluster_id"))


def top_evidence(evidence: DataFrame, most: int = 3) -> DataFrame:
    """The surest evidence of each cluster."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("confidence").desc(), "pos")
    return evidence.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def find_profile(profiles: DataFrame, wanted: str) -> DataFrame:
    """Profiles of a cluster id or a name, or else of names that hold the text."""
    low = F.lower(F.coalesce("likely_name", F.lit("")))
    exact = (F.col("cluster_id").cast("string") == wanted) | (low == wanted.lower())
    rank = F.when(exact, 0).when(F.contains(low, F.lit(wanted.lower())), 1)
    hits = profiles.withColumn("_rank", rank).where("_rank is not null")
    return hits.join(F.broadcast(hits.agg(F.min("_rank").alias("_best"))), F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def profile_topics(topics: DataFrame, most: int = 20) -> DataFrame:
    """Per cluster the first different topics (cluster_id, topic, pos) by their first 50 characters."""
    firsts = topics.withColumn("_key", F.left(F.lower(T.strip("topic")), F.lit(50))).groupBy("cluster_id", "_key").agg(F.min_by("topic", "pos").alias("topic"), F.min("pos").alias("pos"))
    w = Window.partitionBy("cluster_id").orderBy("pos")
    return firsts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("_key")
