"""Documents made of results: tags, JSON, Markdown, contact pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import text as T


def tags(calls: DataFrame, stats: DataFrame, topics: DataFrame) -> DataFrame:
    """Per call (call_id, call_type): the sorted set of its call, speaker and topic tags."""
    rows = (
        calls.select("call_id", F.concat(F.lit("call/"), F.col("call_type")).alias("tag"))
        .unionByName(stats.select("call_id", F.concat(F.lit("speaker/"), F.col("speaker")).alias("tag")))
        .unionByName(topics.select("call_id", F.concat(F.lit("topic/"), T.slug("name")).alias("tag")))
    )
    return rows.groupBy("call_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def document(columns: list[str], sections: list[str] | None = None) -> Column:
    """A JSON document of columns without nulls; ``sections`` keeps only those named, besides call_id."""
    kept = [c for c in columns if sections is None or c in sections or c == "call_id"]
    return F.to_json(F.struct(*kept))


def pick(document: str, paths: list[str]) -> Column:
    """A document cut down to dotted paths; missing ones are dropped, nesting stays."""
    tree: dict = {}
    for p in paths:
        node = tree
        for part in p.split("."):
            node = node.setdefault(part, {})

    def build(node: dict, at: str) -> tuple[Column, Column]:
        """The node's struct, and whether anything in it was found."""
        fields, found = [], F.lit(False)
        for k, sub in node.items():
            if sub:
                value, there = build(sub, f"{at}.{k}")
            else:
                value = F.try_variant_get("_doc", f"{at}.{k}", "variant")
                there = value.isNotNull()
            fields.append(F.when(there, value).alias(k))
            found = found | there
        return F.struct(*fields), found

    return F.to_json(build(tree, "$")[0])


def filter_fields(documents: DataFrame, column: str, paths: list[str]) -> DataFrame:
    return documents.withColumn("_doc", F.try_parse_json(column)).withColumn(column, pick(column, paths)).drop("_doc")


def call_report(calls: DataFrame, stats: DataFrame, topics: DataFrame) -> DataFrame:
    """Per call a Markdown report: type, speakers, topics."""
    speaker = F.format_string("| %s | %d | %s |", T.markdown("speaker"), F.col("word_count"), F.col("talk_ratio").cast("string"))
    s = stats.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("speaker", speaker.alias("line")))).alias("s"))
    t = topics.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("span", F.format_string("- [%s] %s", T.clock("start_seconds"), T.markdown("name")).alias("line")))).alias("t"))
    lines = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda r: r["line"]), "\n")
    return calls.join(s, "call_id", "left").join(t, "call_id", "left").select("call_id", F.concat_ws("\n", F.concat(F.lit("# "), F.initcap(F.replace("call_type", F.lit("-"), F.lit(" ")))), F.lit("\n| Speaker | Words | Ratio |\n|-|-|-|"), lines(F.col("s")), F.lit("\n## Topics\n"), lines(F.col("t"))).alias("markdown"))


def contact_details(members: DataFrame, profiles: DataFrame, actions: DataFrame) -> DataFrame:
    """Per call and known speaker: the call's action items that name the speaker."""
    known = members.join(profiles.select("cluster_id", "likely_name"), "cluster_id")
    a = actions.select(F.col("call_id").alias("_call"), "item", "assignee")
    joined = known.join(a, (F.col("call_id") == F.col("_call")) & F.contains(F.lower("assignee"), F.lower("likely_name")), "left")
    return joined.groupBy("call_id", "cluster_id", "likely_name").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))


def contact_pages(profiles: DataFrame, calls: DataFrame, co: DataFrame, least_calls: int = 1) -> DataFrame:
    """Per named speaker with enough calls a Markdown page with first and last contact and frequent company."""
    seen = calls.groupBy("cluster_id").agg(F.count("*").alias("n_calls"), F.min("date").alias("first_contact"), F.max("date").alias("last_contact"))
    w = Window.partitionBy("a").orderBy(F.col("calls").desc(), "b")
    company = co.withColumn("_r", F.row_number().over(w)).where("_r <= 8").groupBy(F.col("a").alias("cluster_id")).agg(F.sort_array(F.collect_list(F.struct("_r", F.format_string("- %s (%d)", F.col("b").cast("string"), F.col("calls")).alias("line")))).alias("c"))
    page = F.concat_ws("\n", F.concat(F.lit("# "), T.markdown("likely_name")), F.format_string("\n%d calls, %s to %s\n", F.col("n_calls"), F.col("first_contact").cast("string"), F.col("last_contact").cast("string")), F.lit("## Often together with\n"), F.array_join(F.transform(F.coalesce("c", F.array()), lambda r: r["line"]), "\n"))
    return profiles.join(seen, "cluster_id").where((F.col("n_calls") >= least_calls) & F.col("likely_name").isNotNull()).join(company, "cluster_id", "left").select("cluster_id", F.concat(T.safe_name("likely_name"), F.lit(".md")).alias("file"), page.alias("markdown"))
