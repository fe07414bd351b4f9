"""Registered queries on usage logs, evaluation runs, episodes, identities and manifests, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import episodes as E
from palaver.operators import evaluation, history, identity, incremental, usage
from palaver.plans.tables import EPISODES, USAGE, episodes, fragments, table
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


# ---------------------------------------------------------------- usage and cost


@query(f"""WITH {USAGE}, t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY model) AS n FROM usage WHERE latency_ms > 0),
l AS (SELECT model, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency, min(latency_ms) AS min_latency, max(latency_ms) AS max_latency, max(CASE WHEN r = n // 2 + 1 THEN latency_ms END) AS p50_latency FROM t GROUP BY model)
SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd, arg_min(provider, (session, l_linenumber, l_partkey, l_suppkey)) AS provider, any_value(avg_latency) AS avg_latency, any_value(min_latency) AS min_latency, any_value(max_latency) AS max_latency, any_value(p50_latency) AS p50_latency FROM usage LEFT JOIN l USING (model) GROUP BY model""")
def usage_by_model(spark, d):
    """Per model with the upper median of latencies."""
    return usage.by_model(usage_rows(spark, d), "key")


@query(f"WITH {USAGE} SELECT CASE WHEN coalesce(call_type, '') = '' THEN 'unknown' ELSE call_type END AS call_type, count(*) AS calls, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd FROM usage GROUP BY 1")
def usage_by_call_type(spark, d):
    return usage.by_call_type(usage_rows(spark, d))


@query(f"WITH {USAGE} SELECT model, call_type, count(*) AS calls, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd FROM usage GROUP BY GROUPING SETS ((model), (call_type), ())")
def usage_cube(spark, d):
    return usage.cube(usage_rows(spark, d))


@query(f"WITH {USAGE} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd, round(1e6::DOUBLE - CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS budget_remaining, sum(cost_usd) > 1e6 AS over_budget, arg_min(CAST(ts AS VARCHAR), (ts, session, l_linenumber, l_partkey, l_suppkey)) AS first_entry, arg_max(CAST(ts AS VARCHAR), (ts, session, l_linenumber, l_partkey, l_suppkey)) AS last_entry FROM usage WHERE CAST(ts AS VARCHAR) LIKE '1997-03%'")
def usage_month(spark, d):
    """Totals of a month against a budget."""
    rows = usage.in_month(usage_rows(spark, d), "1997-03").withColumn("timestamp", F.col("timestamp").cast("string")).withColumn("place", F.struct("timestamp", "key"))
    return usage.totals(rows, 1e6, "place").drop("budget_used")


@query(f"WITH {USAGE} SELECT model, count(*) AS calls FROM usage WHERE floor((epoch(TIMESTAMP '1998-09-01 12:00:00') - epoch(ts)) / 86400) <= 90 GROUP BY model")
def usage_days(spark, d):
    """A5: entries of the last days."""
    return usage.in_days(usage_rows(spark, d), 90, F.lit("1998-09-01 12:00:00").cast("timestamp")).groupBy("model").agg(F.count("*").alias("calls"))


@query(f"WITH {USAGE}, p AS (SELECT *, input_tokens * coalesce(pi, 3.0) / 1e6 + output_tokens * coalesce(po, 15.0) / 1e6 AS cost FROM usage LEFT JOIN (VALUES ('A', 3.0137::DOUBLE, 15.0711::DOUBLE), ('N', 0.2571::DOUBLE, 1.2593::DOUBLE)) v(m, pi, po) ON m = model) SELECT session, l_linenumber, l_partkey, l_suppkey, round(cost, 6) AS cost_usd, round(sum(cost) OVER w, 10) AS running_cost, sum(cost) OVER w > 0.0005 AS over_budget FROM p WINDOW w AS (PARTITION BY session ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)")
def running_budget(spark, d):
    """Priced entries and the running total of each session."""
    prices = spark.createDataFrame([("A", 3.0137, 15.0711), ("N", 0.2571, 1.2593)], "model string, price_in double, price_out double")
    rows = usage.over_budget(usage.priced(usage_rows(spark, d).drop("cost_usd"), prices), 0.0005, "session", ["key.l_linenumber", "key.l_partkey", "key.l_suppkey"])
    return rows.select("session", "key.l_linenumber", "key.l_partkey", "key.l_suppkey", "cost_usd", F.round("running_cost", 10).alias("running_cost"), "over_budget")


# ---------------------------------------------------------------- evaluation runs


def _results(spark, d):
    """Orders as results; qualities end in a 3, so that no rounding meets a tie."""
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("model"), F.col("o_orderkey").alias("pos"), F.year("o_orderdate").alias("year"), ((F.floor(F.col("o_totalprice") / 5) * 10 + 3) / 100000).alias("quality"), F.pmod("o_orderkey", F.lit(900)).alias("latency_ms"), (F.pmod("o_orderkey", F.lit(7)) / 1000).alias("cost_usd"), F.when(F.pmod("o_orderkey", F.lit(11)) == 0, "failed").alias("error"), (F.pmod("o_orderkey", F.lit(8)) / 8).alias("accuracy_f1"), F.pmod("o_orderkey", F.lit(4)).alias("hallucinated_count"))


RESULTS = "res AS (SELECT 'm' || CAST(o_custkey % 40 AS VARCHAR) AS model, o_orderkey AS pos, year(o_orderdate) AS year, (CAST(floor(o_totalprice / 5) AS BIGINT) * 10 + 3) / 100000 AS quality, o_orderkey % 900 AS latency_ms, (o_orderkey % 7) / 1000 AS cost_usd, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' END AS error, (o_orderkey % 8) / 8 AS accuracy_f1, o_orderkey % 4 AS hallucinated_count FROM orders)"
TIER = "CASE WHEN {0} >= 7.5 THEN 1 WHEN {0} >= 5 THEN 2 WHEN {0} > 0 THEN 3 ELSE 0 END"


@query(f"WITH {RESULTS}, a AS (SELECT model, count(*) AS runs, avg(CASE WHEN error IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS success_rate, round(coalesce(avg(CASE WHEN error IS NULL THEN quality END), 0), 2) AS avg_quality, CAST(round(coalesce(avg(CASE WHEN error IS NULL THEN latency_ms END), 0)) AS BIGINT) AS avg_latency_ms, round(coalesce(avg(CASE WHEN error IS NULL THEN accuracy_f1 END), 0), 3) AS avg_accuracy_f1, 0.0::DOUBLE AS avg_grounding_rate, CAST(sum(hallucinated_count) AS BIGINT) AS total_hallucinated, round(CAST(sum(CAST(cost_usd AS DECIMAL(28,6))) AS DOUBLE), 6) AS total_cost_usd FROM res GROUP BY model) SELECT *, CASE WHEN total_cost_usd > 0 THEN round(avg_quality / total_cost_usd, 1) ELSE 0 END AS quality_cost_ratio, {TIER.format('avg_quality')} AS tier FROM a")
def model_aggregates(spark, d):
    """E15."""
    return history.model_aggregates(_results(spark, d))


#: A run is a year's results of each model; two models take no part in one run each, as a fixture.
RUNS = "runs AS (SELECT year, model, round(avg(quality), 2) AS avg_quality, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency_ms FROM res WHERE NOT (model = 'm3' AND year = 1996) AND NOT (model = 'm5' AND year = 1997) GROUP BY ALL)"


def _runs(spark, d):
    runs = _results(spark, d).where("not (model = 'm3' and year = 1996) and not (model = 'm5' and year = 1997)").groupBy("year", "model").agg(F.round(F.avg("quality"), 2).alias("avg_quality"), F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"))
    return runs.withColumn("tier", history.tier(F.col("avg_quality")))


@query(f"WITH {RESULTS}, {RUNS}, a AS (SELECT * FROM runs WHERE year = 1996), b AS (SELECT * FROM runs WHERE year = 1997) SELECT coalesce(a.model, b.model) AS model, a.avg_quality AS quality_before, b.avg_quality AS quality_after, round(b.avg_quality - a.avg_quality, 2) AS delta, a.avg_latency_ms AS latency_before_ms, b.avg_latency_ms AS latency_after_ms, b.avg_latency_ms - a.avg_latency_ms AS latency_delta_ms, {TIER.format('a.avg_quality')} * CASE WHEN a.model IS NULL THEN NULL ELSE 1 END AS tier_before, {TIER.format('b.avg_quality')} * CASE WHEN b.model IS NULL THEN NULL ELSE 1 END AS tier_after, {TIER.format('b.avg_quality')} * CASE WHEN b.model IS NULL THEN NULL ELSE 1 END - {TIER.format('a.avg_quality')} * CASE WHEN a.model IS NULL THEN NULL ELSE 1 END AS tier_change, CASE WHEN a.model IS NULL THEN 'added' WHEN b.model IS NULL THEN 'removed' WHEN round(b.avg_quality - a.avg_quality, 2) > 0.5 THEN 'improved' WHEN round(b.avg_quality - a.avg_quality, 2) < -0.5 THEN 'regressed' ELSE 'stable' END AS status FROM a FULL JOIN b ON a.model = b.model")
def compare_runs(spark, d):
    """D11, H1."""
    r = _runs(spark, d)
    return history.compare_runs(r.where("year = 1996"), r.where("year = 1997"))


@query(f"WITH {RESULTS} SELECT model, count(*) AS runs, round(avg(quality), 2) AS mean_quality, round(min(quality), 2) AS min_quality, round(max(quality), 2) AS max_quality, count(quality) AS n_quality, round(coalesce(stddev_samp(quality), 0), 2) AS stddev_quality, round(coalesce(avg(lat), 0), 2) AS mean_latency, round(coalesce(stddev_samp(lat), 0), 2) AS stddev_latency, coalesce(min(lat), 0)::DOUBLE AS min_latency, coalesce(max(lat), 0)::DOUBLE AS max_latency, count(lat) AS n_latency, {TIER.format('arg_max(quality, pos)')} AS current_tier FROM (SELECT *, CASE WHEN latency_ms > 0 THEN latency_ms END AS lat FROM res) GROUP BY model")
def model_stats(spark, d):
    """E16."""
    return history.model_stats(_results(spark, d), "pos")


@query(f"WITH {RESULTS}, e AS (SELECT model, arg_min(quality, (year, pos)) AS first_quality, arg_max(quality, (year, pos)) AS last_quality, count(*) AS n_runs FROM res GROUP BY model) SELECT model, year, pos, quality, CAST(row_number() OVER (PARTITION BY model ORDER BY year, pos) AS INT) AS place, first_quality, last_quality, n_runs, CASE WHEN last_quality - first_quality > 0.5 THEN 'improving' WHEN last_quality - first_quality < -0.5 THEN 'declining' ELSE 'stable' END AS trend FROM res JOIN e USING (model)")
def model_trend(spark, d):
    """F8: every point."""
    return history.model_trend(_results(spark, d), ["year", "pos"]).select("model", "year", "pos", "quality", "place", "first_quality", "last_quality", "n_runs", "trend")


@query(f"""WITH {RESULTS}, {RUNS}, a AS (SELECT * FROM runs WHERE year = 1996), b AS (SELECT * FROM runs WHERE year = 1997), j AS (SELECT a.model AS ma, b.model AS mb, round(b.avg_quality - a.avg_quality, 2) AS d FROM a FULL JOIN b ON a.model = b.model)
SELECT count(d) AS models_compared, count(*) FILTER (d > 0.5) AS improved, count(*) FILTER (d < -0.5) AS regressed, count(*) FILTER (d BETWEEN -0.5 AND 0.5) AS stable, count(*) FILTER (ma IS NULL) AS added, count(*) FILTER (mb IS NULL) AS removed FROM j""")
def comparison_counts(spark, d):
    """The numbers of a comparison."""
    r = _runs(spark, d)
    return history.comparison_counts(history.compare_runs(r.where("year = 1996"), r.where("year = 1997")))


@query(f"""WITH {RESULTS}, p AS (SELECT model, '| ' || row_number() OVER w || ' | ' || quality || ' | ' || latency_ms || ' |' AS line, row_number() OVER w AS k FROM res WINDOW w AS (PARTITION BY model ORDER BY year, pos)),
e AS (SELECT model, arg_min(quality, (year, pos)) AS a, arg_max(quality, (year, pos)) AS b, count(*) AS n FROM res GROUP BY model)
SELECT model, '# Trend: ' || model || chr(10) || chr(10) || '| # | Quality | Latency |' || chr(10) || '|-|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY k) || CASE WHEN any_value(n) >= 2 THEN chr(10) || chr(10) || '**Trend:** ' || CASE WHEN any_value(b - a) > 0.5 THEN 'improving' WHEN any_value(b - a) < -0.5 THEN 'declining' ELSE 'stable' END || ' (' || any_value(a) || ' → ' || any_value(b) || ')' ELSE '' END AS markdown FROM p JOIN e USING (model) GROUP BY model""")
def trend_pages(spark, d):
    """A page per model."""
    return history.trend_markdown(history.model_trend(_results(spark, d), ["year", "pos"]))


@query(f"WITH {RESULTS}, {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY avg_quality DESC, model) AS place FROM runs) SELECT year, model, avg_quality, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def rank_models(spark, d):
    """G7."""
    return history.rank_models(_runs(spark, d), [F.col("avg_quality").desc(), "model"], ["year"], 5).select("year", "model", "avg_quality", "place")


def _catalog(spark, d):
    return table(spark, d, "part").select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.pmod("p_partkey", F.lit(9)) == 0, "").otherwise(F.col("p_brand")).alias("owned_by"), F.when(F.col("p_size") <= 30, F.pmod("p_size", F.lit(4)) + 1).alias("tier_hint"))


CATALOG = "cat AS (SELECT p_name || '-' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS owned_by, CASE WHEN p_size <= 30 THEN p_size % 4 + 1 END AS tier_hint FROM part)"


@query(f"WITH {CATALOG} SELECT id, tier_hint, CASE owned_by WHEN 'Brand#2' THEN 0 WHEN 'Brand#17' THEN 1 ELSE 99 END AS priority FROM cat ORDER BY coalesce(tier_hint, 4), priority, id LIMIT 15")
def catalog_order(spark, d):
    """The models to try first (a top-k report)."""
    return history.catalog_order(_catalog(spark, d), {"Brand#2": 0, "Brand#17": 1}, 15).select("id", "tier_hint", "priority")


@query(f"WITH {CATALOG} SELECT CASE WHEN coalesce(owned_by, '') = '' THEN 'unknown' ELSE owned_by END AS owner, count(*) AS n_models, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM cat WHERE NOT contains(lower(id), 'red') AND NOT contains(lower(id), 'bolt') GROUP BY 1")
def catalog_by_owner(spark, d):
    """A11, C14."""
    c = history.suitable(_catalog(spark, d), ["red", "bolt"]).where("suitable_for_analysis")
    return history.by_owner(c).withColumn("ids", F.array_join("ids", ","))


# ---------------------------------------------------------------- episodes


@query(f"WITH {EPISODES}, s AS (SELECT task_type, 'overall' AS key, score AS value FROM ep UNION ALL SELECT task_type, 'buying_signals', (pos % 5) * 2.5 FROM ep WHERE pos % 3 = 0) SELECT task_type, key, round(avg(value), 2) AS avg, round(min(value), 2) AS min, round(max(value), 2) AS max, count(value) AS n FROM s GROUP BY ALL")
def playbook_benchmarks(spark, d):
    """Scores exploded from maps."""
    e = episodes(spark, d).withColumn("scores", F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("overall").alias("k"), F.col("score").alias("v")), F.when(F.pmod("pos", F.lit(3)) == 0, F.struct(F.lit("buying_signals").alias("k"), (F.pmod("pos", F.lit(5)) * 2.5).cast("double").alias("v")))))))
    return E.benchmarks(e)


FINDINGS = "f AS (SELECT task_type, pos, CASE pos % 13 WHEN 0 THEN 'risk' WHEN 1 THEN 'anti-pmf' ELSE 'signal' END || ' ' || CAST(custkey % 17 AS VARCHAR) AS finding FROM ep)"


def _findings(spark, d):
    kind = F.when(F.pmod("pos", F.lit(13)) == 0, "risk").when(F.pmod("pos", F.lit(13)) == 1, "anti-pmf").otherwise("signal")
    return episodes(spark, d).select("task_type", "pos", F.concat(kind, F.lit(" "), F.pmod("custkey", F.lit(17)).cast("string")).alias("finding"))


@query(f"WITH {EPISODES}, {FINDINGS}, c AS (SELECT task_type, finding, count(*) AS n, min(pos) AS p FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY n DESC, p) AS place FROM c) SELECT task_type, finding, n, CAST(place AS INT) AS place, CASE WHEN contains(finding, 'risk') OR contains(finding, 'anti') THEN 'fails' ELSE 'works' END AS side FROM r WHERE place <= 20")
def finding_counts(spark, d):
    """E10, G3."""
    return E.finding_counts(_findings(spark, d), 20)


@query(f"WITH {EPISODES}, a AS (SELECT CASE status WHEN 'F' THEN 'very_disappointed' WHEN 'O' THEN 'somewhat_disappointed' ELSE 'not_disappointed' END AS answer, count(*) AS n FROM ep GROUP BY 1) SELECT answer, n, CAST(round(100 * n / sum(n) OVER ()) AS INT) AS pct, answer = 'very_disappointed' AND round(100 * n / sum(n) OVER ()) >= 40 AS on_target FROM a")
def ellis_distribution(spark, d):
    """E11."""
    answer = F.when(F.col("status") == "F", "is Very disappointed").when(F.col("status") == "O", "Ellis: somewhat_disappointed").otherwise("not disappointed at all")
    return E.ellis_distribution(episodes(spark, d).select(answer.alias("finding")))


@query(f"WITH {EPISODES}, r AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY ts, pos) AS k, count(*) OVER (PARTITION BY custkey) AS n FROM ep), h AS (SELECT custkey, count(*) AS n, round(avg(score), 1) AS average, round(avg(CASE WHEN k <= n // 2 THEN score END), 1) AS first_half, round(avg(CASE WHEN k > n // 2 THEN score END), 1) AS second_half FROM r GROUP BY custkey) SELECT *, CASE WHEN n >= 4 THEN CASE WHEN second_half > first_half THEN 'improving' WHEN second_half < first_half THEN 'declining' ELSE 'stable' END END AS trend FROM h")
def half_trend(spark, d):
    """E12."""
    return E.half_trend(episodes(spark, d), ["custkey"], ["timestamp", "pos"])


@query(f"WITH {EPISODES}, r AS (SELECT task_type, pos, score, row_number() OVER (PARTITION BY task_type ORDER BY ts DESC, pos DESC) AS place FROM ep) SELECT task_type, pos, score, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def recent_episodes(spark, d):
    """G4."""
    return E.recent(episodes(spark, d), ["task_type"], [F.col("timestamp").desc(), F.col("pos").desc()]).select("task_type", "pos", "score", "place")


@query(f"WITH {EPISODES}, {FINDINGS}, m AS (SELECT task_type, finding, min(pos) AS pos FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY pos) AS place FROM m) SELECT task_type, finding, pos, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def prep_notes(spark, d):
    """The first different findings."""
    return E.prep_notes(_findings(spark, d), ["task_type"])


@query(f"WITH {EPISODES} SELECT CASE WHEN pos % 4 = 0 THEN 'pattern ' ELSE 'finding ' END || CAST(pos AS VARCHAR) AS pattern FROM ep WHERE task_type = '1-URGENT' OR status = '1-URGENT' ORDER BY pos LIMIT 10")
def dead_ends(spark, d):
    """D17 (a top-k report)."""
    e = episodes(spark, d).select("task_type", F.col("status").alias("call_type"), "pos", F.when(F.pmod("pos", F.lit(4)) == 0, F.concat(F.lit("pattern "), F.col("pos").cast("string"))).alias("pattern"), F.concat(F.lit("finding "), F.col("pos").cast("string")).alias("finding"))
    return E.dead_ends(e, "1-URGENT")


@query("""WITH o AS (SELECT o_orderkey AS call_id, o_orderkey % 4 AS a, o_orderkey % 5 AS b, o_custkey % 3 AS r, round((o_orderkey % 100) / 100, 3) AS bal FROM orders),
s AS (SELECT *, CASE WHEN a > 0 THEN least(a * 2.5, 10.0) END AS buying, CASE WHEN r > 0 THEN greatest(10.0 - r * 2.5, 0.0) END AS risk, CASE WHEN b > 0 THEN round(bal * 10, 1) END AS balance FROM o)
SELECT call_id, round((coalesce(buying, 0) + coalesce(risk, 0) + coalesce(balance, 0)) / nullif((buying IS NOT NULL)::INT + (risk IS NOT NULL)::INT + (balance IS NOT NULL)::INT, 0), 1) AS overall, concat_ws(';', CASE WHEN b > 0 THEN CAST(b AS VARCHAR) || ' action items extracted' END, CASE WHEN a > 0 THEN CAST(a AS VARCHAR) || ' buying signals detected' END, CASE WHEN r > 0 THEN CAST(r AS VARCHAR) || ' risk signals detected' END) AS findings FROM s""")
def episode_scores(spark, d):
    """E17."""
    n = lambda x: F.col(x).cast("int")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.pmod("o_orderkey", F.lit(4)).alias("n_buying"), F.pmod("o_orderkey", F.lit(5)).alias("n_actions"), F.pmod("o_custkey", F.lit(3)).alias("n_risk"), F.round(F.pmod("o_orderkey", F.lit(100)) / 100, 3).alias("bal"))
    o = o.withColumn("speaking_balance", F.when(F.col("n_actions") > 0, F.col("bal"))).withColumn("total_speakers", F.lit(2))
    for c in ("n_decisions", "n_pains", "n_commitments", "methodology_total", "methodology_max"):
        o = o.withColumn(c, F.lit(None).cast("int"))
    o = E.build_episodes(o.withColumn("framework_score", F.lit(None).cast("double")).withColumn("n_buying", n("n_buying")).withColumn("n_actions", n("n_actions")).withColumn("n_risk", n("n_risk")))
    return o.select("call_id", "overall", F.array_join(F.filter("findings", lambda f: ~F.contains(f, F.lit("balance"))), ";").alias("findings"))


@query()
def playbooks(spark, d):
    """A playbook per task type."""
    e = episodes(spark, d).withColumn("scores", F.create_map(F.lit("overall"), F.col("score")))
    return E.playbook_markdown(E.benchmarks(e), E.finding_counts(_findings(spark, d), 20), e)


# ---------------------------------------------------------------- evaluation of items


@query("""WITH p AS (SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE d.lang = 'en' AND contains(d.text, b.text)) SELECT doc_id, count(*) AS n_items FROM p GROUP BY doc_id""")
def verbatim_items(spark, d):
    """D16's containment: benchmark items in documents by their longest inner words (an equi-join on a shared word, then the text).

    Words at an item's ends may be parts of longer ones in a document; those between white space are whole words there.  Items
    without such a word are looked for in every text.
    """
    docs = table(spark, d, "documents").where("lang = 'en'").select("doc_id", "text")
    pieces = F.split("item", r"\s+")
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    items = table(spark, d, "benchmark").select(F.col("text").alias("item")).where("item is not null").withColumn("word", longest)
    words = docs.withColumn("word", F.explode(F.array_distinct(F.split("text", r"\s+"))))
    holds = F.contains("text", F.col("item"))
    hits = words.join(items.where("word is not null"), "word").where(holds).select("doc_id")
    short = docs.join(items.where("word is null").drop("word"), holds).select("doc_id")
    return hits.unionByName(short).groupBy("doc_id").agg(F.count("*").alias("n_items"))


@query("""SELECT d.doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '\\S+')), list_distinct(regexp_extract_all(lower(b.text), '\\S+')))) AS INT) AS shared, len(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '\\S+')), list_distinct(regexp_extract_all(lower(b.text), '\\S+')))) >= 8 OR contains(lower(d.text), lower(b.text)) AS grounded FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS nth, count(*) OVER () AS n FROM benchmark) b ON b.nth = d.doc_id % b.n WHERE d.text IS NOT NULL""".replace("\\\\", "\\"))
def grounding(spark, d):
    """Documents against all items in turn, one each."""
    docs, items = table(spark, d, "documents").where("text is not null"), table(spark, d, "benchmark").withColumnRenamed("text", "item")
    # items in turn; they are few, so one window numbers them
    items = items.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("item_id")) - 1)
    j = docs.join(items, F.pmod("doc_id", F.lit(items.count())) == F.col("nth"))
    return j.select("doc_id", F.size(F.array_intersect(evaluation.word_set("item"), evaluation.word_set("text"))).alias("shared"), evaluation.grounded("item", "text", 8).alias("grounded"))


@query("""WITH g AS (SELECT o_custkey AS k, list(o_orderpriority || ' x' || CAST(o_orderkey % 5 AS VARCHAR) ORDER BY o_orderkey) AS ext FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
t AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS gt FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
m AS (SELECT g.k, ext, gt, (SELECT sum(least(a.n, b.n)) FROM (SELECT split_part(lower(x), ' x', 1) AS p, count(*) AS n FROM (SELECT unnest(ext) AS x) GROUP BY 1) a JOIN (SELECT lower(y) AS p, count(*) AS n FROM (SELECT unnest(gt) AS y) GROUP BY 1) b USING (p)) AS s FROM g JOIN t USING (k))
SELECT k, CAST(coalesce(s, 0) AS INT) AS matches, round(coalesce(s, 0) / len(ext), 3) AS precision, round(coalesce(s, 0) / len(gt), 3) AS recall, round(CASE WHEN coalesce(s, 0) > 0 THEN 2 * (s / len(ext)) * (s / len(gt)) / (s / len(ext) + s / len(gt)) ELSE 0 END, 3) AS f1 FROM m""")
def precision_recall(spark, d):
    """Greedy one-to-one matches; here items only fit their own kind, so greedy equals counting per kind."""
    o = table(spark, d, "orders")
    ordered = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", v.alias("v")))), lambda r: r["v"])
    a = o.where("pmod(o_orderkey, 2) = 0").groupBy(F.col("o_custkey").alias("k")).agg(ordered(F.concat("o_orderpriority", F.lit(" x"), F.pmod("o_orderkey", F.lit(5)).cast("string"))).alias("extracted"))
    b = o.where("pmod(o_orderkey, 2) = 1").groupBy(F.col("o_custkey").alias("k")).agg(ordered(F.col("o_orderpriority")).alias("truth"))
    return evaluation.precision_recall(a.join(b, "k"), threshold=1.0).select("k", "matches", "precision", "recall", "f1")


@query("SELECT o_orderkey AS pos, CASE WHEN o_orderstatus IN (CASE WHEN o_custkey % 5 = 0 THEN 'F' ELSE 'O' END, 'P') AND o_custkey % 5 < 4 THEN 1.0::DOUBLE ELSE 0.0 END AS accuracy FROM orders")
def accepted_types(spark, d):
    """Predictions against accepted types; a fixture without truth scores 0."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.pmod("o_custkey", F.lit(5)).alias("fixture"), F.col("o_orderstatus").alias("call_type"))
    t = spark.range(4).select(F.col("id").alias("fixture"), F.when(F.col("id") == 0, "F").otherwise("O").alias("call_type"), F.array(F.lit("P")).alias("accepted_types"))
    return evaluation.accepted_types(p, t).select("pos", "accuracy")


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'no json' ELSE props END AS response, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE WHEN response IS NULL THEN 0.0 WHEN response = 'no json' THEN 0.5 ELSE round((0.10 + 0.5 * 0.15 + 0.30 + 0.25 + CASE WHEN k = 0 THEN 0 ELSE 1 END * 0.20) * 10, 2) END::DOUBLE AS quality_score FROM r""")
def reply_quality(spark, d):
    """E21 on small JSON replies."""
    n = F.pmod("event_id", F.lit(10))
    r = table(spark, d, "events").select("event_id", F.when(n == 0, F.lit(None)).when(n == 1, "no json").otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).alias("response"), F.lit("").alias("transcript"), F.lit(1.0).alias("accuracy"))
    return evaluation.score_replies(r, ["k", "other"]).select("event_id", "quality_score")


# ---------------------------------------------------------------- identities


@query("WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS calls FROM m a JOIN m b ON a.c = b.c AND a.s <> b.s GROUP BY ALL")
def co_speakers(spark, d):
    """Suppliers of one order stand for speakers of one call."""
    return identity.co_speakers(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem), p AS (SELECT a.s AS a, b.s AS b, count(*) AS calls FROM m a JOIN m b ON a.c = b.c AND a.s <> b.s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY calls DESC, b) AS place FROM p) SELECT a, b, calls, CAST(place AS INT) AS place FROM r WHERE place <= 5")
def top_co_speakers(spark, d):
    """G5."""
    return identity.top_co_speakers(identity.co_speakers(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


SOURCES = "CASE o_orderkey % 4 WHEN 0 THEN 'contacts' WHEN 1 THEN 'llm_extraction' WHEN 2 THEN 'speaker_db' ELSE 'calendar' END"
NAME = "CASE o_orderkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'ann' WHEN 2 THEN 'Ann Lee' WHEN 3 THEN 'Bo' ELSE 'Bo Ray Oh' END"
CONF = "CASE o_orderkey % 6 WHEN 0 THEN 0.95171 WHEN 1 THEN 0.85313 WHEN 2 THEN 0.60737 WHEN 3 THEN 0.75791 WHEN 4 THEN 0.40913 ELSE 0.79337 END::DOUBLE"


def _evidence(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("cluster_id"), F.expr(SOURCES).alias("source"), F.expr(NAME).alias("name"), F.expr(CONF.replace("::DOUBLE", "")).cast("double").alias("confidence"), F.col("o_orderkey").alias("pos"))


@query(f"""WITH e AS (SELECT o_custkey AS cluster_id, {SOURCES} AS source, {NAME} AS name, {CONF} AS confidence, o_orderkey AS pos FROM orders),
p AS (SELECT cluster_id, lower(trim(name)) AS key, round(sum(confidence), 9) AS score, count(*) AS n, min(pos) AS fp, coalesce(arg_max(name, CASE WHEN confidence > 0.8 THEN pos END), arg_min(name, pos)) AS spelling FROM e GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, fp) AS k FROM p),
t AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY length(name) DESC, pos) AS k FROM e WHERE contains(name, ' ') AND confidence >= 0.7 AND source <> 'llm_extraction'),
a AS (SELECT cluster_id, name, row_number() OVER (PARTITION BY cluster_id ORDER BY length(name) DESC, pos) AS k FROM e WHERE contains(name, ' ') AND confidence >= 0.6),
c AS (SELECT cluster_id, count(*) AS evidence_count FROM e GROUP BY 1)
SELECT b.cluster_id, b.spelling AS likely_name, round(least(1.0, b.score / b.n), 3) AS name_confidence, coalesce(t.name, a.name, b.spelling) AS full_name, evidence_count FROM b JOIN c USING (cluster_id) LEFT JOIN t ON t.cluster_id = b.cluster_id AND t.k = 1 LEFT JOIN a ON a.cluster_id = b.cluster_id AND a.k = 1 WHERE b.k = 1""")
def resolve_names(spark, d):
    """E19, E20."""
    return identity.resolve_names(_evidence(spark, d))


@query(f"WITH e AS (SELECT o_custkey AS cluster_id, {SOURCES} AS source, {NAME} AS name, {CONF} AS confidence, o_orderkey AS pos FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source, name ORDER BY confidence DESC, pos) AS k FROM e) SELECT cluster_id, source, name, confidence, pos FROM r WHERE k = 1")
def unique_evidence(spark, d):
    """H7."""
    return identity.unique_evidence(_evidence(spark, d))


@query("SELECT o_orderkey AS call_id, o_custkey AS speaker_cluster_id, c_name AS canonical_name, n AS total_calls, coalesce(n > 15, FALSE) AS is_returning FROM orders LEFT JOIN (SELECT c_custkey, c_name, CAST(c_custkey % 31 AS BIGINT) AS n FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey".replace("n > 15", "n > 1"))
def speaker_context(spark, d):
    """D3, D6."""
    known = table(spark, d, "customer").where("pmod(c_custkey, 3) <> 0").select(F.col("c_custkey").alias("cluster_id"), F.col("c_name").alias("canonical_name"), F.pmod("c_custkey", F.lit(31)).alias("total_calls"))
    return identity.speaker_context(table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("speaker_cluster_id")), known)


@query("""WITH l AS (SELECT l_orderkey AS call_id, CASE l_linenumber % 3 WHEN 0 THEN 'L' || CAST(l_linenumber AS VARCHAR) WHEN 1 THEN CAST(l_suppkey AS VARCHAR) ELSE 'N' || CAST(l_partkey % 7 AS VARCHAR) END AS label FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey AS call_id, 'L' || CAST(l_linenumber AS VARCHAR) AS local_label, CAST(l_suppkey AS VARCHAR) AS cluster, 'N' || CAST(l_partkey % 7 AS VARCHAR) AS display_name, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem),
h AS (SELECT l.call_id, l.label, r.cluster, row_number() OVER (PARTITION BY l.call_id, l.label ORDER BY CASE WHEN label = local_label THEN 1 WHEN label = cluster THEN 2 ELSE 3 END, pos, cluster) AS k FROM l JOIN r ON l.call_id = r.call_id AND (label = local_label OR label = cluster OR label = display_name))
SELECT l.call_id, l.label, h.cluster AS cluster_id FROM l LEFT JOIN h ON h.call_id = l.call_id AND h.label = l.label AND h.k = 1""")
def match_labels(spark, d):
    """D4."""
    t = table(spark, d, "lineitem")
    line, supp, name = F.concat(F.lit("L"), F.col("l_linenumber").cast("string")), F.col("l_suppkey").cast("string"), F.concat(F.lit("N"), F.pmod("l_partkey", F.lit(7)).cast("string"))
    labels = t.select(F.col("l_orderkey").alias("call_id"), F.when(F.pmod("l_linenumber", F.lit(3)) == 0, line).when(F.pmod("l_linenumber", F.lit(3)) == 1, supp).otherwise(name).alias("label")).distinct()
    r = t.select(F.col("l_orderkey").alias("call_id"), line.alias("local_label"), supp.alias("speaker_cluster_id"), name.alias("display_name"), F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("p"), supp.alias("s")).alias("pos"))
    return identity.match_labels(labels, r)


@query("""WITH c AS (SELECT event_id AS call_id, ts AS at FROM events), e AS (SELECT event_id, ts + INTERVAL 17 MINUTE AS a, ts + INTERVAL 37 MINUTE AS b FROM events),
h AS (SELECT c.call_id, e.event_id, e.a, row_number() OVER (PARTITION BY c.call_id ORDER BY e.a, e.event_id) AS k FROM c JOIN e ON e.a <= c.at + INTERVAL 90 SECOND + INTERVAL 30 MINUTE AND e.b >= c.at - INTERVAL 30 MINUTE) SELECT c.call_id, h.event_id FROM c LEFT JOIN h ON h.call_id = c.call_id AND h.k = 1""")
def calendar_matches(spark, d):
    """The earliest event that overlaps a call."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = e.select(F.col("event_id").alias("call_id"), F.col("ts").alias("recorded_at"), F.lit(90.0).alias("duration_seconds"))
    v = e.select("event_id", (F.col("ts") + F.expr("interval 17 minutes")).alias("event_start"), (F.col("ts") + F.expr("interval 37 minutes")).alias("event_end"))
    return identity.calendar_matches(c, v).select("call_id", "event_id")


@query("""WITH n AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'Mr ' || CAST(s_suppkey % 4 AS VARCHAR) END AS name FROM supplier),
c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Mr X' || CAST(c_custkey AS VARCHAR) END AS dn, c_custkey AS pos FROM customer),
f AS (SELECT lower(dn) AS key, arg_min(dn, pos) AS v FROM c GROUP BY 1), g AS (SELECT lower(split_part(dn, ' ', 1)) AS key, arg_min(dn, pos) AS v FROM c GROUP BY 1)
SELECT n.k, n.name, coalesce(f.v, g.v) AS contact, CASE WHEN f.v IS NOT NULL THEN 'contacts' WHEN g.v IS NOT NULL THEN 'contacts_partial' END AS source, CASE WHEN f.v IS NOT NULL THEN 0.75 WHEN g.v IS NOT NULL THEN 0.60 END::DOUBLE AS confidence FROM n LEFT JOIN f ON f.key = lower(name) LEFT JOIN g ON g.key = lower(split_part(name, ' ', 1))""")
def contact_matches(spark, d):
    """D8."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Mr "), F.pmod("s_suppkey", F.lit(4)).cast("string"))).alias("name"))
    c = table(spark, d, "customer").select(F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_name")).otherwise(F.concat(F.lit("Mr X"), F.col("c_custkey").cast("string"))).alias("display_name"), F.col("c_custkey").alias("pos"))
    return identity.contact_matches(s, c)


_NEW = "CASE c_custkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ann Lee' WHEN 2 THEN 'Bo' ELSE NULL END"
_OLD = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Ann (possible)' WHEN 2 THEN 'Ann' WHEN 3 THEN 'Cy' ELSE 'Ann Lee' END"
_SURE = "round((c_custkey % 11) / 10.0, 1)"


@query(f"""WITH p AS (SELECT c_custkey AS cluster_id, {_NEW} AS likely, {_SURE}::DOUBLE AS conf FROM customer WHERE c_custkey % 7 <> 0), i AS (SELECT c_custkey AS cluster_id, {_OLD} AS old, TRUE AS known FROM customer WHERE c_custkey % 3 <> 0),
j AS (SELECT coalesce(p.cluster_id, i.cluster_id) AS cluster_id, p.cluster_id IS NOT NULL AS prof, likely, conf, old, known, CASE WHEN conf >= 0.8 THEN likely WHEN conf >= 0.6 THEN likely || ' (likely)' ELSE likely || ' (possible)' END AS cand FROM p FULL JOIN i ON p.cluster_id = i.cluster_id),
b AS (SELECT *, lower(trim(split_part(coalesce(old, ''), ' (', 1))) AS bo, lower(trim(split_part(coalesce(cand, ''), ' (', 1))) AS bn FROM j),
a AS (SELECT *, CASE WHEN NOT prof OR likely IS NULL THEN 'unchanged' WHEN conf < 0.4 THEN 'skipped_low_confidence' WHEN known IS NULL THEN 'not_in_db' WHEN old IS NOT NULL AND bo <> bn AND NOT contains(bn, bo) AND NOT contains(bo, bn) THEN 'conflict'
 WHEN old IS NOT NULL AND NOT ((contains(bn, bo) AND length(bn) > length(bo)) OR (bo = bn AND CASE WHEN contains(cand, '(likely)') THEN 2 WHEN contains(cand, '(possible)') THEN 1 ELSE 3 END > CASE WHEN contains(old, '(likely)') THEN 2 WHEN contains(old, '(possible)') THEN 1 ELSE 0 END)) THEN 'kept' WHEN old IS NOT NULL THEN 'upgraded' ELSE 'updated' END AS action FROM b)
SELECT cluster_id, action, old AS old_name, CASE WHEN action IN ('upgraded', 'updated') THEN cand ELSE old END AS new_name FROM a""")
def writeback(spark, d):
    """An upsert by full outer join."""
    c = table(spark, d, "customer")
    p = c.where("pmod(c_custkey, 7) <> 0").select(F.col("c_custkey").alias("cluster_id"), F.expr(_NEW).alias("likely_name"), F.expr(_SURE).cast("double").alias("name_confidence"), F.expr(_NEW).alias("full_name"))
    i = c.where("pmod(c_custkey, 3) <> 0").select(F.col("c_custkey").alias("cluster_id"), F.expr(_OLD).alias("canonical_name"))
    return identity.writeback(p, i, F.lit("2024-01-01")).select("cluster_id", "action", "old_name", "new_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'c' || CAST(c_custkey AS VARCHAR) WHEN c_acctbal >= 8000 THEN c_name WHEN c_acctbal >= 6000 THEN c_name || ' (likely)' WHEN c_acctbal >= 4000 THEN c_name || ' (possible)' ELSE 'c' || CAST(c_custkey AS VARCHAR) END AS display_name FROM customer")
def display_names(spark, d):
    """C15."""
    return table(spark, d, "customer").select("c_custkey", T.display_name(F.when(F.pmod("c_custkey", F.lit(9)) == 0, "").otherwise(F.col("c_name")), F.col("c_acctbal") / 10000, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("display_name"))


# ---------------------------------------------------------------- incremental processing and routing


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS sz, CASE WHEN doc_id % 7 = 0 THEN left(sha256(text), 16) ELSE 'other' END AS h FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = d.doc_id AND status = 'completed' AND (sz = d.n_chars OR h = left(sha256(d.text), 16)))""")
def pending_files(spark, d):
    """D12."""
    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(1.0).alias("mtime"), F.col("n_chars").alias("size"), T.content_hash("text").alias("hash"))
    m = docs.where("pmod(doc_id, 3) = 0").select(F.col("doc_id").cast("string").alias("file_path"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "completed").otherwise("failed").alias("status"), F.lit(1.0).alias("file_mtime"), (F.col("n_chars") + F.when(F.pmod("doc_id", F.lit(5)) == 0, 1).otherwise(0)).alias("file_size"), F.when(F.pmod("doc_id", F.lit(7)) == 0, T.content_hash("text")).otherwise("other").alias("file_hash"))
    return incremental.pending(files, m).select("doc_id")


@query("SELECT event_id AS call_id, name AS channel FROM events JOIN (VALUES ('all', []::VARCHAR[]), ('errors', ['error']), ('shop', ['purchase', 'click'])) c(name, ons) ON len(ons) = 0 OR list_contains(ons, event_type)")
def notification_routes(spark, d):
    """B10, D13."""
    channels = [("all", []), ("errors", ["error"]), ("shop", ["purchase", "click"])]
    return incremental.route(table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.col("event_type").alias("call_type")), channels).select("call_id", "channel")


_TOX = fragments({"x": ["a"] * 4}, 0)["x"]


@query(f"""WITH p AS (SELECT doc_id, ({' OR '.join(f"contains(lower(text), '{t}')" for t in _TOX)})::INT AS hit FROM documents), j AS (SELECT hit, quality FROM p JOIN labels USING (doc_id)) SELECT count(*) AS n, CAST(sum(hit * quality) AS BIGINT) AS tp, round(sum(hit * quality) / sum(hit), 3) AS precision, round(sum(hit * quality) / sum(quality), 3) AS recall FROM j""")
def lexicon_against_labels(spark, d):
    """A lexicon classifier against labels."""
    p = table(spark, d, "documents").select("doc_id", T.any_hit(F.lower("text"), _TOX).cast("int").alias("hit")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    tp = F.sum(F.col("hit") * F.col("quality"))
    return p.agg(F.count("*").alias("n"), tp.alias("tp"), F.round(tp / F.sum("hit"), 3).alias("precision"), F.round(tp / F.sum("quality"), 3).alias("recall"))
