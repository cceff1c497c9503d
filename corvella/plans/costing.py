"""Queries on costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import costing as C
from corvella.plans.registry import query
from corvella.sources.domain import DECISIONS, PRICES_SQL, USAGE, decisions, prices, table, usage

PRICED = f"""(SELECT *, CASE WHEN batch_used THEN base * 0.5 ELSE base END AS cost FROM (SELECT u.*, (input_tokens - cached_tokens) * p_in / 1e6 + output_tokens * p_out / 1e6 + cached_tokens * coalesce(p_cached, p_in) / 1e6 AS base
 FROM {USAGE} u LEFT JOIN {PRICES_SQL} p ON p.model = split_part(u.model, '@', 1)))"""
COST = "CASE WHEN max(CAST(status = 'ok' AND cost IS NULL AS INT)) = 0 THEN round(sum(cost) FILTER (status = 'ok'), 6) END AS cost"


def _priced(spark, sf_dir):
    return C.with_prices(usage(spark, sf_dir), prices(spark)).withColumn("cost", C.call_cost())


@query(f"SELECT event_id, round(cost + 1e-13, 9) AS cost FROM {PRICED}")
def J25_V13_call_cost(spark, sf_dir):
    return _priced(spark, sf_dir).select("event_id", F.round(F.col("cost") + 1e-13, 9).alias("cost"))


@query(f"SELECT paper_id, level, model, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, {COST} FROM {PRICED} GROUP BY paper_id, level, model")
def A15_A22_A23_usage_by_level(spark, sf_dir):
    return C.rollup(_priced(spark, sf_dir), "paper_id", "level", "model")


@query(" UNION ALL ".join([f"SELECT '{k}' AS \"by\", {k} AS value, count(*) AS calls, sum(input_tokens) AS input_tokens, {COST} FROM {PRICED} GROUP BY {k}" for k in ("stage", "model", "role", "paper_id")] + [f"SELECT 'total', 'all', count(*), sum(input_tokens), {COST} FROM {PRICED}"]))
def A16_A36_rollups(spark, sf_dir):
    return C.rollups(_priced(spark, sf_dir), ["stage", "model", "role", "paper_id"])


@query(f"""WITH p AS (SELECT * FROM {PRICED}), q AS (SELECT u.*, p_in, p_out FROM p u LEFT JOIN {PRICES_SQL} r ON r.model = split_part(u.model, '@', 1)),
strong AS (SELECT split_part(model, '@', 1) AS m FROM p WHERE level = 3 GROUP BY model ORDER BY count(*) DESC, min(event_id) LIMIT 1),
sp AS (SELECT (SELECT p_in FROM {PRICES_SQL} WHERE model = (SELECT m FROM strong)) AS s_in, (SELECT p_out FROM {PRICES_SQL} WHERE model = (SELECT m FROM strong)) AS s_out),
i AS (SELECT stage, item_id, arg_min(input_tokens, event_id) AS tokens FROM p GROUP BY ALL), ans AS (SELECT stage, coalesce(avg(output_tokens) FILTER (level = 3 AND output_tokens > 0), avg(output_tokens) FILTER (output_tokens > 0), 0) AS answer FROM p GROUP BY stage),
ask AS (SELECT sum(tokens) AS i, sum(answer) AS o FROM i JOIN ans USING (stage)),
r AS (SELECT sum(input_tokens) FILTER (status = 'ok') AS ci, sum(output_tokens) FILTER (status = 'ok') AS co, CASE WHEN count(*) FILTER (status = 'ok' AND cost IS NULL) = 0 THEN sum(input_tokens * p_in / 1e6 + output_tokens * p_out / 1e6) FILTER (status = 'ok') END AS c,
 sum(input_tokens) AS di, sum(output_tokens) AS d_o, CASE WHEN count(*) FILTER (status = 'ok' AND cost IS NULL) = 0 THEN sum(cost) FILTER (status = 'ok') END AS d, count(DISTINCT paper_id) AS papers FROM q),
a AS (SELECT *, i * s_in / 1e6 + floor(o * 0.75) * s_out / 1e6 AS a1, i * s_in / 1e6 + floor(o) * s_out / 1e6 AS a2, i * s_in / 1e6 + floor(o * 1.25) * s_out / 1e6 AS a3 FROM ask, sp, r),
u AS (SELECT 'A' AS scenario, i AS input_tokens, floor(o) AS output_tokens, a1 AS low, a2 AS central, a3 AS high, a2, papers FROM a UNION ALL SELECT 'B', i, floor(o), a1 * 0.5, a2 * 0.5, a3 * 0.5, a2, papers FROM a UNION ALL SELECT 'C', ci, co, c, c, c, a2, papers FROM a UNION ALL SELECT 'D', di, d_o, d, d, d, a2, papers FROM a)
SELECT scenario, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, round(low, 4) AS low, round(central, 4) AS central, round(high, 4) AS high, round(central / papers, 4) AS per_paper, round(a2 - central, 4) AS saved, round(100 * (a2 - central) / a2, 4) AS saving_pct FROM u""")
def A17_A18_scenarios(spark, sf_dir):
    return C.scenarios(_priced(spark, sf_dir), prices(spark))


@query(f"SELECT stage, count(*) AS items, count(*) FILTER (top >= 2) AS escalated, round(count(*) FILTER (top >= 2) / count(*), 6) AS rate FROM (SELECT stage, item_id, max(level) AS top FROM {USAGE} GROUP BY ALL) GROUP BY stage")
def A19_A24_escalation(spark, sf_dir):
    return C.escalation(usage(spark, sf_dir))


@query(f"SELECT paper_id, round(sum(cost) FILTER (role = 'judge' AND status = 'ok'), 6) AS judge_cost, count(*) FILTER (role = 'judge') AS judge_calls FROM {PRICED} GROUP BY paper_id")
def A20_judge_overhead(spark, sf_dir):
    judge = F.col("role") == "judge"
    return _priced(spark, sf_dir).groupBy("paper_id").agg(F.round(F.sum(F.when(judge & (F.col("status") == "ok"), F.col("cost"))), 6).alias("judge_cost"), F.count_if(judge).alias("judge_calls"))


@query(f"SELECT stage, round(sum(base), 6) AS regular, round(sum(cost), 6) AS discounted, round(sum(base) - sum(cost), 6) AS saved FROM {PRICED} WHERE status = 'ok' AND cost IS NOT NULL AND batch_used GROUP BY stage")
def A21_batch_savings(spark, sf_dir):
    return C.batch_savings(_priced(spark, sf_dir))


TIERS = [(1, "model-0", 1.0), (1, "model-0@batch", 1.0), (2, "model-1", 0.45), (3, "model-2", 0.2), (3, "model-9", 0.2)]


@query(f"""SELECT id, level, t.model, calls, calls * 5200 AS input_tokens, calls * 900 AS output_tokens, round(calls * 5200 * p_in / 1e6 + calls * 900 * p_out / 1e6, 6) AS cost, round((calls * 5200 * p_in / 1e6 + calls * 900 * p_out / 1e6) * 0.5, 6) AS batch_cost
FROM (SELECT doc_id AS id, level, model, CAST(round_even(n_chars // 700 * rate, 0) AS BIGINT) AS calls FROM documents, (VALUES {", ".join(f"({k}, '{m}', {r}::DOUBLE)" for k, m, r in TIERS)}) AS v(level, model, rate)) t LEFT JOIN {PRICES_SQL} p ON p.model = split_part(t.model, '@', 1)""")
def A25_tier_estimate(spark, sf_dir):
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 700).alias("chunks"))
    return C.tier_estimate(papers, spark.createDataFrame(TIERS, "level int, model string, rate double"), prices(spark), 5200, 900)


@query(f"SELECT pmcid, count(DISTINCT chunk) AS chunks, round((9.60 * count(DISTINCT chunk) FILTER (level >= 2) + 18.00 * count(DISTINCT chunk) FILTER (level = 3)) / (27.60 * count(DISTINCT chunk)), 6) AS cost FROM {DECISIONS} GROUP BY pmcid")
def V14_escalation_cost(spark, sf_dir):
    at = lambda least: F.count_distinct(F.when(F.col("level") >= least, F.col("chunk")))
    d = decisions(spark, sf_dir).groupBy("pmcid").agg(F.count_distinct("chunk").alias("chunks"), at(2).alias("l2"), at(3).alias("l3"))
    return d.select("pmcid", "chunks", F.round(C.escalation_cost(F.col("l2"), F.col("l3"), F.col("chunks")), 6).alias("cost"))


@query(f"""SELECT paper_id, event_id, running, rank FROM (SELECT paper_id, event_id, round(sum(input_tokens) OVER (PARTITION BY paper_id ORDER BY input_tokens DESC, event_id ROWS UNBOUNDED PRECEDING), 6) AS running,
 row_number() OVER (PARTITION BY paper_id ORDER BY input_tokens DESC, event_id) AS rank, count(*) OVER (PARTITION BY paper_id) AS n FROM {USAGE}) WHERE rank IN (ceil(0.5 * n), ceil(0.9 * n), n)""")
def W13_O05_cumulative_cost(spark, sf_dir):
    u = C.cumulative(usage(spark, sf_dir), ["paper_id"], [F.desc("input_tokens"), F.asc("event_id")], "input_tokens")
    return u.where("rank IN (ceil(0.5 * n), ceil(0.9 * n), n)").select("paper_id", "event_id", "running", "rank")


@query(f"SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS calls, sum(input_tokens) AS tokens FROM {USAGE} GROUP BY 1")
def R07_hourly_usage(spark, sf_dir):
    return usage(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"))
