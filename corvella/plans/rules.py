"""Queries on rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import rules as R
from corvella.plans.registry import query
from corvella.sources.domain import FINDINGS, findings

GROUPABLE = "subject IS NOT NULL AND outcome IS NOT NULL AND relation <> 'unclear'"
GROUP_ID = "'GRP_' || concat_ws('_', substr(sha256(pmcid), 1, 8), substr(sha256(subject), 1, 8), substr(sha256(outcome), 1, 8), relation, substr(sha256(category), 1, 8))"
CORPUS_RULES = f"(SELECT subject, outcome, relation, category, direction, count(*) AS n_findings, count(DISTINCT pmcid) AS n_papers, round(avg(score), 6) AS mean_score, min(fid) AS rule_id FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL)"
PAIRS = f"""(SELECT subject, outcome, relation, category, a.rule_id AS rule_id_a, b.rule_id AS rule_id_b, a.direction AS direction_a, b.direction AS direction_b, a.mean_score AS mean_score_a, b.mean_score AS mean_score_b
 FROM {CORPUS_RULES} a JOIN {CORPUS_RULES} b USING (subject, outcome, relation, category) WHERE a.rule_id < b.rule_id AND a.direction <> 'unclear' AND b.direction <> 'unclear')"""
SCORED = f"""(SELECT *, round(same * close, 6) AS ent_ab, round(same * close * 0.9, 6) AS ent_ba, round((1 - same) * close, 6) AS con_ab, round((1 - same) * close * 0.95, 6) AS con_ba
 FROM (SELECT *, CAST(direction_a = direction_b AS INT) AS same, 1 - abs(coalesce(mean_score_a, 0.5) - coalesce(mean_score_b, 0.5)) AS close FROM {PAIRS}))"""
RELATIONS = f"""(SELECT * FROM (SELECT rule_id_a, rule_id_b, ent_ab, con_ab, CASE WHEN direction_a <> direction_b AND con_ab >= 0.8 AND con_ba >= 0.8 THEN 'CONTRADICT' WHEN ent_ab >= 0.8 AND ent_ba >= 0.8 THEN 'SUPPORT' ELSE 'UNRELATED' END AS label FROM {SCORED}) WHERE label <> 'UNRELATED')"""
ADJACENT = f"(SELECT rule_id_a AS rule_id, rule_id_b AS other, label FROM {RELATIONS} UNION ALL SELECT rule_id_b, rule_id_a, label FROM {RELATIONS})"


@query(f"""SELECT te_id, subject, outcome, relation, direction, category, CASE WHEN subject IS NULL THEN fid END AS alone, count(*) AS n_members,
 string_agg(DISTINCT pmcid, ',' ORDER BY pmcid) AS pmcids, round(avg(score), 6) AS mean_score, arg_max(fid, (coalesce(score, -1), -fid)) AS best_fid FROM {FINDINGS} GROUP BY ALL""")
def A01_A02_normalize(spark, sf_dir):
    return R.normalize(findings(spark, sf_dir))


@query(f"""SELECT fid, pmcid, 'NF_' || pmcid || '_' || substr(sha256(coalesce(subject, 'None') || '|' || coalesce(outcome, 'None') || '|' || relation || '|' || CAST(te_id AS VARCHAR)), 1, 8) AS normal_id, CAST(1 AS BIGINT) AS n_members, round(score, 6) AS mean_score,
 concat_ws(', ', CASE WHEN subject IS NULL THEN 'subject_entity=None' END, CASE WHEN outcome IS NULL THEN 'outcome_entity=None' END, CASE WHEN relation = 'unclear' THEN 'relation_type=unclear' END) AS reason FROM {FINDINGS} WHERE NOT ({GROUPABLE})""")
def A03_F12_pass_through(spark, sf_dir):
    return R.pass_through(findings(spark, sf_dir))


@query(f"SELECT category, relation, count(*) AS n FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL")
def F11_groupable(spark, sf_dir):
    return findings(spark, sf_dir).where(R.groupable()).groupBy("category", "relation").agg(F.count("*").alias("n"))


@query(f"""SELECT pmcid, subject, outcome, relation, category, count(*) AS n_findings, count(*) FILTER (direction = 'positive') AS n_positive, count(*) FILTER (direction = 'negative') AS n_negative, count(*) FILTER (direction = 'unclear') AS n_unclear,
 {GROUP_ID} AS group_id FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL""")
def A04_group(spark, sf_dir):
    return R.group(findings(spark, sf_dir))


@query(f"""SELECT pmcid, subject, outcome, relation, category, CASE WHEN count(*) > 1 THEN round((CAST(count(DISTINCT te_id) > 1 AS INT) + CAST(count(DISTINCT voter) > 1 AS INT) + CAST(count(DISTINCT direction) > 1 AS INT)) / 3.0, 4) ELSE 0.0 END AS heterogeneity FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL""")
def A05_scope_heterogeneity(spark, sf_dir):
    return R.heterogeneity(findings(spark, sf_dir), ["te_id", "voter", "direction"])


@query(f"""SELECT *, sum(CAST(direction <> 'unclear' AS INT)) OVER (PARTITION BY pmcid, subject, outcome, relation, category) >= 2 AS is_conflicted,
 'CR_' || substr(sha256({GROUP_ID}), 1, 8) || '_' || direction AS canonical_id FROM (SELECT pmcid, subject, outcome, relation, category, direction, count(*) AS n_findings, round(avg(score), 6) AS mean_score,
 count(DISTINCT te_id) AS n_te, arg_max(fid, (coalesce(score, -1), -fid)) AS best_fid FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL)""")
def A06_canonicalize(spark, sf_dir):
    return R.canonicalize(findings(spark, sf_dir))


@query(f"SELECT subject, outcome, relation, category, direction, CASE WHEN count(DISTINCT pmcid) > 1 THEN 'multi' WHEN count(DISTINCT pmcid) = 1 THEN 'single' ELSE 'unknown' END AS coverage, count(DISTINCT pmcid) AS n_papers FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL")
def A07_study_coverage(spark, sf_dir):
    return R.study_coverage(findings(spark, sf_dir))


@query(f"""SELECT rule_id, n_findings, n_papers, supports, contradicts, contradicts > 0 AS is_contradicted, round(greatest(0.0, least(1.0, CASE WHEN (SELECT count(*) > 0 FROM {RELATIONS})
 THEN 0.60 * g + 0.10 * least(n_findings / 5.0, 1.0) + least(0.08 * supports, 0.20) - 0.10 * CAST(n_papers = 1 AS DOUBLE) - least(0.15 * contradicts, 0.30) + 1e-9
 ELSE 0.80 * g + 0.15 * least(n_findings / 5.0, 1.0) - 0.05 * CAST(n_papers = 1 AS DOUBLE) + 1e-9 END)), 4) AS final_score
 FROM (SELECT r.*, coalesce(mean_score, 0.5) AS g, coalesce(s, 0) AS supports, coalesce(c, 0) AS contradicts FROM {CORPUS_RULES} r
 LEFT JOIN (SELECT rule_id, count(*) FILTER (label = 'SUPPORT') AS s, count(*) FILTER (label = 'CONTRADICT') AS c FROM {ADJACENT} GROUP BY rule_id) d USING (rule_id))""")
def A08_resolve_with_relations(spark, sf_dir):
    f = findings(spark, sf_dir)
    return R.resolve(R.corpus_rules(f), R.relations(f))


@query(f"""SELECT rule_id, n_findings, n_papers, CAST(0 AS BIGINT) AS supports, CAST(0 AS BIGINT) AS contradicts, false AS is_contradicted,
 round(greatest(0.0, least(1.0, 0.80 * coalesce(mean_score, 0.5) + 0.15 * least(n_findings / 5.0, 1.0) - 0.05 * CAST(n_papers = 1 AS DOUBLE) + 1e-9)), 4) AS final_score FROM {CORPUS_RULES}""")
def final_rules(spark, sf_dir):
    return R.resolve(R.corpus_rules(findings(spark, sf_dir)), None)


@query(f"SELECT rule_id, string_agg(DISTINCT CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS contradicted_by FROM {ADJACENT} WHERE label = 'CONTRADICT' GROUP BY rule_id")
def A08_contradicted_by(spark, sf_dir):
    edges = R.relations(findings(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("rule_id_a", "rule_id_b")})
    return R.contradicted_by(edges).withColumn("rule_id", F.col("rule_id").cast("long"))


@query(f"""SELECT category, count(*) AS n_total, count(*) FILTER (score < 0.5) AS n_ungrounded, count(*) FILTER (coalesce(score, 1) >= 0.5 AND NOT ({GROUPABLE})) AS n_non_groupable,
 round(count(*) FILTER (score < 0.5) / count(*), 4) AS grounding_rejection_rate,
 CASE WHEN count(*) > count(*) FILTER (score < 0.5) THEN round(count(*) FILTER (coalesce(score, 1) >= 0.5 AND NOT ({GROUPABLE})) / (count(*) - count(*) FILTER (score < 0.5)), 4) ELSE 0.0 END AS non_groupable_rate FROM {FINDINGS} GROUP BY category""")
def A09_rejection_summary(spark, sf_dir):
    return R.rejection_summary(findings(spark, sf_dir), 0.5)


@query(f"SELECT rule_id_a, rule_id_b, direction_a, direction_b FROM {PAIRS}")
def J06_comparable_pairs(spark, sf_dir):
    return R.comparable_pairs(R.corpus_rules(findings(spark, sf_dir))).select("rule_id_a", "rule_id_b", "direction_a", "direction_b")


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN a.direction = 'unclear' OR b.direction = 'unclear' THEN 'non_polarity_direction' WHEN a.category <> b.category THEN 'category_mismatch'
 WHEN a.relation <> b.relation THEN 'relation_type_mismatch' WHEN a.subject <> b.subject THEN 'subject_mismatch' WHEN a.outcome <> b.outcome THEN 'outcome_incompatible' END AS reason
 FROM {CORPUS_RULES} a JOIN {CORPUS_RULES} b ON a.subject = b.subject AND a.rule_id < b.rule_id) GROUP BY reason""")
def J06_skip_reasons(spark, sf_dir):
    rules = R.corpus_rules(findings(spark, sf_dir))
    side = lambda x: rules.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rule_id", "direction", "category", "relation", "subject", "outcome")))
    pairs = side("a").join(side("b"), F.expr("subject_a = subject_b AND rule_id_a < rule_id_b"))
    return pairs.select(R.skip_reason().alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT rule_id_a, rule_id_b, rule_id_a % 3 = 0 AND rule_id_b % 3 = 0 AS intra FROM {PAIRS} p WHERE rule_id_a % 3 = 0 OR rule_id_b % 3 = 0""")
def J08_incremental_pairs(spark, sf_dir):
    rules = R.corpus_rules(findings(spark, sf_dir))
    return R.incremental_pairs(rules.where("rule_id % 3 <> 0"), rules.where("rule_id % 3 = 0"))


@query(f"SELECT 'COR_' || substr(sha256(least(CAST(rule_id_a AS VARCHAR), CAST(rule_id_b AS VARCHAR)) || '|' || greatest(CAST(rule_id_a AS VARCHAR), CAST(rule_id_b AS VARCHAR))), 1, 8) AS relation_id, label FROM {RELATIONS}")
def T16_relation_ids(spark, sf_dir):
    return R.relations(findings(spark, sf_dir)).select(R.relation_id("rule_id_a", "rule_id_b").alias("relation_id"), "label")


@query(f"SELECT rule_id, other, label FROM {ADJACENT}")
def J09_adjacency(spark, sf_dir):
    return R.adjacency(R.relations(findings(spark, sf_dir)))


@query(f"""SELECT rule_id_a, rule_id_b, label, a.subject AS subject_a, coalesce(a.mean_score, 0.0) AS score_a, b.subject AS subject_b, coalesce(b.mean_score, 0.0) AS score_b
 FROM {RELATIONS} r LEFT JOIN {CORPUS_RULES} a ON a.rule_id = rule_id_a LEFT JOIN {CORPUS_RULES} b ON b.rule_id = rule_id_b""")
def J10_enriched_edges(spark, sf_dir):
    f = findings(spark, sf_dir)
    side = lambda x: R.corpus_rules(f).select(F.col("rule_id").alias(f"rule_id_{x}"), F.col("subject").alias(f"subject_{x}"), F.coalesce("mean_score", F.lit(0.0)).alias(f"score_{x}"))
    return R.relations(f).join(side("a"), "rule_id_a", "left").join(side("b"), "rule_id_b", "left").select("rule_id_a", "rule_id_b", "label", "subject_a", "score_a", "subject_b", "score_b")


@query(f"""WITH v AS (SELECT pmcid, subject, outcome, category, voter, bool_or(direction = 'positive') AS up, bool_or(direction = 'negative') AS down FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL)
SELECT pmcid, subject, outcome, category, count(*) AS n_pairs FROM v a JOIN v b USING (pmcid, subject, outcome, category) WHERE a.voter < b.voter AND ((a.up AND b.down) OR (a.down AND b.up)) GROUP BY ALL""")
def J11_polarity_conflicts(spark, sf_dir):
    return R.polarity_conflicts(findings(spark, sf_dir))


@query(f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN direction_a <> direction_b AND con_ab >= 0.9 AND con_ba >= 0.9 THEN 'CONTRADICT' WHEN ent_ab >= 0.85 AND ent_ba >= 0.85 THEN 'SUPPORT' ELSE 'UNRELATED' END AS label FROM {SCORED}) GROUP BY label")
def D11_classify_pairs(spark, sf_dir):
    pairs = R.with_pair_scores(R.comparable_pairs(R.corpus_rules(findings(spark, sf_dir))))
    return pairs.select(R.classify(0.85, 0.9).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT final_id, rank FROM (SELECT 'FR_' || CAST(rule_id AS VARCHAR) AS final_id, row_number() OVER (ORDER BY round(0.8 * coalesce(mean_score, 0.5), 4) DESC, rule_id) AS rank FROM {CORPUS_RULES}) WHERE rank <= 100")
def O01_top_rules(spark, sf_dir):
    scored = R.corpus_rules(findings(spark, sf_dir), exact=True).withColumn("s", F.round(0.8 * F.coalesce("mean_score", F.lit(0.5)), 4))
    best = [F.desc("s"), F.asc_nulls_last("rule_id")]  # SQL has nulls last
    top = scored.orderBy(*best).limit(100)  # a top-k report: at most 100 rows are numbered
    from pyspark.sql import Window

    return top.select(F.concat(F.lit("FR_"), F.col("rule_id").cast("string")).alias("final_id"), F.row_number().over(Window.orderBy(*best)).alias("rank"))
