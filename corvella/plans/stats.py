"""Queries for statistics, reports, joins of reports and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.operators import rules as R
from corvella.operators import sequences as S
from corvella.operators import stats as St
from corvella.plans.registry import query
from corvella.plans.rules import CORPUS_RULES, GROUPABLE, RELATIONS
from corvella.sources.domain import DECISIONS, FINDINGS, RUNS, TEXT_ELEMENTS, decisions, findings, runs, table, text_elements


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY started_at DESC, run_id DESC) AS rn FROM {RUNS}) WHERE rn = 1".replace("SELECT * FROM (", "SELECT run_id, pmcid, started_at, status, wall_s, config FROM (", 1))
def W01_W02_S09_J03_latest_run(spark, sf_dir):
    return S.latest_run(runs(spark, sf_dir))


@query(f"SELECT run_id, CASE WHEN k > 1 THEN pmcid || '__' || CAST(k AS VARCHAR) ELSE pmcid END AS name FROM (SELECT run_id, pmcid, row_number() OVER (PARTITION BY pmcid ORDER BY run_id) AS k FROM {RUNS})")
def W03_W14_occurrence_suffix(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("pmcid").orderBy("run_id"))
    r = runs(spark, sf_dir).withColumn("k", k)
    return r.select("run_id", F.when(F.col("k") > 1, F.concat("pmcid", F.lit("__"), F.col("k").cast("string"))).otherwise(F.col("pmcid")).alias("name"))


@query(f"SELECT pmcid FROM {RUNS} GROUP BY pmcid HAVING count(*) FILTER (status = 'P') = 1")
def F24_single_only(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("pmcid").agg(F.count_if(F.col("status") == "P").alias("n")).where("n = 1").select("pmcid")


@query("SELECT cap, count(*) FILTER (n_chars <= cap) AS papers, coalesce(sum(n_chars) FILTER (n_chars <= cap), 0) AS chars FROM documents, (VALUES (500), (1000), (5000), (20000)) AS c(cap) GROUP BY cap")
def F25_cap_rows(spark, sf_dir):
    caps = F.explode(F.array(*map(F.lit, (500, 1000, 5000, 20000)))).alias("cap")
    fits = F.col("n_chars") <= F.col("cap")
    return table(spark, sf_dir, "documents").select("n_chars", caps).groupBy("cap").agg(F.count_if(fits).alias("papers"), F.coalesce(F.sum(F.when(fits, F.col("n_chars"))), F.lit(0)).alias("chars"))


@query(f"SELECT rule_id FROM {CORPUS_RULES} WHERE mean_score < 0.45 OR n_papers = 1")
def F26_flagged_rules(spark, sf_dir):
    return R.corpus_rules(findings(spark, sf_dir)).where("mean_score < 0.45 OR n_papers = 1").select("rule_id")


@query("SELECT doc_id, 'PMC' || CAST(doc_id AS VARCHAR) AS canonical, CAST(doc_id AS VARCHAR) AS accession FROM documents")
def F28_document_ids(spark, sf_dir):
    raw = F.concat(F.lit("pmc"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    canonical = F.upper(F.regexp_replace(raw, r"\.pdf$", ""))
    return table(spark, sf_dir, "documents").select("doc_id", canonical.alias("canonical"), F.regexp_extract(canonical, r"(\d+)", 1).alias("accession"))


@query(f"SELECT te_id, 'kept' AS split, count(*) AS n FROM {FINDINGS} WHERE score IS NULL OR score >= 0.5 GROUP BY te_id UNION ALL SELECT te_id, 'dropped', count(*) FROM {FINDINGS} WHERE score < 0.5 GROUP BY te_id")
def F09_F10_grounding_filter(spark, sf_dir):
    keep = F.col("score").isNull() | (F.col("score") >= 0.5)
    return findings(spark, sf_dir).groupBy("te_id", F.when(keep, "kept").otherwise("dropped").alias("split")).agg(F.count("*").alias("n"))


@query(f"SELECT fid, (CASE WHEN subject IS NULL THEN 'MISSING_SUBJECT,' ELSE '' END) || (CASE WHEN score IS NULL THEN 'MISSING_SCORE,' ELSE '' END) || (CASE WHEN relation = 'unclear' THEN 'UNCLEAR_RELATION,' ELSE '' END) AS codes FROM {FINDINGS}")
def F13_schema_codes(spark, sf_dir):
    codes = F.array_compact(F.array(F.when(F.col("subject").isNull(), "MISSING_SUBJECT,"), F.when(F.col("score").isNull(), "MISSING_SCORE,"), F.when(F.col("relation") == "unclear", "UNCLEAR_RELATION,")))
    return findings(spark, sf_dir).select("fid", F.array_join(codes, "").alias("codes"))


@query(f"SELECT voter, CASE WHEN bool_or(subject IS NULL AND relation = 'unclear' AND score IS NULL) THEN 'unusable' WHEN bool_or(score IS NULL) THEN 'weakly_grounded' ELSE 'eligible' END AS tier FROM {FINDINGS} GROUP BY voter")
def F17_voter_tiers(spark, sf_dir):
    hard = F.bool_or(F.col("subject").isNull() & (F.col("relation") == "unclear") & F.col("score").isNull())
    return findings(spark, sf_dir).groupBy("voter").agg(F.when(hard, "unusable").when(F.bool_or(F.col("score").isNull()), "weakly_grounded").otherwise("eligible").alias("tier"))


@query("SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'basic' WHEN 'standard' THEN 'basic' ELSE lower(p_type) END AS repaired, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'alias' ELSE 'case' END AS reason FROM part")
def F29_enum_repair(spark, sf_dir):
    alias = F.create_map(F.lit("economy"), F.lit("basic"), F.lit("standard"), F.lit("basic"))
    hit = F.try_element_at(alias, F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(hit, F.lower("p_type")).alias("repaired"), F.when(hit.isNotNull(), "alias").otherwise("case").alias("reason"))


@query("SELECT 'p_type' AS field, p_type AS raw, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'basic' ELSE lower(p_type) END AS repaired, CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'alias' ELSE 'case' END AS reason, count(*) AS n, min(p_partkey) AS first_row FROM part WHERE p_type <> lower(p_type) GROUP BY ALL")
def Y16_enum_observations(spark, sf_dir):
    """The log beside F29: each raw value that was repaired, how, how often, and where it was first seen."""
    low = F.lower("p_type")
    hit = low.isin("economy", "standard")
    p = table(spark, sf_dir, "part").where(F.col("p_type") != low).select(F.lit("p_type").alias("field"), F.col("p_type").alias("raw"), F.when(hit, "basic").otherwise(low).alias("repaired"), F.when(hit, "alias").otherwise("case").alias("reason"), "p_partkey")
    return p.groupBy("field", "raw", "repaired", "reason").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_row"))


@query("SELECT 'valid' AS kind, count(*) AS n FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F', 'P') UNION ALL SELECT 'malformed', count(*) FROM orders WHERE NOT (o_totalprice >= 1000 AND o_orderstatus IN ('O', 'F', 'P'))")
def F30_drop_malformed(spark, sf_dir):
    ok = (F.col("o_totalprice") >= 1000) & F.col("o_orderstatus").isin("O", "F", "P")
    kinds = table(spark, sf_dir, "orders").agg(F.count_if(ok).alias("v"), F.count_if(~ok).alias("m"))
    return kinds.select(F.expr("stack(2, 'valid', v, 'malformed', m) AS (kind, n)"))


@query("SELECT DISTINCT l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND l_discount > 0.09")
def J01_two_joins(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select("l_orderkey", "l_partkey")
    cust = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("l_partkey").alias("part")).distinct()


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 50)")
def J02_semi_join(spark, sf_dir):
    first = table(spark, sf_dir, "labels").orderBy("doc_id").limit(50).select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(first, "doc_id", "left_semi")


@query(f"SELECT f.fid, coalesce(nullif(t.text, ''), CAST(f.fid AS VARCHAR)) AS verbatim FROM {FINDINGS} f LEFT JOIN {TEXT_ELEMENTS} t ON t.te_id = f.te_id * 100000")
def J04_J22_verbatim(spark, sf_dir):
    te = text_elements(spark, sf_dir).select(F.col("te_id").alias("t"), "text")
    f = findings(spark, sf_dir).select("fid", (F.col("te_id") * 100000).alias("k"))
    return f.join(te, F.col("k") == F.col("t"), "left").select("fid", F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("fid").cast("string")).alias("verbatim"))


@query(f"SELECT pmcid, subject, outcome, relation, category, sum(quantity) AS quantity FROM {FINDINGS} WHERE {GROUPABLE} GROUP BY ALL")
def J05_member_lookup(spark, sf_dir):
    f = findings(spark, sf_dir)
    groups = f.where(R.groupable()).groupBy("pmcid", "subject", "outcome", "relation", "category").agg(F.collect_list(F.struct("fid", "quantity")).alias("members"))
    return groups.select("pmcid", "subject", "outcome", "relation", "category", F.explode("members").alias("m")).groupBy("pmcid", "subject", "outcome", "relation", "category").agg(F.sum("m.quantity").alias("quantity"))


@query(f"SELECT coalesce(a.pmcid, b.pmcid) AS pmcid, coalesce(a.chunk, b.chunk) AS chunk, CASE WHEN a.pmcid IS NULL THEN 'only_b' WHEN b.pmcid IS NULL THEN 'only_a' WHEN a.keep = b.keep THEN 'same' ELSE 'differs' END AS outcome FROM (SELECT pmcid, chunk, bool_or(agreement > 0.5) AS keep FROM {DECISIONS} WHERE level = 1 GROUP BY ALL) a FULL JOIN (SELECT pmcid, chunk, bool_or(agreement > 0.5) AS keep FROM {DECISIONS} WHERE level = 2 GROUP BY ALL) b ON a.pmcid = b.pmcid AND a.chunk = b.chunk")
def J17_U02_policy_comparison(spark, sf_dir):
    side = lambda k, n: decisions(spark, sf_dir).where(F.col("level") == k).groupBy("pmcid", "chunk").agg(F.bool_or(F.col("agreement") > 0.5).alias(n))
    both = side(1, "a").join(side(2, "b"), ["pmcid", "chunk"], "full")
    return both.select("pmcid", "chunk", F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("outcome"))


@query(f"SELECT coalesce(x.p, y.p) AS pair, x.label AS before, y.label AS after FROM (SELECT least(rule_id_a, rule_id_b) || '~' || greatest(rule_id_a, rule_id_b) AS p, label FROM {RELATIONS} WHERE rule_id_a % 3 <> 0) x FULL JOIN (SELECT least(rule_id_a, rule_id_b) || '~' || greatest(rule_id_a, rule_id_b) AS p, label FROM {RELATIONS} WHERE rule_id_a % 3 <> 1) y ON x.p = y.p WHERE x.label IS DISTINCT FROM y.label")
def J18_J19_relation_diff(spark, sf_dir):
    r = R.relations(findings(spark, sf_dir)).select("rule_id_a", F.concat_ws("~", F.array_sort(F.array("rule_id_a", "rule_id_b"))).alias("pair"), "label")
    x, y = r.where("rule_id_a % 3 <> 0").select("pair", F.col("label").alias("before")), r.where("rule_id_a % 3 <> 1").select("pair", F.col("label").alias("after"))
    return x.join(y, "pair", "full").where(~F.col("before").eqNullSafe(F.col("after")))


@query(f"""SELECT first_failing, count(*) AS n FROM (SELECT CASE WHEN p.p_partkey IS NULL THEN 'no_part' WHEN d.doc_id IS NULL THEN 'no_document' WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'complete' END AS first_failing
 FROM lineitem i LEFT JOIN part p ON p.p_partkey = i.l_partkey LEFT JOIN documents d ON d.doc_id = p.p_partkey LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY first_failing""")
def J20_Y10_provenance_chain(spark, sf_dir):
    i, p = table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").select("p_partkey")
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"))
    chain = i.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(d, F.col("p_partkey") == F.col("doc_id"), "left").join(lab, F.col("doc_id") == F.col("l_doc"), "left")
    failing = F.when(F.col("p_partkey").isNull(), "no_part").when(F.col("doc_id").isNull(), "no_document").when(F.col("l_doc").isNull(), "no_label").otherwise("complete")
    return chain.groupBy(failing.alias("first_failing")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = c_custkey")
def J21_A46_paper_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    both = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_lines"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(both, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query(f"SELECT t.te_id FROM {TEXT_ELEMENTS} t WHERE n_words >= 30 AND te_id NOT IN (SELECT DISTINCT te_id * 100000 FROM {FINDINGS})")
def J23_unextracted(spark, sf_dir):
    used = findings(spark, sf_dir).select((F.col("te_id") * 100000).alias("te_id")).distinct()
    return text_elements(spark, sf_dir).where("n_words >= 30").join(used, "te_id", "left_anti").select("te_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def J26_R05_cache_misses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT p_brand, min(p_type) AS first_type, count(*) AS total, string_agg(DISTINCT p_name, ';' ORDER BY p_name) AS variants FROM part GROUP BY p_brand HAVING count(*) >= 2")
def A10_A11_merge_by_concept(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("first_type"), F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_set("p_name")), ";").alias("variants")).where("total >= 2")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def A12_top_concepts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("SELECT source, count(DISTINCT lang) AS n_langs, count(*) AS n FROM documents GROUP BY source")
def A13_A14_distinct_and_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_langs"), F.count("*").alias("n"))


@query(f"SELECT pmcid, count(*) AS n, count(*) FILTER (score >= 0.5) AS kept, round(count(*) FILTER (score >= 0.5) / count(*), 6) AS retention FROM {FINDINGS} GROUP BY pmcid UNION ALL SELECT 'ALL', count(*), count(*) FILTER (score >= 0.5), round(count(*) FILTER (score >= 0.5) / count(*), 6) FROM {FINDINGS}")
def A26_grounding_retention(spark, sf_dir):
    kept = F.count_if(F.col("score") >= 0.5)
    return findings(spark, sf_dir).rollup("pmcid").agg(F.count("*").alias("n"), kept.alias("kept"), F.round(kept / F.count("*"), 6).alias("retention")).withColumn("pmcid", F.coalesce("pmcid", F.lit("ALL")))


@query(f"SELECT pmcid, level, count(*) FILTER (polarity_conflict) AS conflicts, count(*) AS n FROM {DECISIONS} GROUP BY pmcid, level")
def A28_polarity_counts(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy("pmcid", "level").agg(F.count_if("polarity_conflict").alias("conflicts"), F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT pmcid, count(*) AS n_findings, count(*) FILTER ({GROUPABLE}) AS n_groupable FROM {FINDINGS} GROUP BY pmcid), g AS (SELECT pmcid, count(*) AS n_groups FROM (SELECT DISTINCT pmcid, subject, outcome, relation, category FROM {FINDINGS} WHERE {GROUPABLE}) GROUP BY pmcid),
r AS (SELECT pmcid, count(*) AS n_rules FROM (SELECT DISTINCT pmcid, subject, outcome, relation, category, direction FROM {FINDINGS} WHERE {GROUPABLE}) GROUP BY pmcid)
SELECT pmcid, n_findings, n_groupable, n_groups, n_rules, round(n_findings / n_rules, 4) AS compression FROM f JOIN g USING (pmcid) JOIN r USING (pmcid)""")
def A29_A32_A57_funnel(spark, sf_dir):
    f = findings(spark, sf_dir)
    key = ["pmcid", "subject", "outcome", "relation", "category"]
    rules = f.groupBy(*key, "direction", R.groupable().alias("ok")).agg(F.count("*").alias("n"))
    ok = F.col("ok")
    groups = rules.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("g"), F.count_if(ok).alias("r"), F.bool_or("ok").alias("any"))
    out = groups.groupBy("pmcid").agg(F.sum("n").alias("n_findings"), F.sum("g").alias("n_groupable"), F.count_if("any").alias("n_groups"), F.sum("r").alias("n_rules"))
    return out.withColumn("compression", F.round(F.col("n_findings") / F.col("n_rules"), 4))


@query(f"SELECT count(*) AS papers, round(avg(f), 6) AS mean_of_fractions, round(sum(kept) / sum(n), 6) AS pooled, round(median(f), 6) AS median FROM (SELECT pmcid, count(*) AS n, count(*) FILTER (score >= 0.5) AS kept, count(*) FILTER (score >= 0.5) / count(*) AS f FROM {FINDINGS} GROUP BY pmcid)")
def A30_funnel_totals(spark, sf_dir):
    per = findings(spark, sf_dir).groupBy("pmcid").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("kept")).withColumn("f", F.col("kept") / F.col("n"))
    return per.agg(F.count("*").alias("papers"), F.round(F.avg("f"), 6).alias("mean_of_fractions"), F.round(F.sum("kept") / F.sum("n"), 6).alias("pooled"), F.round(F.median("f"), 6).alias("median"))


@query(f"SELECT category, relation, count(*) AS n FROM {FINDINGS} WHERE score < 0.3 GROUP BY ALL")
def A31_rejection_tallies(spark, sf_dir):
    return findings(spark, sf_dir).where("score < 0.3").groupBy("category", "relation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS n, count(*) FILTER (contains(whole, substr(line, 1, 40))) AS found FROM (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def A38_text_recall(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"), F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(F.col("text"), F.substring(x, 1, 40)))).cast("long").alias("found"))


@query(f"SELECT pmcid, quantity FROM (SELECT pmcid, quantity, row_number() OVER (PARTITION BY pmcid ORDER BY quantity, fid) - 1 AS i, count(*) OVER (PARTITION BY pmcid) AS n FROM {FINDINGS}) WHERE i = CAST(round(0.25 * (n - 1)) AS INT)")
def A46_A47_nearest_rank(spark, sf_dir):
    return St.nth_percentile(findings(spark, sf_dir).select("pmcid", "quantity", "fid"), ["pmcid"], "quantity", St.nearest_rank(0.25), "fid")


@query("SELECT quality, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1, round(count(*) FILTER (quality = toxic) / count(*), 6) AS agreement FROM labels GROUP BY quality")
def A48_confusion(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("predicted_0"), F.count_if(F.col("toxic") == 1).alias("predicted_1"), F.round(F.count_if(F.col("quality") == F.col("toxic")) / F.count("*"), 6).alias("agreement"))


@query("SELECT 'documents' AS name, count(*) AS n, count(*) >= 200 AS ok FROM documents UNION ALL SELECT 'pages', count(*), count(*) >= 50 FROM pages UNION ALL SELECT 'labels', count(*), count(*) >= 1000000 FROM labels")
def A51_A52_row_audit(spark, sf_dir):
    least = {"documents": 200, "pages": 50, "labels": 1_000_000}
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", (F.col("n") >= k).alias("ok")) for t, k in least.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"SELECT config, status, count(*) AS n_runs, max(started_at) AS latest, round(sum(wall_s), 2) AS wall_s FROM {RUNS} GROUP BY ALL")
def A42_A53_run_index(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("config", "status").agg(F.count("*").alias("n_runs"), F.max("started_at").alias("latest"), F.round(F.sum("wall_s"), 2).alias("wall_s"))


@query("SELECT x, y, string_agg(DISTINCT CAST(s_nationkey AS VARCHAR), ',' ORDER BY CAST(s_nationkey AS VARCHAR)) AS variants FROM (SELECT round(s_acctbal / 500) * 500 + 0.0 AS x, s_suppkey % 3 AS y, s_nationkey FROM supplier) GROUP BY x, y")
def J15_A55_share_map(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.round(F.col("s_acctbal") / 500) * 500 + 0.0).alias("x"), (F.col("s_suppkey") % 3).alias("y"), F.col("s_nationkey").cast("string").alias("v"))
    return s.groupBy("x", "y").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("variants"))


@query(f"SELECT pmcid, count(*) AS n, count(*) FILTER (trim(coalesce(subject, '')) <> '') AS n_verbatim, count(*) FILTER (te_id % 9 <> 0) AS n_text_element, count(score) AS n_grounding, count(*) FILTER (trim(coalesce(subject, '')) <> '' AND te_id % 9 <> 0 AND score IS NOT NULL) AS n_triple, round(count(*) FILTER (trim(coalesce(subject, '')) <> '') / count(*), 4) AS rate_verbatim, round(count(*) FILTER (te_id % 9 <> 0) / count(*), 4) AS rate_text_element, round(count(score) / count(*), 4) AS rate_grounding, round(count(*) FILTER (trim(coalesce(subject, '')) <> '' AND te_id % 9 <> 0 AND score IS NOT NULL) / count(*), 4) AS rate_triple FROM {FINDINGS} GROUP BY pmcid")
def A27_carry_rate(spark, sf_dir):
    f = findings(spark, sf_dir)
    return St.carry_rate(f.select("pmcid", F.col("subject").alias("verbatim"), F.when(F.col("te_id") % 9 != 0, F.col("te_id")).alias("te_id"), "score"), "pmcid")


@query("WITH p AS (SELECT DISTINCT p_size AS cost, p_retailprice AS quality FROM part) SELECT a.cost, a.quality FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality))")
def O06_pareto(spark, sf_dir):
    return St.pareto(table(spark, sf_dir, "part").select(F.col("p_size").alias("cost"), F.col("p_retailprice").alias("quality")).distinct(), "cost", "quality")


CELLS = "(SELECT p_brand AS brand, p_type AS type, CAST(p_size AS DOUBLE) AS cost, round(((p_partkey * 37) % 1000) / 1000.0 * (0.4 + p_size / 90.0), 4) AS quality FROM part)"


@query(f"""WITH c AS MATERIALIZED (SELECT * FROM {CELLS}), b AS (SELECT brand, type, max((quality, -cost)) AS m FROM c GROUP BY ALL), r AS (SELECT brand, type, struct_extract_at(m, 1) AS q, row_number() OVER (ORDER BY struct_extract_at(m, 1) DESC, struct_extract_at(m, 2) DESC, brand, type) AS rank FROM b),
f AS (SELECT brand, type, min(cost) AS c FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.cost <= a.cost AND b.quality >= a.quality AND (b.cost < a.cost OR b.quality > a.quality)) GROUP BY ALL),
q1 AS (SELECT brand, type, rank <= 3 AS k, (SELECT max(q) FROM r) - q <= 0.01 AS w FROM r), p AS (SELECT f.brand, f.type, row_number() OVER (ORDER BY k OR w, c, f.brand, f.type) <= 4 AS pf FROM f JOIN q1 USING (brand, type)),
e AS (SELECT brand, type FROM c WHERE quality >= 0.5 ORDER BY cost, brand, type LIMIT 1), n AS (SELECT brand, type FROM c ORDER BY quality - 0.1 * cost DESC, brand, type LIMIT 1),
x AS (SELECT r.brand, r.type, q AS best_quality, list_filter([CASE WHEN k THEN 'top-k' END, CASE WHEN w THEN 'within-best' END, CASE WHEN coalesce(pf, false) THEN 'pareto' END, CASE WHEN e.brand IS NOT NULL THEN 'economy' END, CASE WHEN n.brand IS NOT NULL THEN 'knee' END], lambda z: z IS NOT NULL) AS reasons
 FROM r JOIN q1 USING (brand, type) LEFT JOIN p USING (brand, type) LEFT JOIN e USING (brand, type) LEFT JOIN n USING (brand, type))
SELECT brand, type, best_quality, array_to_string(reasons, ',') AS reasons FROM x WHERE len(reasons) > 0""")
def O07_finalists(spark, sf_dir):
    c = F.col
    cells = table(spark, sf_dir, "part").select(c("p_brand").alias("brand"), c("p_type").alias("type"), c("p_size").cast("double").alias("cost"), F.round((c("p_partkey") * 37) % 1000 / 1000.0 * (0.4 + c("p_size") / 90.0), 4).alias("quality"))
    return St.finalists(cells, ["brand", "type"], "quality", "cost", pareto_cap=4).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 20")
def O09_hash_sample(spark, sf_dir):
    return St.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 20, 7, ["lang"])


_SPILL_SQL = ", ".join(f"('{b}', '{o}', {i}, {k})" for i, (b, others) in enumerate(St.SPILL.items()) for k, o in enumerate(others))
_BUCKET_SQL = "CASE " + " ".join(f"WHEN s >= {low} THEN '{b}'" for b, (low, _) in reversed(list(St.BUCKETS.items()))) + " ELSE 'very_low' END"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, {_BUCKET_SQL} AS bucket FROM (SELECT doc_id, (n_chars % 100) / 100.0 * CASE WHEN n_chars % 3 = 0 THEN 0.4 ELSE 1.0 END AS s FROM documents WHERE n_chars % 7 > 0)),
n AS (SELECT b.bucket, want, coalesce(k, 0) AS have FROM (VALUES {", ".join(f"('{b}', {k})" for b, k in St.targets(120).items())}) AS b(bucket, want) LEFT JOIN (SELECT bucket, count(*) AS k FROM r GROUP BY bucket) USING (bucket)),
steps AS (SELECT row_number() OVER (ORDER BY i, k) AS step, bucket, other FROM (VALUES {_SPILL_SQL}) AS v(bucket, other, i, k)),
w AS (SELECT 0::BIGINT AS step, (SELECT map(list(bucket), list(least(want, have))) FROM n) AS take, (SELECT map(list(bucket), list(want - least(want, have))) FROM n) AS lack
 UNION ALL SELECT s.step, map_from_entries(list_transform(map_entries(take), lambda e: {{'key': e.key, 'value': e.value + CASE WHEN e.key = s.other THEN least(lack[s.bucket], m.have - take[s.other]) ELSE 0 END}})),
  map_from_entries(list_transform(map_entries(lack), lambda e: {{'key': e.key, 'value': e.value - CASE WHEN e.key = s.bucket THEN least(lack[s.bucket], m.have - take[s.other]) ELSE 0 END}}))
  FROM w JOIN steps s ON s.step = w.step + 1 JOIN n m ON m.bucket = s.other),
t AS (SELECT take FROM w ORDER BY step DESC LIMIT 1)
SELECT doc_id, bucket FROM (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM r), t WHERE rn <= take[bucket]""")
def O10_stratified_sample(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 7 > 0, (n % 100) / 100.0 * F.when(n % 3 == 0, 0.4).otherwise(1.0)).alias("score"))
    return St.stratified_sample(rows, "doc_id", "score", 120, 3).select("doc_id", "bucket")


@query(f"""WITH p AS (SELECT pmcid, row_number() OVER (ORDER BY sha256('5:' || pmcid), pmcid) AS r FROM (SELECT DISTINCT pmcid FROM {TEXT_ELEMENTS})),
e AS (SELECT te_id, pmcid, te_id % 4 = 0 AS cited FROM {TEXT_ELEMENTS} JOIN p USING (pmcid) WHERE r <= 10 AND n_words >= 5)
SELECT te_id, pmcid, CASE WHEN cited THEN 'extracted' ELSE 'not_extracted' END AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY pmcid, cited ORDER BY sha256('6:' || CAST(te_id AS VARCHAR)), te_id) AS rn FROM e) WHERE rn <= 2""")
def O11_two_strata(spark, sf_dir):
    """Of ten papers two paragraphs each that findings cite, and two that none does."""
    te = text_elements(spark, sf_dir)
    papers = St.hash_sample(te.select("pmcid").distinct(), "pmcid", 10, 5)
    strata = te.where("n_words >= 5").join(F.broadcast(papers), "pmcid", "left_semi").select("te_id", "pmcid", F.when(F.col("te_id") % 4 == 0, "extracted").otherwise("not_extracted").alias("stratum"))
    return St.hash_sample(strata, "te_id", 2, 6, ["pmcid", "stratum"])


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 5000 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY sha256('9:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 15")
def Y09_F23_heldout_draw(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").where("n_chars BETWEEN 500 AND 5000").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return St.hash_sample(pool, "doc_id", 15, 9)


@query("SELECT doc_id, CAST('0x' || substr(sha256('1:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS seed FROM documents")
def O13_task_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long").alias("seed"))


@query("SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) QUALIFY percent_rank() OVER (ORDER BY n, source) BETWEEN 0.4 AND 0.65")
def O19_percentile_band(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("p", F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy("n", "source"))).where("p BETWEEN 0.4 AND 0.65").drop("p")  # a row for each source


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source UNION SELECT lang, min(doc_id) FROM documents GROUP BY lang")
def U01_U03_union_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.min("doc_id").alias("doc_id")).unionByName(d.groupBy(F.col("lang").alias("source")).agg(F.min("doc_id").alias("doc_id"))).distinct()


@query("SELECT a.doc_id, coalesce(b.toxic, -1) AS label, CASE WHEN b.doc_id IS NULL THEN 'unlabelled' WHEN b.quality = 1 THEN 'copied' ELSE 'skipped' END AS outcome FROM documents a LEFT JOIN labels b ON a.doc_id = b.doc_id")
def Y01_Y02_label_propagation(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "toxic", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id").join(lab, F.col("doc_id") == F.col("l"), "left")
    return d.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("label"), F.when(F.col("l").isNull(), "unlabelled").when(F.col("quality") == 1, "copied").otherwise("skipped").alias("outcome"))


@query("SELECT source, round(avg(quality), 6) AS score, rank() OVER (ORDER BY round(avg(quality), 6) DESC) AS rank FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de' GROUP BY source")
def Y03_rerank_without(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    s = d.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("score"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))).cast("long"))  # a row for each source


@query("SELECT text FROM (SELECT text FROM benchmark EXCEPT ALL SELECT text FROM documents)")
def Y05_text_difference(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("text").exceptAll(table(spark, sf_dir, "documents").select("text"))


@query(f"SELECT pmcid, te_id, row_number() OVER (PARTITION BY pmcid ORDER BY te_id) AS chunk_no FROM {TEXT_ELEMENTS} WHERE n_words >= 40")
def Y13_renumber_chunks(spark, sf_dir):
    return text_elements(spark, sf_dir).where("n_words >= 40").select("pmcid", "te_id", F.row_number().over(Window.partitionBy("pmcid").orderBy("te_id")).alias("chunk_no"))


@query(f"SELECT c.pmcid, count(f.fid) AS n FROM (SELECT DISTINCT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid FROM documents) c LEFT JOIN {FINDINGS} f ON f.pmcid = c.pmcid AND f.te_id = 3 GROUP BY c.pmcid")
def Y08_findings_of_a_case(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid")).distinct()
    f = findings(spark, sf_dir).where("te_id = 3").groupBy("pmcid").agg(F.count("*").alias("k"))
    return cases.join(f, "pmcid", "left").select("pmcid", F.coalesce("k", F.lit(0)).alias("n"))
