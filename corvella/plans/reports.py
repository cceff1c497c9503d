"""Queries for reports: labels of crops, rubrics, judge summaries, score distributions, proxy metrics, manifests, loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.operators import reports as Re
from corvella.operators.graph import shared_path
from corvella.plans.registry import query
from corvella.sources import artifacts as Ar
from corvella.sources import readers as Rd
from corvella.sources import writers as Wr
from corvella.sources.domain import DECISIONS, TEXT_ELEMENTS, USAGE, decisions, table, text_elements, usage

LABELS = ["Correct", "icon", "incorrect", "wrong caption left", "crop is too big", "weird", "missing footnotes", "correct minor", "unsure"]
LABEL_SQL = "CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"


def _crops(spark, sf_dir):
    c = F.col
    k = c("l_partkey") % 10
    label = F.when(k < 9, F.element_at(F.array(*map(F.lit, LABELS)), F.least(k + 1, F.lit(9)).cast("int")))
    return table(spark, sf_dir, "lineitem").select(c("l_shipdate"), F.when(c("l_linenumber") % 2 == 0, "figure").otherwise("table").alias("kind"), (c("l_suppkey") % 5).alias("variant"), label.alias("label"))


CROPS = f"(SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'figure' ELSE 'table' END AS kind, l_suppkey % 5 AS variant, {LABEL_SQL} AS label FROM lineitem)"


@query(f"""WITH c AS (SELECT variant, kind, coalesce(CASE WHEN kind = 'figure' THEN CASE WHEN lower(label) LIKE 'correct%' THEN 'tp' WHEN lower(label) IN ('icon', 'incorrect') THEN 'fp' ELSE 'skip' END
 WHEN lower(label) = 'correct' OR label LIKE 'missing footnotes%' THEN 'tp' WHEN label = 'incorrect' OR label LIKE 'wrong caption%' OR label LIKE 'crop is too big%' OR label LIKE 'weird%' THEN 'fp' END, 'skip') AS k FROM {CROPS}),
n AS (SELECT variant, kind, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'skip') AS skip FROM c GROUP BY ALL),
m AS (SELECT *, CASE WHEN kind = 'figure' THEN variant * 3 ELSE greatest(200 + variant - tp, 0) END AS fn FROM n), r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM m)
SELECT variant, kind, tp, fp, fn, skip, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 6) END AS f1 FROM r""")
def A37_label_metrics(spark, sf_dir):
    crops = _crops(spark, sf_dir)
    actual = crops.select("variant", "kind").distinct().select("variant", "kind", F.when(F.col("kind") == "figure", F.col("variant") * 3).alias("missed"), (200 + F.col("variant")).alias("total"))
    return Re.label_metrics(crops, actual, ["variant", "kind"])


DIMS = ["crop", "caption", "footnote", "mask"]
RUBRIC = [("correct", "1.0", "1.0", "1.0", "n/a"), ("icon", "0", "skip", "n/a", "n/a"), ("wrong caption left", "1.0", "0.0", "1.0", "0.5"), ("crop is too big", "0.5", "1.0", "0.4", "1.0"), ("weird", "skip", "skip", "n/a", "skip"), ("missing footnotes", "1", "1", "bad", "1")]
_RUBRIC_SQL = "(VALUES " + ", ".join(str(r) for r in RUBRIC) + ") AS u(l, crop, caption, footnote, mask)"
RUBRIC_STATES = f"""c AS (SELECT row_number() OVER () AS i, variant, kind, label FROM {CROPS} WHERE label IS NOT NULL),
d AS (SELECT i, variant, u.l IS NOT NULL AS known, unnest(['crop', 'caption', 'footnote', 'mask']) AS dim, unnest([crop, caption, CASE WHEN kind = 'figure' THEN 'n/a' ELSE footnote END, mask]) AS v FROM c LEFT JOIN {_RUBRIC_SQL} ON u.l = lower(label)),
s AS (SELECT *, CASE WHEN NOT known THEN 'skip' WHEN v = 'n/a' THEN 'na' WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 'skip' WHEN CAST(v AS DOUBLE) >= 0.5 THEN 'tp' ELSE 'fp' END AS s, CASE WHEN NOT known THEN false WHEN v = 'n/a' THEN true ELSE coalesce(TRY_CAST(v AS DOUBLE) >= 1.0, false) END AS f FROM d)"""


def _rubric(spark, sf_dir):
    crops = _crops(spark, sf_dir).withColumn("figure", F.col("kind") == "figure")
    return Re.rubric_scores(crops, spark.createDataFrame(RUBRIC, ["label", *DIMS]), DIMS, ["variant"])


@query(f"WITH {RUBRIC_STATES} SELECT variant, dim, count(*) FILTER (s = 'tp') AS tp, count(*) FILTER (s = 'fp') AS fp, count(*) FILTER (s = 'na') AS na, count(*) FILTER (s = 'skip') AS skipped, round(count(*) FILTER (s = 'tp') / nullif(count(*) FILTER (s IN ('tp', 'fp')), 0), 6) AS precision FROM s GROUP BY variant, dim")
def A39_rubric_by_dimension(spark, sf_dir):
    return _rubric(spark, sf_dir)[0]


@query(f"WITH {RUBRIC_STATES}, w AS (SELECT i, variant, bool_or(s IN ('tp', 'fp')) AS scored, bool_and(f) AS whole FROM s GROUP BY ALL) SELECT variant, count(*) FILTER (scored AND whole) AS tp, count(*) FILTER (scored AND NOT whole) AS fp, count(*) FILTER (NOT scored) AS skipped, round(count(*) FILTER (scored AND whole) / nullif(count(*) FILTER (scored), 0), 6) AS precision FROM w GROUP BY variant")
def A39_rubric_strict(spark, sf_dir):
    return _rubric(spark, sf_dir)[1]


@query("""WITH s AS (SELECT lang, (n_chars % 120) / 100.0 AS s FROM documents WHERE n_chars % 11 > 0)
SELECT lang, count(*) AS n, min(s) AS least, median(s) AS median, max(s) AS largest, count(*) FILTER (s > 0.2 AND s <= 0.4) AS in_band, array_to_string(list_transform(range(10), lambda i: len(list_filter(list(least(CAST(floor(s * 10) AS INT), 9)), lambda x: x = i))), ',') AS histogram FROM s GROUP BY lang""")
def A50_score_distribution(spark, sf_dir):
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("lang", F.when(n % 11 > 0, (n % 120) / 100.0).alias("s"))
    return Re.distribution(d, "s", ["lang"], 0.2, 0.4).withColumn("histogram", F.array_join("histogram", ","))


def _judged(spark, sf_dir):
    k = F.col("event_id")
    changed = F.array_compact(F.array(F.when(k % 3 == 0, "direction"), F.when(k % 5 == 0, "subject_entity"), F.when(k % 7 == 0, "outcome_entity"), F.when(k % 11 == 0, "scope_tissue"), F.when(k % 13 == 0, "category")))
    return table(spark, sf_dir, "events").select("event_type", (k % 4 != 0).alias("is_grounded"), F.when(k % 9 != 0, changed).otherwise(F.array().cast("array<string>")).alias("fields_changed"), F.when(k % 6 != 0, (k % 101) / 100).alias("score"))


@query("""WITH e AS (SELECT event_type, event_id AS k, event_id % 9 = 0 AS none FROM events)
SELECT event_type, count(*) AS total, count(*) FILTER (k % 4 <> 0) AS grounded, round(count(*) FILTER (k % 4 <> 0) / count(*), 4) AS grounded_rate, 1.0::DOUBLE AS relation_type_accuracy, round(count(*) FILTER (none OR k % 3 <> 0) / count(*), 4) AS direction_accuracy,
 round(count(*) FILTER (none OR k % 13 <> 0) / count(*), 4) AS category_accuracy, round(count(*) FILTER (NOT none AND (k % 5 = 0 OR k % 7 = 0)) / count(*), 4) AS entity_error_rate, round(count(*) FILTER (NOT none AND k % 11 = 0) / count(*), 4) AS scope_error_rate FROM e GROUP BY event_type""")
def A43_A45_judged_findings(spark, sf_dir):
    return Re.judged_findings(_judged(spark, sf_dir), "event_type")


@query("SELECT event_type, printf('%.1f', floor((event_id % 101) / 10.0) / 10) AS bucket, count(*) AS n, round(count(*) FILTER (event_id % 4 <> 0) / count(*), 3) AS positive_rate FROM events WHERE event_id % 6 <> 0 GROUP BY ALL")
def A44_calibration(spark, sf_dir):
    return Re.calibration(_judged(spark, sf_dir), "score", F.col("is_grounded"), ["event_type"])


@query("SELECT 'L' || CAST(quality AS VARCHAR) AS pipeline_label, 'L' || CAST(toxic AS VARCHAR) AS correct_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 4) AS share, (SELECT round(count(*) FILTER (quality = toxic) / count(*), 4) FROM labels) AS accuracy FROM labels GROUP BY ALL")
def A43_judged_relations(spark, sf_dir):
    label = lambda c: F.concat(F.lit("L"), F.col(c).cast("string"))
    return Re.judged_relations(table(spark, sf_dir, "labels").select(label("quality").alias("pipeline_label"), label("toxic").alias("correct_label"), (F.col("quality") == F.col("toxic")).alias("is_correct")))


@query(f"""WITH p AS (SELECT CASE te_id % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'not_extracted' ELSE 'unknown' END AS stratum, n_words > 30 AS gaps, n_words % 3 AS k FROM {TEXT_ELEMENTS})
SELECT stratum, count(*) AS n, count(*) FILTER (gaps) AS with_gaps, round(count(*) FILTER (gaps) / count(*), 4) AS gap_rate, CAST(sum(k) AS BIGINT) AS missing, round(sum(k) / count(*), 2) AS missing_per_paragraph FROM p GROUP BY GROUPING SETS ((stratum), ())""")
def A43_judged_paragraphs(spark, sf_dir):
    s = F.when(F.col("te_id") % 3 == 0, "extracted").when(F.col("te_id") % 3 == 1, "not_extracted")
    return Re.judged_paragraphs(text_elements(spark, sf_dir).select(s.alias("stratum"), (F.col("n_words") > 30).alias("has_gaps"), (F.col("n_words") % 3).alias("n_missing")))


@query(f"""WITH s AS (SELECT pmcid, count(*) AS paragraphs, CAST(sum(n_words % 3) AS BIGINT) AS tp, CAST(sum(n_words % 2) AS BIGINT) AS fp, CAST(sum(pos % 2) AS BIGINT) AS fn, CAST(sum(pos % 5) AS BIGINT) AS "partial" FROM {TEXT_ELEMENTS} GROUP BY pmcid), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s)
SELECT pmcid, paragraphs, tp, fp, fn, "partial", round(p, 4) AS micro_precision, round(r, 4) AS micro_recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS micro_f1 FROM r""")
def A43_judged_counts(spark, sf_dir):
    w, pos = F.col("n_words"), F.col("pos")
    return Re.judged_counts(text_elements(spark, sf_dir).select("pmcid", (w % 3).alias("tp"), (w % 2).alias("fp"), (pos % 2).alias("fn"), (pos % 5).alias("partial")), "pmcid")


# Papers are the 25 of the usage log and five without one; their findings, rules and edges are lines, parts and orders.
PROXY = f"""p AS (SELECT 'PMC' || CAST(n_nationkey + 2 AS VARCHAR) AS pmcid, n_nationkey AS run_id, CASE n_nationkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS status, n_name AS config FROM nation),
f AS (SELECT 'PMC' || CAST(l_orderkey % 30 AS VARCHAR) AS pmcid, count(*) AS raw_finding_count, count(*) FILTER (l_discount >= 0.05) AS grounded_finding_count, round(avg(l_discount), 6) AS mean_grounding_score, count(*) FILTER (l_linenumber > 1) AS normal_finding_count, count(*) FILTER (l_linenumber <= 1) AS non_groupable_total FROM lineitem GROUP BY 1),
r AS (SELECT 'PMC' || CAST(p_partkey % 30 AS VARCHAR) AS pmcid, count(*) AS canonical_rule_count, count(*) FILTER (p_size % 4 > 0) AS final_rule_count, round(count(*) FILTER (p_size % 5 = 0) / count(*), 6) AS unclear_no_direction_rate, count(*) FILTER (p_size % 4 > 0 AND p_size / 50.0 >= 0.5) AS final_rules_ge_0_5, least(count(*) FILTER (p_size % 4 > 0), 10) AS final_rules_top10 FROM part GROUP BY 1),
e AS (SELECT 'PMC' || CAST(o_custkey % 20 AS VARCHAR) AS pmcid, count(*) AS relations_total, count(*) FILTER (o_orderkey % 3 = 0) AS support_edge_count, count(*) FILTER (o_orderkey % 3 = 1) AS contradiction_edge_count, count(*) FILTER (o_orderkey % 3 = 2) AS scope_qualify_edge_count FROM orders GROUP BY 1),
d AS (SELECT pmcid, count(*) FILTER (level = 1) AS l1_chunks, count(*) FILTER (level = 2) AS l2_chunks, count(*) FILTER (level = 3) AS l3_chunks, count(*) FILTER (polarity_conflict) AS polarity_conflict_chunks FROM {DECISIONS} GROUP BY pmcid),
u AS (SELECT paper_id AS pmcid, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, round(sum(input_tokens / 1e6), 6) AS estimated_total_cost_usd FROM {USAGE} GROUP BY 1),
x AS (SELECT p.*, CAST(status IN ('F', 'O') AS INT) AS is_success_like, f.* EXCLUDE (pmcid), r.* EXCLUDE (pmcid), e.* EXCLUDE (pmcid), d.* EXCLUDE (pmcid), u.* EXCLUDE (pmcid), CASE WHEN f.pmcid IS NULL THEN 'missing' ELSE 'table' END AS finding_source, CASE WHEN r.pmcid IS NULL THEN 'missing' ELSE 'table' END AS rule_source,
 CASE WHEN e.pmcid IS NULL THEN 'missing' ELSE 'table' END AS relation_source, CASE WHEN d.pmcid IS NULL THEN 'missing' ELSE 'table' END AS decision_source, CASE WHEN u.pmcid IS NULL THEN 'missing' ELSE 'table' END AS token_count_source,
 round((raw_finding_count - grounded_finding_count) / raw_finding_count, 6) AS grounding_rejection_rate
 FROM p LEFT JOIN f USING (pmcid) LEFT JOIN r USING (pmcid) LEFT JOIN e USING (pmcid) LEFT JOIN d USING (pmcid) LEFT JOIN u USING (pmcid))"""


def _proxy(spark, sf_dir):
    c = F.col
    pmc = lambda k, n: F.concat(F.lit("PMC"), (c(k) % n).cast("string")).alias("pmcid")
    k = c("n_nationkey")
    papers = table(spark, sf_dir, "nation").select(F.concat(F.lit("PMC"), (k + 2).cast("string")).alias("pmcid"), k.alias("run_id"), F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("P").alias("status"), c("n_name").alias("config"))
    f = table(spark, sf_dir, "lineitem").select(pmc("l_orderkey", 30), (c("l_discount") >= 0.05).alias("grounded"), c("l_discount").alias("score"), (c("l_linenumber") > 1).alias("groupable"))
    r = table(spark, sf_dir, "part").select(pmc("p_partkey", 30), F.when(c("p_size") % 4 > 0, c("p_size") / 50.0).alias("final_score"), F.when(c("p_size") % 5 == 0, "Unclear").otherwise("positive").alias("direction"))
    e = table(spark, sf_dir, "orders").select(pmc("o_custkey", 20), F.when(c("o_orderkey") % 3 == 0, "support").when(c("o_orderkey") % 3 == 1, "CONTRADICT").otherwise("Scope_Qualify").alias("relation_type"))
    u = usage(spark, sf_dir).select(c("paper_id").alias("pmcid"), "input_tokens", "output_tokens", (c("input_tokens") / 1e6).alias("cost"))
    return Re.proxy_metrics(papers, f, r, e, decisions(spark, sf_dir).select("pmcid", "level", "polarity_conflict"), u)


@query(f"WITH {PROXY} SELECT * FROM x")
def A34_proxy_metrics(spark, sf_dir):
    return _proxy(spark, sf_dir)


@query(f"WITH {PROXY} SELECT count(*) AS n_papers, CAST(sum(is_success_like) AS BIGINT) AS n_success_like, CASE WHEN count(DISTINCT config) > 1 THEN 'MIXED' ELSE min(config) END AS config, CAST(sum(raw_finding_count) AS BIGINT) AS raw_finding_count, CAST(sum(relations_total) AS BIGINT) AS relations_total, round(avg(grounding_rejection_rate), 6) AS grounding_rejection_rate_mean, round(quantile_cont(grounding_rejection_rate, 0.5), 6) AS grounding_rejection_rate_median, round(quantile_cont(grounding_rejection_rate, 0.9), 6) AS grounding_rejection_rate_p90, count(grounding_rejection_rate) AS grounding_rejection_rate_n FROM x")
def A35_proxy_totals(spark, sf_dir):
    return Re.proxy_totals(_proxy(spark, sf_dir), ["raw_finding_count", "relations_total"], ["grounding_rejection_rate"])


@query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, o_orderkey % 97 AS wall FROM orders)
SELECT 'summary' AS section, 'n_with_stats' AS key, CAST(count(*) AS DOUBLE) AS value FROM s UNION ALL SELECT 'summary', 'n_ok', count(*) FILTER (status = 'ok') FROM s UNION ALL SELECT 'summary', 'n_failed', count(*) FILTER (status = 'failed') FROM s UNION ALL SELECT 'summary', 'total_wall_seconds', sum(wall) FROM s UNION ALL SELECT 'summary', 'mean_wall_seconds', round(avg(wall), 4) FROM s
UNION ALL SELECT 'counts', 'text_rows', sum(k % 7) FROM s UNION ALL SELECT 'counts', 'tables', sum(k % 3) FROM s UNION ALL SELECT 'reasons', 'rule ' || CAST(k % 4 AS VARCHAR), count(*) FROM s GROUP BY k % 4""")
def A40_manifest_totals(spark, sf_dir):
    k = F.col("o_orderkey")
    counts = F.create_map(F.lit("text_rows"), k % 7, F.lit("tables"), k % 3)
    reasons = F.create_map(F.concat(F.lit("rule "), (k % 4).cast("string")), F.lit(1))
    return Re.manifest_totals(table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, "failed").otherwise("ok").alias("status"), (k % 97).cast("double").alias("wall_seconds"), counts.alias("counts"), reasons.alias("reasons")))


@query("""WITH c AS (SELECT DISTINCT s_nationkey AS file, s_suppkey AS variant, round((s_suppkey % 3) * 0.4) AS x, s_suppkey % 2 AS y FROM supplier), l AS (SELECT * FROM c WHERE variant % 4 = 0)
SELECT l.file, c.variant, 'L' || CAST(l.variant % 3 AS VARCHAR) AS label, l.variant AS source FROM l JOIN c USING (file, x, y) WHERE l.variant <> c.variant""")
def J24_label_propagation(spark, sf_dir):
    k = F.col("s_suppkey")
    crops = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), k.alias("variant"), ((k % 3) * 0.4).alias("x1"), (k % 2).cast("double").alias("y1"), F.lit(5.0).alias("x2"), F.lit(None).cast("double").alias("y2"))
    labels = crops.where("variant % 4 = 0").select("file", "variant", F.concat(F.lit("L"), (F.col("variant") % 3).cast("string")).alias("label"))
    return Re.propagate_labels(labels, crops)


@query("SELECT position, pmcid, bucket FROM (VALUES (0, 'PMC1', 'related'), (1, 'PMC2', 'related'), (2, 'PMC3', 'hard')) AS t(position, pmcid, bucket)")
def S17_selection(spark, sf_dir):
    return Rd.selection(spark, '{"related": ["PMC1", "PMC2", "PMC1"], "diverse": null, "hard": ["PMC2", "PMC3"]}')


@query(f"SELECT pmcid, te_id, pos, len(regexp_split_to_array(text, '[.!?] ')) AS n_sentences FROM {TEXT_ELEMENTS} WHERE pmcid IN ('PMC3', 'PMC5')")
def S14_elements_of_papers(spark, sf_dir):
    """The loader's filter: two papers, each paper's elements in order."""
    te = text_elements(spark, sf_dir).where(F.col("pmcid").isin("PMC3", "PMC5"))
    return te.select("pmcid", "te_id", "pos", F.size(F.split("text", "[.!?] ")).cast("long").alias("n_sentences")).orderBy("pmcid", "te_id")


@query(f"""WITH e AS (SELECT 'PMC' || CAST(l_partkey % 200 AS VARCHAR) AS pmcid, 'E' || CAST(l_suppkey % 13 AS VARCHAR) AS entity, count(*) AS k FROM lineitem GROUP BY ALL), a AS (SELECT pmcid, array_to_string(list_sort(list(entity || ':' || CAST(k AS VARCHAR))), ',') AS entities FROM e GROUP BY pmcid),
t AS (SELECT pmcid, count(*) AS n_elements, CAST(sum(n_words) AS BIGINT) AS n_words FROM {TEXT_ELEMENTS} GROUP BY pmcid) SELECT pmcid, n_elements, n_words, coalesce(entities, '') AS entities FROM t LEFT JOIN a USING (pmcid)""")
def S15_S22_papers_with_entities(spark, sf_dir):
    """Papers with their elements and entities, read as partitions and never through a cursor."""
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("PMC"), (F.col("l_partkey") % 200).cast("string")).alias("pmcid"), F.concat(F.lit("E"), (F.col("l_suppkey") % 13).cast("string")).alias("entity"))
    counted = e.groupBy("pmcid", "entity").agg(F.count("*").alias("k")).groupBy("pmcid").agg(F.array_sort(F.collect_list(F.concat_ws(":", "entity", "k"))).alias("e"))  # a vocabulary of 13
    t = text_elements(spark, sf_dir).groupBy("pmcid").agg(F.count("*").alias("n_elements"), F.sum("n_words").alias("n_words"))
    return t.join(counted, "pmcid", "left").select("pmcid", "n_elements", "n_words", F.coalesce(F.array_join("e", ","), F.lit("")).alias("entities"))


@query("WITH i AS (SELECT o_orderkey AS k, o_orderpriority AS config FROM orders) SELECT 'ids' AS what, count(*) AS n, count(DISTINCT substr(sha256('r2' || chr(31) || 'map' || chr(31) || CAST(k AS VARCHAR)), 1, 16)) AS distinct_ids, min(substr(sha256('r2' || chr(31) || 'map' || chr(31) || CAST(k AS VARCHAR)), 1, 16)) AS least FROM i UNION ALL SELECT 'rows', 2 * count(*), NULL, NULL FROM i")
def K05_persisted_with_ids(spark, sf_dir):
    """Two runs of a stage, the second written twice: its id map, and how many rows there are in all."""
    path = shared_path(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("config"))
    for run in ("r1", "r2", "r2"):
        ids = Ar.persisted(rows, path, run, "map", ["k"])
    own = ids.agg(F.lit("ids").alias("what"), F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.min("id").alias("least")).select("what", "n", "distinct_ids", "least")
    return own.union(spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit("rows"), "n", F.lit(None).cast("long"), F.lit(None).cast("string")))


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) SELECT 'counts ' || status AS key, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'documents', count(*) FROM nation UNION ALL SELECT 'papers', 2 UNION ALL SELECT 'stages', 2""")
def K15_K16_run_artifacts(spark, sf_dir):
    """A run's folder over two calls, and a batch's manifest with sums over all orders and a row a nation."""
    root = shared_path(spark)
    totals = table(spark, sf_dir, "orders").groupBy(F.lit("counts").alias("section"), F.col("o_orderstatus").alias("key")).agg(F.count("*").cast("double").alias("value"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("pmcid"), F.lit("ok").alias("status"))
    for paper, stage in (("PMC1", "map"), ("PMC2", "relate")):
        run = Ar.RunArtifacts(spark, root, "r1", config={"theta": 0.9})
        run.add_paper(paper)
        run.write(stage, "totals", totals, paper, required=True)
        run.completed(stage)
    run.finish("completed")
    batch = Ar.batch_manifest(spark, f"{root}/run_b1.json", "b1", {"theta": 0.9}, totals, nations, {"glob": "*.pdf"})
    rows = [(f"counts {k}", v) for k, v in batch["summary"]["counts"].items()] + [("documents", float(len(batch["documents"]))), ("papers", float(len(run.manifest["papers"]))), ("stages", float(len(run.manifest["stages_completed"])))]
    return spark.createDataFrame(rows, "key string, value double")


@query("SELECT o_orderstatus AS status, '<td>' || o_orderstatus || '</td><td>' || CAST(count(*) AS VARCHAR) || '</td>' AS cells, true AS in_markdown FROM orders GROUP BY o_orderstatus")
def K17_reports(spark, sf_dir):
    """The cells of an HTML report and whether the Markdown one has them."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    page, plain = Ar.html_report("Runs", {"By status": counts}), Wr.markdown(counts, "Runs")
    rows = [(r["status"], cells, f"| {r['status']} | {r['n']} |" in plain) for r in counts.collect() if (cells := f"<td>{r['status']}</td><td>{r['n']}</td>") in page]
    return spark.createDataFrame(rows, "status string, cells string, in_markdown boolean")
