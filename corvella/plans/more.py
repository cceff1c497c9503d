"""Further queries: paragraphs, quotes, cross-paper gates, held-out scores, folders of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import agreement as A
from corvella.operators import matching as M
from corvella.operators import rules as R
from corvella.plans.decisions import GREEDY, _pairs, _scored
from corvella.plans.io import _scratch
from corvella.plans.registry import query
from corvella.plans.rules import GROUPABLE
from corvella.sources import readers as Rd
from corvella.sources import writers as Wr
from corvella.sources.domain import CLAIMS, FINDINGS, TEXT_ELEMENTS, findings, runs, table, text_elements

PARAGRAPH = f"(SELECT te_id, pmcid, CASE te_id % 6 WHEN 0 THEN 'Copyright ' || text WHEN 1 THEN 'doi.org/10.1 ' || text WHEN 2 THEN '12. Smith J, ' || text WHEN 3 THEN 'two words' ELSE text END AS t FROM {TEXT_ELEMENTS})"


def _paragraphs(spark, sf_dir):
    k, text = F.col("te_id") % 6, F.col("text")
    t = F.when(k == 0, F.concat(F.lit("Copyright "), text)).when(k == 1, F.concat(F.lit("doi.org/10.1 "), text)).when(k == 2, F.concat(F.lit("12. Smith J, "), text)).when(k == 3, "two words").otherwise(text)
    return text_elements(spark, sf_dir).select("te_id", "pmcid", t.alias("t"))


@query(rf"""SELECT te_id FROM (SELECT te_id, trim(t, ' ') AS t FROM {PARAGRAPH}) WHERE NOT regexp_matches(lower(t), '^(copyright|open access|conflict of interest|author contributions|funding|acknowledg|received:|correspondence)')
 AND NOT regexp_matches(t, '^(?:[A-Z][a-z]+ [A-Z]\.? [A-Z][a-z]+,? ?){{2,}}') AND NOT regexp_matches(lower(t), 'crossref|doi\.org/10\.') AND NOT regexp_matches(t, '\d{{4}};\d+')
 AND NOT (regexp_matches(t, '^\d+\.\s+') AND (regexp_matches(t, '[A-Z][a-z]+\s+[A-Z][\.,]') OR (regexp_matches(t, '\b(19|20)\d{{2}}\b') AND (regexp_matches(t, '\b(doi|DOI|http|www|PMID|ISBN)') OR length(t) > 100))))
 AND len(regexp_extract_all(t, '[0-9A-Za-z_][0-9A-Za-z_\x{{00C0}}-\x{{024F}}]+,\s+[A-Z]\.')) < 2
 AND NOT (regexp_matches(t, '^[A-Z][a-z]+[\s,]+[A-Z]') AND regexp_matches(substr(t, 1, 150), '(?i)\bet\s+al\.') AND regexp_matches(t, '\b(19|20)\d{{2}}\b')) AND len(regexp_split_to_array(t, '\s+')) >= 4""")
def F03_F04_T03_relevant_paragraphs(spark, sf_dir):
    return _paragraphs(spark, sf_dir).where(T.is_relevant("t")).select("te_id")


@query()
def F15_verbatim_ratio(spark, sf_dir):
    te = text_elements(spark, sf_dir).select("te_id", F.col("text").alias("source"), F.when(F.col("te_id") % 2 == 0, F.substring("text", 5, 40)).otherwise(F.reverse(F.substring("text", 1, 40))).alias("quote"))
    return M.verbatim_ratio(te, "quote", "source").groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean"))


@query(f"""WITH r AS (SELECT pmcid, subject, outcome, relation, category, direction FROM {FINDINGS} WHERE {GROUPABLE} AND direction <> 'unclear' GROUP BY ALL)
SELECT a.pmcid AS pmcid_a, b.pmcid AS pmcid_b, count(*) AS n, count(*) FILTER (a.direction <> b.direction) AS opposite FROM r a JOIN r b USING (subject, outcome, relation, category) WHERE a.pmcid < b.pmcid GROUP BY ALL""")
def J07_cross_paper_gate(spark, sf_dir):
    key = ["subject", "outcome", "relation", "category"]
    r = findings(spark, sf_dir).where(R.groupable() & (F.col("direction") != "unclear")).select("pmcid", *key, "direction").distinct()
    side = lambda x: r.select(*key, F.col("pmcid").alias(f"pmcid_{x}"), F.col("direction").alias(f"d_{x}"))
    pairs = side("a").join(side("b"), key).where("pmcid_a < pmcid_b")
    return pairs.groupBy("pmcid_a", "pmcid_b").agg(F.count("*").alias("n"), F.count_if(F.col("d_a") != F.col("d_b")).alias("opposite"))


@query(f"SELECT pmcid, pos FROM {TEXT_ELEMENTS} WHERE pos // 3 >= 1 AND pos // 3 < 3")
def W12_chunk_slice(spark, sf_dir):
    chunk = F.floor(F.col("pos") / 3)
    return text_elements(spark, sf_dir).where((chunk >= 1) & (chunk < 3)).select("pmcid", F.col("pos").cast("long").alias("pos"))


@query("SELECT lang, min(doc_id) AS doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY lang")
def W20_first_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT polarity, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS polarity FROM part) GROUP BY polarity")
def T13_polarity(spark, sf_dir):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "it was not much increased").when(k == 1, "Elevated").when(k == 2, "not in that way is it high").when(k == 3, "non-expressed and low").otherwise("high and low")
    return table(spark, sf_dir, "part").select(T.polarity(text).alias("polarity")).groupBy("polarity").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, greatest(p_size, 10) >= 2 * least(p_size, 10) AND p_partkey % 2 = 0 AS contradicts FROM part")
def V15_numeric_contradiction(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("a", F.concat(F.lit("about "), F.col("p_size").cast("string"))).withColumn("b", F.when(F.col("p_partkey") % 2 == 0, "10 cases").otherwise("10 of 20"))
    return p.select("p_partkey", T.numeric_contradiction("a", "b").alias("contradicts"))


@query(f"WITH RECURSIVE {GREEDY.replace('> 0.05', '> 0.0')}, n AS (SELECT case_id, count(*) AS n FROM {CLAIMS} GROUP BY case_id HAVING count(DISTINCT side) = 2), s AS (SELECT case_id, sum(similarity) AS s FROM matched GROUP BY case_id) SELECT case_id, round(2 * coalesce(s, 0) / n, 5) AS f1 FROM n LEFT JOIN s USING (case_id)")
def V03_greedy_f1(spark, sf_dir):
    return M.alignment_f1(_pairs(spark, sf_dir), "greedy")


@query()
def V03_optimal_f1(spark, sf_dir):
    return M.alignment_f1(_pairs(spark, sf_dir))


@query(f"SELECT pmcid, count(*) AS total, count(*) FILTER (coalesce(score, 1) >= 0.5) AS kept, count(*) FILTER (score < 0.5) AS rejected, true AS consistent FROM {FINDINGS} GROUP BY pmcid")
def D08_gather_with_invariants(spark, sf_dir):
    f = findings(spark, sf_dir)
    low = F.coalesce(F.col("score") < 0.5, F.lit(False))
    kept, rejected = f.where(~low).groupBy("pmcid").agg(F.count("*").alias("kept")), f.where(low).groupBy("pmcid").agg(F.count("*").alias("rejected"))
    total = f.groupBy("pmcid").agg(F.count("*").alias("total"))
    out = total.join(kept, "pmcid", "left").join(rejected, "pmcid", "left").fillna(0, ["kept", "rejected"])
    return out.withColumn("consistent", F.col("kept") + F.col("rejected") == F.col("total")).select("pmcid", "total", "kept", "rejected", "consistent")


@query("SELECT t AS theta, count(*) FILTER (score >= t) AS kept, coalesce(round(count(*) FILTER (score >= t AND quality = 1) / nullif(count(*) FILTER (score >= t), 0), 6), 0.0) AS precision, coalesce(round(count(*) FILTER (score >= t AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6), 0.0) AS recall FROM (SELECT doc_id, quality, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), (VALUES (0.4::DOUBLE), (0.9)) AS g(t) WHERE list_reduce(list_prepend(0, list_transform(string_split(md5('42:' || CAST(doc_id AS VARCHAR)), ''), lambda x: strpos('0123456789abcdef', x) - 1)), lambda a, d: (a * 16 + d) % 100) >= 80 GROUP BY t")
def Y14_heldout_scores(spark, sf_dir):
    held = T.mod_of_md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 100) >= 80
    return A.threshold_metrics(_scored(spark, sf_dir).where(held), "score", "quality", [0.4, 0.9]).select("theta", "kept", "precision", "recall")


@query("SELECT 7 AS value, count(*) FILTER (doc_id = 7) > 0 AS found FROM documents")
def S04_exists(spark, sf_dir):
    return spark.createDataFrame([(7, Rd.exists_in(table(spark, sf_dir, "documents"), "doc_id", 7))], "value int, found boolean")


@query("SELECT c_custkey, c_name AS name FROM customer")
def S05_S16_folder_of_json(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name")).alias("paper")).repartition(4).write.json(path)
    return spark.read.schema("c_custkey long, paper struct<name:string>").json(path).select("c_custkey", "paper.name")


@query("SELECT p_partkey, 'page' || CAST(p_size AS VARCHAR) AS k FROM part")
def S11_S13_layout_elements(spark, sf_dir):
    path, c = _scratch(spark), F.col
    box = F.struct(c("p_size").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
    e = F.struct(c("p_partkey").cast("int").alias("element_index"), F.lit("text").alias("type"), c("p_size").alias("page"), box.alias("bbox"), F.lit("t").alias("text"), F.lit(1).alias("level"))
    papers = table(spark, sf_dir, "part").groupBy(F.floor(c("p_partkey") / 40)).agg(F.collect_list(e).alias("elements"))  # 40 elements a paper, a file a paper
    papers.select("elements").write.option("maxRecordsPerFile", 1).json(path)
    return Rd.layout_elements(spark, path).select(c("element_index").cast("long").alias("p_partkey"), F.concat(F.lit("page"), F.regexp_extract("key", r"::p(\d+)_text", 1)).alias("k"))


@query("SELECT 'A' AS section, count(*) AS n FROM supplier UNION ALL SELECT 'B C', count(*) FROM supplier")
def S12_tagged_sections(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("[A]\nfirst "), "s_name", F.lit("\n[B C]\nsecond\n"))).write.option("maxRecordsPerFile", 50).text(path)
    return Rd.tagged_sections(spark, path).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT s_name || '.pdf' AS pdf FROM supplier")
def S25_self_uri(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "supplier").select(F.concat(F.lit('<article xmlns:xlink="x"><self-uri xlink:href="'), "s_name", F.lit('.pdf"/></article>'))).write.option("maxRecordsPerFile", 1).text(path)
    return Rd.self_uri(spark, path).select("pdf")


@query("SELECT o_orderkey AS chunk_id, l_linenumber AS a, l_quantity AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def K11_pairwise_scores(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("s"))).alias("pairwise_scores"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.lit("P").alias("pmcid"))
    return Wr.pairwise_scores(orders.join(line, F.col("chunk_id") == F.col("l_orderkey"), "left")).select("chunk_id", "a", "s")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def K13_by_concept(spark, sf_dir):
    path = _scratch(spark)
    Wr.write_by_concept(table(spark, sf_dir, "part").select("p_brand", "p_name"), path, "p_brand")
    return spark.read.json(path).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT 'o_orderstatus repeats' AS problem UNION ALL SELECT 'missing column o_x' UNION ALL SELECT 'o_custkey is bigint, not string'")
def F06_Y11_schema_drift(spark, sf_dir):
    o = Rd.check_filter(table(spark, sf_dir, "orders"), "o_orderstatus", "F")
    found = Wr.schema_drift(o, {"o_x": "int", "o_custkey": "string", "o_orderkey": "bigint"}, [["o_orderkey"], ["o_orderstatus"]])
    return spark.createDataFrame([(x,) for x in found], "problem string")


@query("SELECT key, n FROM (SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1)")
def T24_manifest_digest(spark, sf_dir):
    import json

    counts = runs(spark, sf_dir).groupBy(F.col("status").alias("key")).agg(F.count("*").alias("n"))
    m = Wr.merge_manifests({"counts": {}}, json.loads(Wr.manifest(counts, {"a": 1})))
    if not Wr.markdown(counts, "Runs").startswith("# Runs"):
        raise ValueError("a report begins with its title")
    return spark.createDataFrame(list(m["counts"].items()), "key string, n long")
