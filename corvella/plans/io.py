"""Queries that go through readers, writers, streams and stand-ins for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.functions.text import tolerant_double
from corvella.operators import models as Mo
from corvella.operators.graph import shared_path as _scratch
from corvella.plans.registry import query
from corvella.sources import readers as Rd
from corvella.sources import writers as Wr
from corvella.sources.domain import FINDINGS, RUNS, USAGE, findings, prices, runs, table, usage
from corvella.streaming import incremental as In


@query(f"SELECT event_id, paper_id, stage, input_tokens FROM {USAGE}")
def S03_S06_S07_S08_K01_jsonl(spark, sf_dir):
    path = _scratch(spark)
    Wr.write_jsonl(usage(spark, sf_dir).select("event_id", "paper_id", "stage", "input_tokens"), path)
    return Rd.jsonl(spark, path, "event_id long, paper_id string, stage string, input_tokens long")[0]


@query("SELECT page_id, url FROM pages")
def S01_S10_S21_K03_csv(spark, sf_dir):
    path = _scratch(spark)
    Wr.write_csv(table(spark, sf_dir, "pages").select("page_id", "url"), path)
    return Rd.csv_rows(spark, path, "page_id long, url string")


@query("SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid FROM documents")
def S02_id_list(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "documents").select(F.concat(F.lit("  PMC"), F.col("doc_id").cast("string"), F.lit(" "))).write.text(path)
    return Rd.id_list(spark, path)


@query(f"SELECT run_id, pmcid, status FROM {RUNS}")
def K02_R01_stream_append(spark, sf_dir):
    src, out, state = _scratch(spark), _scratch(spark), _scratch(spark)
    Wr.write_jsonl(runs(spark, sf_dir).select("run_id", "pmcid", "status"), src)
    In.once(In.tail_json(spark, src, "run_id long, pmcid string, status string"), out, state)
    return spark.read.parquet(out)


@query("SELECT p_partkey FROM part")
def K04_Y15_idempotent_append(spark, sf_dir):
    path = _scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey")
    part.where("p_partkey % 3 = 0").write.parquet(path)
    Wr.append_new(part, spark.read.parquet(path), ["p_partkey"], path)
    return spark.read.parquet(path)


@query(f"SELECT config, pmcid, count(*) AS n FROM (SELECT config, pmcid FROM {RUNS} WHERE status <> 'P' UNION ALL SELECT config, pmcid FROM {RUNS} WHERE status = 'P' AND config <> '5-LOW') WHERE config <> '5-LOW' GROUP BY ALL UNION ALL SELECT config, pmcid, count(*) FROM {RUNS} WHERE config = '5-LOW' AND status = 'P' GROUP BY ALL")
def K06_K08_replace_partition(spark, sf_dir):
    path, r = _scratch(spark), runs(spark, sf_dir).select("config", "pmcid", "status")
    Wr.replace_partition(r, path, ["config"])
    Wr.replace_partition(r.where("config = '5-LOW' AND status = 'P'"), path, ["config"])
    return spark.read.parquet(path).groupBy("config", "pmcid").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_partkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 10 = 0")
def K07_R03_replace_edges(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    ids = line.select(F.explode(F.array("l_orderkey", "l_partkey")).alias("id")).where("id % 10 = 0").distinct()
    old = line.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))
    return Wr.replaced_edges(old, line.where("l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b", ids)


@query("SELECT event_id AS run_event, event_type AS run_info_kind, value AS run_info_value FROM events")
def K09_K10_Y04_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(F.struct(F.col("event_id").alias("event"), F.struct(F.col("event_type").alias("kind"), "value").alias("info")).alias("run"))
    return Wr.flatten(nested)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id")
def K12_K14_document_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pmcid"), F.col("turn").alias("pos"), F.col("role").alias("path"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path", "text")))
    return c.groupBy("pmcid").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")).withColumnRenamed("pmcid", "conv_id")


@query("SELECT event_id, TRY_CAST(nullif(trim(t), '') AS DOUBLE) AS score FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' 0.25 ' WHEN 1 THEN '' ELSE 'n/a' END AS t FROM events)")
def S20_tolerant_numbers(spark, sf_dir):
    k = F.col("event_id") % 3
    return table(spark, sf_dir, "events").withColumn("t", F.when(k == 0, " 0.25 ").when(k == 1, "").otherwise("n/a")).select("event_id", tolerant_double("t").alias("score"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) = 'economy' THEN 'cheap' WHEN lower(p_type) = 'promo' THEN 'C0001' ELSE p_type END AS p_type_resolved FROM part")
def S19_T10_resolve_entities(spark, sf_dir):
    names = Rd.synonyms(spark, {"cheap": ["economy"]})
    concepts = spark.createDataFrame([("PROMO", "C0001")], "mention string, concept string")
    return Rd.resolve_entities(table(spark, sf_dir, "part").select("p_partkey", "p_type"), names, concepts, "p_type").select("p_partkey", "p_type_resolved")


@query("SELECT model, p_in, p_out, p_cached FROM (VALUES ('model-0', 0.15::DOUBLE, 0.6::DOUBLE, 0.075::DOUBLE), ('model-1', 1.25, 10.0, NULL), ('model-2', 3.0, 15.0, 0.3)) AS t(model, p_in, p_out, p_cached)")
def S18_price_book(spark, sf_dir):
    assert prices(spark).count() == 3
    return Rd.price_book(spark, '{"model-0": {"input": 0.15, "output": 0.6, "cached": 0.075}, "model-1": {"input": 1.25, "output": 10}, "model-2": {"input": 3, "output": 15, "cached": 0.3}, "bad": {"input": "x"}}')


@query("SELECT mention, cui FROM (SELECT p_name AS mention, 'C' || CAST(p_partkey AS VARCHAR) AS cui, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, 'C' || CAST(p_partkey AS VARCHAR)) AS r FROM part WHERE p_size % 5 <> 0) WHERE r = 1")
def F07_F08_X02_best_concept(spark, sf_dir):
    types = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("T008"))).otherwise(F.array(F.lit("T047"), F.lit("T008")))
    links = table(spark, sf_dir, "part").select(F.col("p_name").alias("mention"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("cui"), F.col("p_retailprice").alias("score"), types.alias("types"))
    return Mo.best_concept(links).select("mention", "cui")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, lower(array_to_string(lines[s + 1:s + 5], ' ')) AS premise, list_distinct(string_split_regex(lower(lines[1]), '\s+')) AS h FROM (SELECT *, unnest(range(0, len(lines), 5)) AS s FROM l))
SELECT doc_id AS id, round(max(CASE WHEN trim(premise, ' ') = '' THEN 0.0 ELSE len(list_intersect(h, string_split_regex(premise, '\s+'))) / len(h) END), 6) AS entailment FROM w GROUP BY doc_id""")
def X01_entailment_stand_in(spark, sf_dir):
    lines = F.split("text", "\n")
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), lines.alias("sentences"), lines[0].alias("claim"))
    return Mo.windowed_entailment(pairs, Mo.TokenOverlap()).withColumn("entailment", F.round("entailment", 6))


@query(f"SELECT pmcid, CASE WHEN min(CASE WHEN score IS NULL THEN te_id % 3 + 1 END) IS NULL THEN 'done' ELSE 'L' || CAST(min(CASE WHEN score IS NULL THEN te_id % 3 + 1 END) AS VARCHAR) END AS phase FROM {FINDINGS} GROUP BY pmcid")
def R02_next_phase(spark, sf_dir):
    h = findings(spark, sf_dir).select("pmcid", (F.col("te_id") % 3 + 1).alias("level"), F.col("score").isNotNull().alias("decided"))
    return In.next_phase(h)


@query(f"SELECT paper_id, item_id FROM (SELECT DISTINCT paper_id, item_id FROM {USAGE}) EXCEPT SELECT paper_id, item_id FROM {USAGE} WHERE level = 1")
def R04_Y06_Y12_pending(spark, sf_dir):
    u = usage(spark, sf_dir)
    return In.pending(u.select("paper_id", "item_id").distinct(), u.where("level = 1"), ["paper_id", "item_id"])


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def R06_stage_cache(spark, sf_dir):
    root = _scratch(spark)
    build = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    In.stage_cache(spark, root, "langs", "v1", build)
    return In.stage_cache(spark, root, "langs", "v1", lambda: (_ for _ in ()).throw(AssertionError("it is cached")))


@query(f"SELECT date_trunc('hour', ts) AS hour, stage, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens FROM {USAGE} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {USAGE}) - INTERVAL 2 HOUR GROUP BY ALL")
def R07_stream_hourly_usage(spark, sf_dir):
    src, out, state = _scratch(spark), _scratch(spark), _scratch(spark)
    usage(spark, sf_dir).select("stage", "input_tokens", "ts").write.parquet(src)
    stream = spark.readStream.schema("stage string, input_tokens long, ts timestamp").parquet(src)
    In.once(In.hourly_usage(stream), out, state)
    return spark.read.parquet(out)
