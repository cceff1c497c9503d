"""Domain views over the driver tables, in DataFrame form and as SQL with the same rows.

The tables are not papers; each view derives the domain's rows from them by plain expressions, so that operators can be
run at any scale and compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted findings: who says what about which pair of entities, where, how surely. Some lack a subject or a score."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 101 + F.col("l_suppkey") * 11 + F.col("l_linenumber")).alias("fid"),
        F.concat(F.lit("PMC"), (F.col("l_orderkey") % 20).cast("string")).alias("pmcid"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_brand")).alias("subject"), F.col("p_type").alias("outcome"),
        F.element_at(F.array(F.lit("increases"), F.lit("decreases"), F.lit("unclear")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("relation"),
        F.col("l_returnflag").alias("category"),
        F.when(F.col("l_linestatus") == "O", "positive").when(F.col("l_quantity") > 45, "unclear").otherwise("negative").alias("direction"),
        F.when(F.col("l_discount") > 0.005, F.round(F.col("l_discount") * 10, 2)).alias("score"), (F.col("l_partkey") % 40).alias("te_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("voter"),
    )


FINDINGS = """(SELECT l_orderkey * 1000003 + l_partkey * 101 + l_suppkey * 11 + l_linenumber AS fid, 'PMC' || CAST(l_orderkey % 20 AS VARCHAR) AS pmcid,
 CASE WHEN p_size % 17 <> 0 THEN p_brand END AS subject, p_type AS outcome,
 CASE l_linenumber % 3 WHEN 0 THEN 'increases' WHEN 1 THEN 'decreases' ELSE 'unclear' END AS relation, l_returnflag AS category,
 CASE WHEN l_linestatus = 'O' THEN 'positive' WHEN l_quantity > 45 THEN 'unclear' ELSE 'negative' END AS direction,
 CASE WHEN l_discount > 0.005 THEN round(l_discount * 10, 2) END AS score, l_partkey % 40 AS te_id, l_quantity AS quantity, l_suppkey AS voter
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text elements with a section path."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), (F.col("doc_id") * 100000 + F.col("pos")).alias("te_id"), F.col("pos").cast("long").alias("pos"),
        F.concat_ws(" > ", "source", "lang").alias("path"), "text", F.size(F.split("text", " ")).cast("long").alias("n_words"),
    )


TEXT_ELEMENTS = """(SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid, doc_id * 100000 + pos AS te_id, pos, source || ' > ' || lang AS path, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_words
 FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one row for each event."""
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", F.concat(F.lit("PMC"), (F.col("user_id") % 25).cast("string")).alias("paper_id"), F.col("event_type").alias("stage"),
        F.concat(F.lit("model-"), (F.col("event_id") % 4).cast("string"), F.when(F.col("event_id") % 8 == 3, "@batch").otherwise("")).alias("model"),
        item.cast("long").alias("item_id"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.floor(F.col("value") * 13).cast("long").alias("output_tokens"),
        F.floor(F.col("value") * 7).cast("long").alias("cached_tokens"), (F.col("event_id") % 5 == 0).alias("batch_used"), (F.col("event_id") % 3 + 1).cast("int").alias("level"),
        F.when(F.col("event_id") % 19 == 0, "failed").otherwise("ok").alias("status"), F.element_at(F.array(F.lit("map"), F.lit("judge"), F.lit("relate")), (F.col("event_id") % 3 + 1).cast("int")).alias("role"), "ts",
    )


USAGE = """(SELECT event_id, 'PMC' || CAST(user_id % 25 AS VARCHAR) AS paper_id, event_type AS stage,
 'model-' || CAST(event_id % 4 AS VARCHAR) || CASE WHEN event_id % 8 = 3 THEN '@batch' ELSE '' END AS model, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
 CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 13) AS BIGINT) AS output_tokens, CAST(floor(value * 7) AS BIGINT) AS cached_tokens,
 event_id % 5 = 0 AS batch_used, CAST(event_id % 3 + 1 AS INTEGER) AS level, CASE WHEN event_id % 19 = 0 THEN 'failed' ELSE 'ok' END AS status,
 CASE event_id % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'judge' ELSE 'relate' END AS role, ts FROM events)"""

#: Prices by model, per million tokens: input, output, cached input (null: as input). model-3 has none.
PRICES = [("model-0", 0.15, 0.6, 0.075), ("model-1", 1.25, 10.0, None), ("model-2", 3.0, 15.0, 0.3)]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, p_in double, p_out double, p_cached double")


PRICES_SQL = "(SELECT * FROM (VALUES ('model-0', 0.15::DOUBLE, 0.6::DOUBLE, 0.075::DOUBLE), ('model-1', 1.25, 10.0, NULL), ('model-2', 3.0, 15.0, 0.3)) AS t(model, p_in, p_out, p_cached))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline runs of papers."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("PMC"), (F.col("o_custkey") % 200).cast("string")).alias("pmcid"), F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("wall_s"), F.col("o_orderpriority").alias("config"))


RUNS = "(SELECT o_orderkey AS run_id, 'PMC' || CAST(o_custkey % 200 AS VARCHAR) AS pmcid, o_orderdate AS started_at, o_orderstatus AS status, o_totalprice AS wall_s, o_orderpriority AS config FROM orders)"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade decisions: a chunk of a paper at a level, with how far its voters agree."""
    e = table(spark, sf_dir, "events")
    agreement = F.round(F.col("value") % 1.0, 3)
    return e.select("event_id", F.concat(F.lit("PMC"), (F.col("user_id") % 25).cast("string")).alias("pmcid"), (F.col("event_id") % 40).alias("chunk"), (F.col("event_id") % 3 + 1).cast("int").alias("level"), (F.col("user_id") % 5).cast("int").alias("n_eligible"), (F.col("event_id") % 11 == 0).alias("polarity_conflict"), agreement.alias("agreement"), "ts")


DECISIONS = "(SELECT event_id, 'PMC' || CAST(user_id % 25 AS VARCHAR) AS pmcid, event_id % 40 AS chunk, CAST(event_id % 3 + 1 AS INTEGER) AS level, CAST(user_id % 5 AS INTEGER) AS n_eligible, event_id % 11 = 0 AS polarity_conflict, round(value % 1.0, 3) AS agreement, ts FROM events)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim vectors: side S (silver) or P (pipeline) of a case."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / 20)).cast("long").alias("case_id"), F.when(F.col("vec_id") % 2 == 0, "S").otherwise("P").alias("side"), F.col("label").alias("category"), (F.col("vec_id") % 3).cast("int").alias("voter"), "embedding")


CLAIMS = "(SELECT vec_id, vec_id // 20 AS case_id, CASE WHEN vec_id % 2 = 0 THEN 'S' ELSE 'P' END AS side, label AS category, CAST(vec_id % 3 AS INTEGER) AS voter, embedding FROM embeddings)"
