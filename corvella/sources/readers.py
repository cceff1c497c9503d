"""Readers: every source is a Spark reader with an explicit schema; nothing is parsed on the driver but small configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

USAGE_SCHEMA = "run_id string, stage string, model string, provider string, role string, call_status string, paper_id string, item_id string, input_tokens long, output_tokens long, cached_tokens long, batch_used boolean, cascade_level int, timestamp string"
DECISION_SCHEMA = "run_id string, pmcid string, chunk_id string, level string, voter_count int, eligible_voter_count int, decision string, gate_origin string, reason_codes array<string>, deferral_score double"
LAYOUT_SCHEMA = "elements array<struct<element_index:int,type:string,page:int,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text:string,level:int>>"


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; malformed lines go."""
    return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, blanks ignored."""
    return spark.read.text(path).select(F.trim("value").alias("pmcid")).where("pmcid <> ''")


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the lines that don't fit the schema."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(path).select(F.col("value").alias("_line"), F.from_json("value", StructType(full.fields).add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return raw.where(~bad).select("r.*").drop("_corrupt"), raw.where(bad).select("_line")


def jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As `jsonl`, and no rows where the file is missing."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], schema)
    return jsonl(spark, path, schema)[0]


def exists_in(rows: DataFrame, key: str, value: object) -> bool:
    """Whether any row has the value; one row at most comes to the driver."""
    return not rows.where(F.col(key) == F.lit(value)).limit(1).isEmpty()


def summaries(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """A folder of one JSON document a paper, with the file's name."""
    return spark.read.schema(schema).json(directory, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def layout_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of layout files with a key made of place and type."""
    e = spark.read.schema(LAYOUT_SCHEMA).json(path, multiLine=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("pmcid"), F.explode("elements").alias("e"))
    key = F.format_string("%s::p%d_%s_%.1f_%.1f", F.col("pmcid"), F.col("e.page"), F.col("e.type"), F.col("e.bbox.x1"), F.col("e.bbox.y1"))
    return e.select("pmcid", "e.*", key.alias("key"))


def tagged_sections(spark: SparkSession, path: str) -> DataFrame:
    """Text files of [SECTION] blocks, one row a section."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("pmcid"), "value")
    parts = F.regexp_extract_all("value", F.lit(r"(?m)^(\[[A-Z0-9 _-]+\]\n(?:(?!\[[A-Z0-9 _-]+\]\n).*\n?)*)"), 1)
    block = whole.select("pmcid", F.posexplode(parts).alias("pos", "block"))
    return block.select("pmcid", "pos", F.regexp_extract("block", r"^\[([^\]]+)\]", 1).alias("section"), F.regexp_replace("block", r"^\[[^\]]+\]\n|\s+$", "").alias("text"))


def self_uri(spark: SparkSession, path: str) -> DataFrame:
    """The publisher's file name in article XML."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("pmcid"), F.expr("xpath_string(regexp_replace(value, 'xlink:href', 'href'), '//self-uri/@href')").alias("pdf"))


def selection(spark: SparkSession, config: str) -> DataFrame:
    """Buckets of ids in a small JSON or YAML mapping, flattened; of repeated ids the first bucket's stays."""
    try:
        buckets = json.loads(config)
    except ValueError:
        import yaml

        buckets = yaml.safe_load(config)
    seen: dict[str, str] = {}
    for bucket, ids in buckets.items():
        for i in ids or []:
            seen.setdefault(str(i), bucket)
    return spark.createDataFrame([(k, i, b) for k, (i, b) in enumerate(seen.items())], "position long, pmcid string, bucket string")


def price_book(spark: SparkSession, config: str) -> DataFrame:
    """Prices by model from a small JSON document; malformed entries go."""
    rows = []
    for model, p in json.loads(config).items():
        try:
            rows.append((model, float(p["input"]), float(p["output"]), None if p.get("cached") is None else float(p["cached"])))
        except (TypeError, KeyError, ValueError):
            continue
    return spark.createDataFrame(rows, "model string, p_in double, p_out double, p_cached double")


def synonyms(spark: SparkSession, config: dict[str, list[str]]) -> DataFrame:
    """Lower-cased names to canonical ones."""
    return spark.createDataFrame([(alias.lower(), name) for name, aliases in config.items() for alias in [name, *aliases]], "alias string, name string").dropDuplicates(["alias"])


def resolve_entities(rows: DataFrame, names: DataFrame, concepts: DataFrame, column: str) -> DataFrame:
    """A name by synonym, else by concept, else as it is."""
    s = names.select(F.col("alias").alias("_a"), F.col("name").alias("_s"))
    c = concepts.select(F.lower("mention").alias("_m"), F.col("concept").alias("_c"))
    low = F.lower(F.trim(F.col(column)))
    return rows.join(s, low == F.col("_a"), "left").join(c, low == F.col("_m"), "left").withColumn(f"{column}_resolved", F.coalesce("_s", "_c", F.col(column))).drop("_a", "_s", "_m", "_c")


def check_filter(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with the value; an error that names the values there are if none has it but there is data."""
    out = rows.where(F.col(column) == value)
    if out.limit(1).isEmpty() and not rows.limit(1).isEmpty():
        known = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(20).collect()]
        raise ValueError(f"no row has {column} = {value!r}; there are {known}")
    return out
