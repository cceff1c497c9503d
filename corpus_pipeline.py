"""A corpus pipeline: filter toxic texts, remove exact and near copies and contaminated documents, tokenize what is left.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the
columns of `documents` unchanged. Where a decision is made text by text, the row itself passes through the operator, so
only the two deduplication stages join their decisions to the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm.bpe import bpe_encode_decode
from corvella.llm.common import materialize, safe_id, table
from corvella.llm.decontaminate import contamination_report, decontaminate
from corvella.llm.exact_dedup import exact_dedup
from corvella.llm.jaccard_join import jaccard_classes
from corvella.llm.toxicity import toxicity


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents less those that `dropped` (doc_id, text_hash) names; the hash tells apart texts that share an id."""
    gone = dropped.select(safe_id("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    return docs.join(gone, (safe_id("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring does not reject. Null and empty texts say nothing and stay; rows alike in text stay or go together."""
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 0").select("doc.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null one is empty) the document with the largest doc_id, a null id ranking last; rows that repeat id and text become one."""
    groups = exact_dedup(docs.select("doc_id", "text"), keep="largest")
    repeats = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeats:
        docs = docs.withColumn("_empty", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "_empty"]).drop("_empty")
    gone = groups.where(~F.col("kept")).select(safe_id("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.join(gone, (safe_id("doc_id") == F.col("_gone_id")) & (own == F.col("_gone_text")), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the first document by doc_id (a null id ranks first, equal ids by a hash of the text).

    Texts without words are no copies of each other and stay."""
    return _without(docs, jaccard_classes(docs.select("doc_id", "text")).where(~F.col("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark. Texts without words stay; rows alike in text stay or go together."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return contamination_report(found).where(~F.col("contaminated")).select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text left (of a null or empty one none), with digests of the ids and of what they decode to; a row for each row."""
    return bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, pieces=60_000)  # executors' heaps are full by now


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", tokenize)]
#: A learned score decides in the first stage, which SQL can't express; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
