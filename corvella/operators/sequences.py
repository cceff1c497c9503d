"""Ordered sequences of text elements: chunks, islands, section headers, first places, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions.text import parse_citation


def overlapping_chunks(elements: DataFrame, size: int, overlap: int, pos: str = "pos") -> DataFrame:
    """Each element in every chunk of `size` that holds it; chunks start at multiples of size - overlap, as long as an element is there."""
    stride = size - overlap
    low = F.greatest(F.lit(0), F.floor((F.col(pos) - size + 1 + stride - 1) / stride) * 1)
    chunk = F.explode(F.sequence(low.cast("long"), F.floor(F.col(pos) / stride).cast("long")))
    return elements.withColumn("chunk", chunk)


def disjoint_chunks(elements: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    return elements.withColumn("chunk", F.concat(F.lit("C"), (F.floor(F.col(pos) / size) + 1).cast("string")))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Number the runs of rows with the same value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def reference_runs(rows: DataFrame, keys: list[str], order: list[str], is_list: str, is_reference: str) -> DataFrame:
    """Mark runs of list elements with two references or more; they are skipped as a whole."""
    runs = islands(rows, keys, order, is_list)
    n = F.sum(F.col(is_reference).cast("int")).over(Window.partitionBy(*keys, "island"))
    return runs.withColumn("skipped", F.when(F.col(is_list), n >= 2).otherwise(False))


def section_headers(rows: DataFrame, keys: list[str], pos: str, level: str, header: str, depth: int) -> DataFrame:
    """For each row the last header of every level; a header ends those of deeper levels."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k in range(1, depth + 1):
        out = out.withColumn(f"_p{k}", F.last(F.when(F.col(level) == k, F.col(pos)), ignorenulls=True).over(w)).withColumn(f"_h{k}", F.last(F.when(F.col(level) == k, F.col(header)), ignorenulls=True).over(w))
    for k in range(1, depth + 1):
        above = [F.coalesce(F.col(f"_p{j}"), F.lit(-1)) for j in range(1, k)]
        valid = F.lit(True) if not above else F.col(f"_p{k}") > (F.greatest(*above) if len(above) > 1 else above[0])
        out = out.withColumn(f"h{k}", F.when(valid, F.col(f"_h{k}")))
    return out.drop(*(f"_{x}{k}" for x in "ph" for k in range(1, depth + 1)))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def best_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def latest_run(runs: DataFrame, key: str = "pmcid", started: str = "started_at", run: str = "run_id") -> DataFrame:
    """The latest run of each key; of those that started together the one with the largest id."""
    return runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), F.struct(started, run)).alias("r")).select("r.*")


def provenance_codes(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """The first failing check of each citation (ref, pmcid): form, document, place, element; else ok."""
    source = elements.select(F.col("pmcid").alias("_sp"), F.col("pos").alias("_spos"), F.col("te_id").alias("_ste"))
    parsed = refs.withColumn("_c", parse_citation("ref"))
    joined = parsed.join(source, (F.col("pmcid") == F.col("_sp")) & (F.col("_c.pos") == F.col("_spos")), "left")
    code = (
        F.when(F.col("_c").isNull(), "INVALID_SENTENCE_ID").when(F.col("_c.pmcid") != F.col("pmcid"), "CROSS_DOCUMENT_SOURCE_ERROR")
        .when(F.col("_ste").isNull(), "NONEXISTENT_SOURCE").when(F.col("_ste") != F.col("_c.te_id"), "INVALID_TEXT_ELEMENT_ID").otherwise("ok")
    )
    return joined.withColumn("code", code).drop("_c", "_sp", "_spos", "_ste")
