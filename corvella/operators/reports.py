"""Reports on runs, crops and judgements: label classes, rubrics, score distributions, judge summaries, proxy metrics, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(n: Column, d: Column, digits: int = 4) -> Column:
    """n / d, rounded; null where there is nothing to divide by."""
    return F.round(F.when(d > 0, n / d), digits)


def label_class(label: str | Column, kind: str | Column) -> Column:
    """tp, fp or skip from what an annotator wrote about a crop of a figure or a table."""
    x = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    kind = F.col(kind) if isinstance(kind, str) else kind
    figure = F.when(F.startswith(x, F.lit("correct")), "tp").when(x.isin("icon", "incorrect"), "fp").otherwise("skip")
    bad = (x == "incorrect") | F.startswith(x, F.lit("wrong caption")) | F.startswith(x, F.lit("crop is too big")) | F.startswith(x, F.lit("weird"))
    table = F.when((x == "correct") | F.startswith(x, F.lit("missing footnotes")), "tp").when(bad, "fp").otherwise("skip")
    return F.coalesce(F.when(kind == "figure", figure).otherwise(table), F.lit("skip"))


def label_metrics(labelled: DataFrame, actual: DataFrame, keys: list[str], label: str = "label", kind: str = "kind") -> DataFrame:
    """Precision, recall and F1 of labelled crops. `actual` has for each key `missed` (known false negatives), or null and
    `total` (then what is not found is missed). A rate without a denominator is null, and so is F1 if either is null or 0."""
    c = label_class(label, kind)
    n = labelled.groupBy(*keys).agg(*(F.count_if(c == x).alias(x) for x in ("tp", "fp", "skip"))).join(actual, keys, "left")
    fn = F.coalesce(F.col("missed"), F.greatest(F.col("total") - F.col("tp"), F.lit(0)), F.lit(0)).cast("long")
    p, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    out = n.withColumn("fn", fn).withColumn("_p", p).withColumn("_r", r)
    f1 = F.when((F.col("_p") > 0) & (F.col("_r") > 0), 2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return out.select(*keys, "tp", "fp", "fn", "skip", F.round("_p", 6).alias("precision"), F.round("_r", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def rubric_scores(crops: DataFrame, rubric: DataFrame, dims: list[str], keys: list[str], dim_pass: float = 0.5, strict_pass: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(by dimension, strict) counts of crops (keys, label, figure) under a rubric (label, and for each dimension a score, n/a or skip).

    A dimension passes from `dim_pass` on; n/a leaves a crop out of the dimension, skip and what is no number too, and these keep
    it from passing strictly as well, for which all scored dimensions must reach `strict_pass`. A crop no dimension of which is
    scored, or whose label the rubric doesn't know, is skipped. Figures have no footnotes. Crops without a label are not counted.
    """
    known = rubric.select(F.lower(F.trim("label")).alias("_l"), F.struct(*dims).alias("_r"))
    c = crops.where("label IS NOT NULL").join(F.broadcast(known), F.lower(F.trim("label")) == F.col("_l"), "left")  # a rubric is a page long
    value = lambda d: F.lower(F.when((F.lit(d) == "footnote") & F.col("figure"), "n/a").otherwise(F.coalesce(F.col(f"_r.{d}"), F.lit("n/a"))))
    state = lambda d: F.when(F.col("_r").isNull(), "skip").when(value(d) == "n/a", "na").when(value(d).try_cast("double").isNull(), "skip").when(value(d).try_cast("double") >= dim_pass, "tp").otherwise("fp")
    full = lambda d: F.when(F.col("_r").isNull(), False).when(value(d) == "n/a", True).otherwise(F.coalesce(value(d).try_cast("double") >= strict_pass, F.lit(False)))
    states = c.select(*keys, F.array(*(F.struct(F.lit(d).alias("dim"), state(d).alias("s")) for d in dims)).alias("_s"), F.array(*(full(d) for d in dims)).alias("_f"))
    count = lambda x: F.count_if(F.col("s") == x)
    by = states.select(*keys, F.explode("_s").alias("e")).select(*keys, "e.*").groupBy(*keys, "dim").agg(*(count(x).alias(n) for x, n in (("tp", "tp"), ("fp", "fp"), ("na", "na"), ("skip", "skipped"))))
    by = by.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"), 6))
    scored, whole = F.exists("_s", lambda e: e["s"].isin("tp", "fp")), F.forall("_f", lambda x: x)
    strict = states.groupBy(*keys).agg(F.count_if(scored & whole).alias("tp"), F.count_if(scored & ~whole).alias("fp"), F.count_if(~scored).alias("skipped"))
    return by, strict.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"), 6))


def distribution(rows: DataFrame, score: str, keys: list[str], low: float, high: float, bins: int = 10) -> DataFrame:
    """Scores by key: least, median, largest, how many lie in (low, high], and a histogram of equal bins of 0 to 1 (the last takes 1 and above)."""
    at = F.least((F.col(score) * bins).cast("int"), F.lit(bins - 1))
    counts = F.array(*(F.count_if(at == i) for i in range(bins)))
    band = F.count_if((F.col(score) > low) & (F.col(score) <= high))
    return rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(score).alias("least"), F.median(score).alias("median"), F.max(score).alias("largest"), band.alias("in_band"), counts.alias("histogram"))


def calibration(rows: DataFrame, score: str, label: Column, keys: list[str]) -> DataFrame:
    """How often the label holds, by tenths of the score; rows without a score are left out."""
    bucket = F.format_string("%.1f", (F.col(score) * 10).cast("int") / 10)
    return rows.where(F.col(score).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.count_if(label) / F.count("*"), 3).alias("positive_rate"))


def field_accuracy(field: str) -> Column:
    """The share of rows in which a judge did not change the field."""
    return _share(F.count_if(~F.coalesce(F.array_contains("fields_changed", field), F.lit(False))), F.count("*"))


def judged_findings(rows: DataFrame, *keys: str) -> DataFrame:
    """Q1: how many findings are grounded, how often fields are right, entities or the scope wrong (is_grounded, fields_changed)."""
    n = F.count("*")
    entity = F.arrays_overlap("fields_changed", F.array(F.lit("subject_entity"), F.lit("outcome_entity")))
    scope = F.exists("fields_changed", lambda f: F.startswith(f, F.lit("scope_")))
    return rows.groupBy(*keys).agg(
        n.alias("total"), F.count_if("is_grounded").alias("grounded"), _share(F.count_if("is_grounded"), n).alias("grounded_rate"),
        *(field_accuracy(f).alias(f"{f}_accuracy") for f in ("relation_type", "direction", "category")), _share(F.count_if(entity), n).alias("entity_error_rate"), _share(F.count_if(scope), n).alias("scope_error_rate"),
    )


def judged_relations(rows: DataFrame) -> DataFrame:
    """Q2: the confusion of the pipeline's labels with the right ones, each row with its share of all and the overall accuracy."""
    total = rows.agg(F.count("*").alias("_n"), _share(F.count_if("is_correct"), F.count("*")).alias("accuracy"))
    pair = rows.groupBy(F.coalesce("pipeline_label", F.lit("?")).alias("pipeline_label"), F.coalesce("correct_label", F.lit("?")).alias("correct_label")).agg(F.count("*").alias("n"))
    return pair.join(F.broadcast(total), F.lit(True)).select("pipeline_label", "correct_label", "n", _share(F.col("n"), F.col("_n")).alias("share"), "accuracy")  # one row of totals


def judged_paragraphs(rows: DataFrame) -> DataFrame:
    """Q3: paragraphs with gaps and findings that are missing, by stratum and over all (stratum null)."""
    g = rows.withColumn("stratum", F.coalesce("stratum", F.lit("unknown"))).groupingSets([[F.col("stratum")], []], "stratum")
    return g.agg(F.count("*").alias("n"), F.count_if("has_gaps").alias("with_gaps"), _share(F.count_if("has_gaps"), F.count("*")).alias("gap_rate"), F.sum("n_missing").alias("missing"), F.round(F.sum("n_missing") / F.count("*"), 2).alias("missing_per_paragraph"))


def judged_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Q5: micro precision, recall and F1 over paragraphs' tp, fp and fn; 0 where there is nothing to divide by."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("paragraphs"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn", "partial")))
    p, r = (F.when(d > 0, F.col("tp") / d).otherwise(0.0) for d in (F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.select("*", F.round(p, 4).alias("micro_precision"), F.round(r, 4).alias("micro_recall"), F.round(f1, 4).alias("micro_f1"))


def proxy_metrics(papers: DataFrame, findings: DataFrame, rules: DataFrame, relations: DataFrame, decisions: DataFrame, usage: DataFrame) -> DataFrame:
    """One row a paper (pmcid, run_id, status, config, wall_s): what each stage made, how far it is grounded, what it took.

    Parts that a paper lacks are null and their *_source says missing. Each part is summed by paper before it is joined.
    """
    f = findings.groupBy("pmcid").agg(
        F.count("*").alias("raw_finding_count"), F.count_if(F.col("grounded")).alias("grounded_finding_count"), F.avg("score").alias("mean_grounding_score"),
        F.count_if(F.col("groupable")).alias("normal_finding_count"), F.count_if(~F.col("groupable")).alias("non_groupable_total"),
    )
    r = rules.groupBy("pmcid").agg(
        F.count("*").alias("canonical_rule_count"), F.count_if(F.col("final_score").isNotNull()).alias("final_rule_count"),
        F.round(F.count_if(F.lower("direction").isin("unclear", "no_direction")) / F.count("*"), 6).alias("unclear_no_direction_rate"),
        F.count_if(F.col("final_score") >= 0.5).alias("final_rules_ge_0_5"), F.least(F.count_if(F.col("final_score").isNotNull()), F.lit(10)).alias("final_rules_top10"),
    )
    e = relations.groupBy("pmcid").agg(F.count("*").alias("relations_total"), *(F.count_if(F.upper("relation_type") == t).alias(n) for t, n in (("SUPPORT", "support_edge_count"), ("CONTRADICT", "contradiction_edge_count"), ("SCOPE_QUALIFY", "scope_qualify_edge_count"))))
    d = decisions.groupBy("pmcid").agg(*(F.count_if(F.col("level") == k).alias(f"l{k}_chunks") for k in (1, 2, 3)), F.count_if("polarity_conflict").alias("polarity_conflict_chunks"))
    u = usage.groupBy("pmcid").agg(F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.round(F.sum("cost"), 6).alias("estimated_total_cost_usd"))
    out = papers.withColumn("is_success_like", F.col("status").isin("F", "O").cast("int"))
    for part, source, probe in ((f, "finding_source", "raw_finding_count"), (r, "rule_source", "canonical_rule_count"), (e, "relation_source", "relations_total"), (d, "decision_source", "l1_chunks"), (u, "token_count_source", "total_input_tokens")):
        out = out.join(part, "pmcid", "left").withColumn(source, F.when(F.col(probe).isNull(), "missing").otherwise("table"))
    rejected = F.col("raw_finding_count") - F.col("grounded_finding_count")
    return out.withColumn("grounding_rejection_rate", F.round(rejected / F.col("raw_finding_count"), 6)).withColumn("mean_grounding_score", F.round("mean_grounding_score", 6))


def proxy_totals(rows: DataFrame, sums: list[str], rates: list[str], hash_col: str = "config") -> DataFrame:
    """The row over all papers: sums, mean, median and 90th percentile (linear) of rates over papers that have them, the configuration or MIXED."""
    parts = [F.sum(c).alias(c) for c in sums]
    for c in rates:
        parts += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.percentile(c, 0.5), 6).alias(f"{c}_median"), F.round(F.percentile(c, 0.9), 6).alias(f"{c}_p90"), F.count(c).alias(f"{c}_n")]
    config = F.when(F.count_distinct(hash_col) > 1, "MIXED").otherwise(F.min(hash_col)).alias(hash_col)
    return rows.agg(F.count("*").alias("n_papers"), F.sum("is_success_like").alias("n_success_like"), config, *parts)


def manifest_totals(stats: DataFrame) -> DataFrame:
    """Sums over documents (pmcid, status, wall_seconds, counts, reasons: maps): (section, key, value) with statuses, wall time, counts and reasons."""
    one = stats.agg(F.count("*").alias("n_with_stats"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.round(F.sum("wall_seconds"), 4).alias("total_wall_seconds"), F.round(F.avg("wall_seconds"), 4).alias("mean_wall_seconds"))
    summary = one.select(F.explode(F.array(*(F.struct(F.lit("summary").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("s")).select("s.*")
    each = lambda c: stats.select(F.lit(c).alias("section"), F.explode(c).alias("key", "v")).groupBy("section", "key").agg(F.sum("v").cast("double").alias("value"))
    return summary.union(each("counts")).union(each("reasons"))


def propagate_labels(labels: DataFrame, crops: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Labels (file, variant, label) copied to all other variants that have a crop of the same file with the same box, quantised: (file, variant, label, source)."""
    q = [F.round(F.coalesce(c, F.lit(0.0)) / tolerance) * tolerance for c in ("x1", "y1", "x2", "y2")]
    box = crops.select("file", "variant", F.struct(*(c.alias(n) for c, n in zip(q, ("x1", "y1", "x2", "y2"), strict=True))).alias("box"))
    own = labels.join(box, ["file", "variant"]).select("file", "box", F.col("variant").alias("source"), "label")
    return own.join(box, ["file", "box"]).where("variant <> source").select("file", "variant", "label", "source")
