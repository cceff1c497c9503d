"""Findings to rules: normalise, group, canonicalise, relate and resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directions that have a polarity, and the two sides whose meeting is a contradiction.
POLARITY = ("positive", "negative", "absent", "partial")
UP, DOWN = ("positive", "partial"), ("negative", "absent")
FINDING_KEY = ["te_id", "subject", "outcome", "relation", "direction", "category"]


def sha8(x: str | Column) -> Column:
    return F.substring(F.sha2((F.col(x) if isinstance(x, str) else x).cast("string"), 256), 1, 8)


def normal_id(pmcid: str = "pmcid", te_ids: Column | None = None) -> Column:
    """NF_<paper>_<digest of subject|outcome|relation|elements>; a missing part is told as None."""
    part = lambda c: F.coalesce(F.col(c), F.lit("None"))
    elements = F.array_join(F.array_sort(te_ids).cast("array<string>"), "_") if te_ids is not None else F.col("te_id").cast("string")
    return F.concat(F.lit("NF_"), F.col(pmcid), F.lit("_"), sha8(F.concat_ws("|", part("subject"), part("outcome"), part("relation"), elements)))


def group_id() -> Column:
    return F.concat(F.lit("GRP_"), F.concat_ws("_", sha8("pmcid"), sha8("subject"), sha8("outcome"), "relation", sha8("category")))


def canonical_id(group: Column) -> Column:
    return F.concat(F.lit("CR_"), sha8(group), F.lit("_"), F.col("direction"))


def relation_id(a: str, b: str) -> Column:
    """The same for either order of the two rules."""
    return F.concat(F.lit("COR_"), sha8(F.concat_ws("|", F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string"))))))


def first_best(value: Column, score: Column, position: Column) -> Column:
    """The value of the row with the highest score (null lowest), the earliest of equals."""
    return F.max_by(value, F.struct(F.coalesce(score, F.lit(-1.0)), -position))


def exact_mean(score: str) -> Column:
    """The mean rounded half up to six digits, the same in whatever order rows come.

    Sums of doubles end a last digit higher or lower by that order, which decides how a mean halfway between two results
    is rounded. Scores of up to six decimals below 1,000 are added as whole millionths; a group with any other has the plain mean.
    """
    millionths = F.rint(F.col(score) * 1e6).try_cast("long")
    exact = F.when((F.abs(score) < 1000) & (millionths / F.lit(1e6) == F.col(score)), millionths)
    n = F.count(exact)
    mean = F.sum(exact).cast("decimal(20,0)") / F.nullif(n, F.lit(0))
    return F.when(n == F.count(score), F.round(mean, 0).cast("double") / 1e6).otherwise(F.round(F.avg(score), 6))


def normalize(findings: DataFrame) -> DataFrame:
    """One row for each finding key: members, distinct papers, mean score and the best member. A key with a null part never merges."""
    own = F.when(F.expr(" OR ".join(f"{k} IS NULL" for k in FINDING_KEY)), F.col("fid"))
    return findings.groupBy(*FINDING_KEY, own.alias("alone")).agg(
        F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_set("pmcid")), ",").alias("pmcids"), F.round(F.avg("score"), 6).alias("mean_score"),
        first_best(F.col("fid"), F.col("score"), F.col("fid")).alias("best_fid"),
    )


def pass_through(findings: DataFrame) -> DataFrame:
    """Findings that can't be grouped, each as a result of its own."""
    return findings.where(~groupable()).select("fid", "pmcid", normal_id().alias("normal_id"), F.lit(1).cast("long").alias("n_members"), F.round("score", 6).alias("mean_score"), non_groupable_reason().alias("reason"))


def groupable() -> Column:
    return F.col("subject").isNotNull() & F.col("outcome").isNotNull() & (F.coalesce("relation", F.lit("unclear")) != "unclear")


def non_groupable_reason() -> Column:
    """Why a finding can't be grouped, in a fixed order."""
    return F.concat_ws(", ", F.when(F.col("subject").isNull(), "subject_entity=None"), F.when(F.col("outcome").isNull(), "outcome_entity=None"), F.when(F.coalesce("relation", F.lit("unclear")) == "unclear", "relation_type=unclear"))


def group(findings: DataFrame) -> DataFrame:
    """Groups by paper, entities, relation and category, with counts of directions."""
    return findings.where(groupable()).groupBy("pmcid", "subject", "outcome", "relation", "category").agg(
        F.count("*").alias("n_findings"), *(F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in ("positive", "negative", "unclear")),
    ).withColumn("group_id", group_id())


def heterogeneity(findings: DataFrame, scope: list[str]) -> DataFrame:
    """The share of scope fields with more than one value in a group; 0 for a single member."""
    varied = sum((F.count_distinct(f) > 1).cast("int") for f in scope)
    return findings.where(groupable()).groupBy("pmcid", "subject", "outcome", "relation", "category").agg(F.when(F.count("*") > 1, F.round(varied / len(scope), 4)).otherwise(0.0).alias("heterogeneity"))


def canonicalize(findings: DataFrame) -> DataFrame:
    """Groups split by direction. A group whose members have two directions with polarity or more is conflicted."""
    rules = findings.where(groupable()).groupBy("pmcid", "subject", "outcome", "relation", "category", "direction").agg(
        F.count("*").alias("n_findings"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_distinct("te_id").alias("n_te"),
        first_best(F.col("fid"), F.col("score"), F.col("fid")).alias("best_fid"),
    )
    whole = Window.partitionBy("pmcid", "subject", "outcome", "relation", "category")
    conflicted = F.sum(F.col("direction").isin(*POLARITY).cast("int")).over(whole) >= 2
    return rules.withColumn("is_conflicted", conflicted).withColumn("canonical_id", canonical_id(group_id()))


def study_coverage(findings: DataFrame) -> DataFrame:
    """Whether a rule rests on one study, several, or none known."""
    n = F.count_distinct("pmcid")
    return findings.where(groupable()).groupBy("subject", "outcome", "relation", "category", "direction").agg(F.when(n > 1, "multi").when(n == 1, "single").otherwise("unknown").alias("coverage"), n.alias("n_papers"))


def corpus_rules(findings: DataFrame, exact: bool = False) -> DataFrame:
    """Rules over all papers: what RELATE compares. With exact, mean scores do not depend on the order of rows."""
    mean = exact_mean("score") if exact else F.round(F.avg("score"), 6)
    return findings.where(groupable()).groupBy("subject", "outcome", "relation", "category", "direction").agg(
        F.count("*").alias("n_findings"), F.count_distinct("pmcid").alias("n_papers"), mean.alias("mean_score"), F.min("fid").alias("rule_id"),
    )


def comparable_pairs(rules: DataFrame) -> DataFrame:
    """Pairs of rules (a before b) that may be related: alike in category, relation, subject and outcome, both with polarity.

    An equi-join on the comparison key; rules that fit no partner are never paired.
    """
    side = lambda x: rules.where(F.col("direction").isin(*POLARITY)).select("subject", "outcome", "relation", "category", *(F.col(c).alias(f"{c}_{x}") for c in ("rule_id", "direction", "mean_score", "n_findings")))
    return side("a").join(side("b"), ["subject", "outcome", "relation", "category"]).where("rule_id_a < rule_id_b")


def skip_reason(a: str = "a", b: str = "b") -> Column:
    """The first reason why two rules can't be compared, null if they can."""
    x, y = (lambda c: F.col(f"{c}_{a}")), (lambda c: F.col(f"{c}_{b}"))
    return (
        F.when(~x("direction").isin(*POLARITY) | ~y("direction").isin(*POLARITY), "non_polarity_direction").when(~x("category").eqNullSafe(y("category")), "category_mismatch")
        .when(~x("relation").eqNullSafe(y("relation")), "relation_type_mismatch").when(~x("subject").eqNullSafe(y("subject")), "subject_mismatch")
        .when(~x("outcome").eqNullSafe(y("outcome")), "outcome_incompatible")
    )


def classify(entail: float = 0.5, contradict: float = 0.5) -> Column:
    """SUPPORT, CONTRADICT or UNRELATED from scores in both directions; only opposite polarities can contradict."""
    opposite = (F.col("direction_a").isin(*UP) & F.col("direction_b").isin(*DOWN)) | (F.col("direction_a").isin(*DOWN) & F.col("direction_b").isin(*UP))
    return F.when(opposite & (F.col("con_ab") >= contradict) & (F.col("con_ba") >= contradict), "CONTRADICT").when((F.col("ent_ab") >= entail) & (F.col("ent_ba") >= entail), "SUPPORT").otherwise("UNRELATED")


def with_pair_scores(pairs: DataFrame) -> DataFrame:
    """A stand-in for an entailment model: scores from how close the rules' own scores are. No claim of equivalence."""
    a, b = F.coalesce("mean_score_a", F.lit(0.5)), F.coalesce("mean_score_b", F.lit(0.5))
    same = (F.col("direction_a") == F.col("direction_b")).cast("int")
    close = 1 - F.abs(a - b)
    return pairs.withColumns({"ent_ab": F.round(same * close, 6), "ent_ba": F.round(same * close * 0.9, 6), "con_ab": F.round((1 - same) * close, 6), "con_ba": F.round((1 - same) * close * 0.95, 6)})


def relations(findings: DataFrame) -> DataFrame:
    """Related pairs of corpus rules."""
    pairs = with_pair_scores(comparable_pairs(corpus_rules(findings)))
    return pairs.withColumn("label", classify(0.8, 0.8)).where("label <> 'UNRELATED'").select("rule_id_a", "rule_id_b", "label", "ent_ab", "con_ab")


def adjacency(edges: DataFrame) -> DataFrame:
    """Each relation from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("rule_id_a").alias("rule_id"), F.col("rule_id_b").alias("other")), F.struct(F.col("rule_id_b").alias("rule_id"), F.col("rule_id_a").alias("other"))))
    return edges.select("label", ends.alias("e")).select("e.rule_id", "e.other", "label")


def resolve(rules: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Final scores. Grounding, coverage and relations are weighed; without any relation at all the weights differ."""
    if edges is None:
        counted = rules.withColumns({"supports": F.lit(0).cast("long"), "contradicts": F.lit(0).cast("long"), "any_relation": F.lit(False)})
    else:
        degree = adjacency(edges).groupBy("rule_id").agg(F.count_if(F.col("label") == "SUPPORT").alias("supports"), F.count_if(F.col("label") == "CONTRADICT").alias("contradicts"))
        any_relation = edges.agg((F.count("*") > 0).alias("any_relation"))
        counted = rules.join(degree, "rule_id", "left").crossJoin(F.broadcast(any_relation)).fillna(0, ["supports", "contradicts"])  # one row
    g, breadth = F.coalesce("mean_score", F.lit(0.5)), F.least(F.col("n_findings") / 5.0, F.lit(1.0))
    single = (F.col("n_papers") == 1).cast("double")
    related = 0.60 * g + 0.10 * breadth + F.least(0.08 * F.col("supports"), F.lit(0.20)) - 0.10 * single - F.least(0.15 * F.col("contradicts"), F.lit(0.30))
    plain = 0.80 * g + 0.15 * breadth - 0.05 * single
    score = F.when(F.col("any_relation"), related).otherwise(plain)
    return counted.select("rule_id", "n_findings", "n_papers", "supports", "contradicts", (F.col("contradicts") > 0).alias("is_contradicted"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + 1e-9)), 4).alias("final_score"))


def contradicted_by(edges: DataFrame) -> DataFrame:
    return adjacency(edges).where("label = 'CONTRADICT'").groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("contradicted_by"))


def rejection_summary(findings: DataFrame, threshold: float) -> DataFrame:
    """How many findings grounding and grouping reject, by category; rates are 0 where nothing came in."""
    low = F.coalesce(F.col("score") < threshold, F.lit(False))
    kept_out = F.count_if(low)
    loose = F.count_if(~low & ~groupable())
    rate = lambda n, d: F.when(d > 0, F.round(n / d, 4)).otherwise(0.0)
    return findings.groupBy("category").agg(F.count("*").alias("n_total"), kept_out.alias("n_ungrounded"), loose.alias("n_non_groupable"), rate(kept_out, F.count("*")).alias("grounding_rejection_rate"), rate(loose, F.count("*") - kept_out).alias("non_groupable_rate"))


def incremental_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Comparable pairs with exactly one new side, and those among the new: what adding papers costs."""
    both = comparable_pairs(old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True))))
    ids = new.select(F.col("rule_id"))
    a = both.join(ids.withColumnRenamed("rule_id", "rule_id_a").withColumn("new_a", F.lit(True)), "rule_id_a", "left")
    b = a.join(ids.withColumnRenamed("rule_id", "rule_id_b").withColumn("new_b", F.lit(True)), "rule_id_b", "left")
    return b.where("coalesce(new_a, false) OR coalesce(new_b, false)").select("rule_id_a", "rule_id_b", (F.coalesce("new_a", F.lit(False)) & F.coalesce("new_b", F.lit(False))).alias("intra"))


def polarity_conflicts(findings: DataFrame) -> DataFrame:
    """Keys on which two voters disagree in direction outright, with how many such pairs of voters there are.

    Counting voters by direction gives the number of pairs without forming them.
    """
    key = ["pmcid", "subject", "outcome", "category"]
    votes = findings.where(groupable()).groupBy(*key, "voter").agg(F.bool_or(F.col("direction") == "positive").alias("up"), F.bool_or(F.col("direction") == "negative").alias("down"))
    sides = votes.groupBy(*key).agg(F.count_if("up").alias("ups"), F.count_if("down").alias("downs"), F.count_if(F.col("up") & F.col("down")).alias("both"))
    pairs = F.col("ups") * F.col("downs") - F.col("both") - (F.col("both") * (F.col("both") - 1) / 2).cast("long")
    return sides.withColumn("n_pairs", pairs).where("n_pairs > 0").select(*key, "n_pairs")
