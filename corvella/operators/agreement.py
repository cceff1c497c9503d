"""Agreement of voters: vector similarity, alignment, decisions, cascades and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions import text as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def similarity_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Similarities of all left and right vectors (id, embedding) of the same key; keys hold a handful of each."""
    a = left.select(*keys, F.col("id").alias("a"), F.col("embedding").alias("_ea"))
    b = right.select(*keys, F.col("id").alias("b"), F.col("embedding").alias("_eb"))
    return a.join(b, keys).select(*keys, "a", "b", cosine(F.col("_ea"), F.col("_eb")).alias("similarity"))


def soft_alignment(pairs: DataFrame, keys: list[str], tau: float = 0.15, reuse_weight: float = 0.15, contradiction_weight: float = 0.20, a_claim: str | None = None, b_claim: str | None = None) -> DataFrame:
    """How far two sets of claims agree: coverage from both sides (similarities clipped to 0..1, zero below tau) times
    factors for unequal counts, for claims of one side that all choose the same partner, and for contradictions.

    The partner of a claim is the most similar one, the first of equals. Contradictions are the larger share, among a's claims
    with a partner at tau or above, of opposed polarities and of single numbers that differ twofold; they take the
    claims' texts (columns `a_claim`, `b_claim`). A key without pairs has no row: its score is 0.
    """
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity")))
    rows = pairs.withColumn("_s", F.when(s < tau, 0.0).otherwise(s))
    first = lambda x: F.struct(F.col("_s"), -F.col(x))

    def side(x: str, y: str) -> DataFrame:
        best = rows.groupBy(*keys, x).agg(F.max("_s").alias("_m"), F.max_by(y, first(y)).alias("_to"))
        chosen = best.groupBy(*keys, "_to").agg(F.count("*").alias("_k"), F.sum("_m").alias("_m"))
        return chosen.groupBy(*keys).agg((F.sum("_m") / F.sum("_k")).alias(f"cover_{x}"), F.sum("_k").alias(f"n_{x}"), F.max("_k").alias(f"most_{x}"))

    out = side("a", "b").join(side("b", "a"), keys)

    def reuse(x: str, y: str) -> Column:
        n, share = F.col(f"n_{y}"), F.col(f"most_{x}") / F.col(f"n_{x}")
        return F.when(n > 1, 1 - reuse_weight * F.greatest(F.lit(0.0), share - 1 / n) / (1 - 1 / n)).otherwise(1.0)

    count = F.pow(F.least("n_a", "n_b") / F.greatest("n_a", "n_b"), F.lit(0.25))
    out = out.withColumn("count_factor", count).withColumn("reuse_factor", (reuse("a", "b") + reuse("b", "a")) / 2).withColumn("contradiction", F.lit(0.0))
    if a_claim and b_claim:
        strong = rows.groupBy(*keys, "a").agg(*(F.max_by(c, first("b")).alias(n) for c, n in ((a_claim, "_ca"), (b_claim, "_cb"), ("_s", "_m")))).where(F.col("_m") >= tau)
        strong = strong.withColumn("_pa", T.polarity("_ca")).withColumn("_pb", T.polarity("_cb"))
        opposed, apart = F.count_if((F.col("_pa") * F.col("_pb")) == -1), F.count_if(T.numeric_contradiction("_ca", "_cb"))
        found = strong.groupBy(*keys).agg((F.greatest(opposed, apart) / F.count("*")).alias("_c"))
        out = out.drop("contradiction").join(found, keys, "left").withColumn("contradiction", F.coalesce("_c", F.lit(0.0))).drop("_c")
    score = (F.col("cover_a") + F.col("cover_b")) / 2 * F.col("count_factor") * F.col("reuse_factor") * (1 - contradiction_weight * F.col("contradiction"))
    return out.withColumn("score", F.round(score, 6))


def consensus(pairs: DataFrame, keys: list[str], quality: DataFrame | None = None) -> DataFrame:
    """For each key the voter with the highest mean similarity to the others, and that mean.

    `quality` (keys, v, n_findings, pass_share, evidence) leaves voters without findings out, unless all are, and breaks ties
    by the share of grounded findings, then the mean length of evidence, then the number of findings; then the smaller voter stays.
    """
    both = pairs.select(*keys, F.col("a").alias("v"), "similarity").union(pairs.select(*keys, F.col("b"), "similarity"))
    means = both.groupBy(*keys, "v").agg(F.round(F.avg("similarity"), 6).alias("_m"))
    deferral = F.max("_m").alias("deferral")
    if quality is None:
        return means.groupBy(*keys).agg(deferral, F.max_by("v", F.struct("_m", -F.col("v"))).alias("best_voter"))
    known = means.join(quality, [*keys, "v"], "left").fillna(0, ["n_findings", "pass_share", "evidence"])
    some = F.col("n_findings") > 0
    order = F.struct(some, F.col("_m"), F.when(some, F.col("pass_share")).otherwise(0.0), F.when(some, F.col("evidence")).otherwise(0.0), F.when(some, F.col("n_findings")).otherwise(0), -F.col("v"))
    return known.groupBy(*keys).agg(deferral, F.max_by("v", order).alias("best_voter"))


def best_output(voters: DataFrame, keys: list[str]) -> DataFrame:
    """The voter to fall back on: the longest mean evidence, then the most findings, then the first (keys, v, n_findings, evidence)."""
    return voters.groupBy(*keys).agg(F.max_by("v", F.struct("evidence", "n_findings", -F.col("v"))).alias("best_voter"))


def decide(theta: float | Column, reject: float | Column, keep_single: bool = True) -> Column:
    """keep, reject or escalate from the number of eligible voters, a polarity conflict and the agreement (0 counts as missing)."""
    agreement = F.coalesce(F.when(F.col("agreement") != 0, F.col("agreement")), F.lit(0.0))
    return (
        F.when(F.col("n_eligible") == 0, "escalate").when(F.col("n_eligible") == 1, "keep" if keep_single else "escalate").when(F.col("polarity_conflict"), "escalate")
        .when(agreement >= theta, "keep").when(agreement <= reject, "reject").otherwise("escalate")
    )


def route(n_eligible: Column, n_unusable: Column, n_schema: Column) -> Column:
    """Which gate decides a chunk: agreement, policy, escalation or rejection with its origin."""
    return F.when(n_eligible >= 2, "agreement").when(n_eligible == 1, "policy").when(n_unusable == 0, "escalate").when(n_schema == n_unusable, "reject_schema").otherwise("reject_grounding")


def sweep(decisions: DataFrame, thetas: list[float], rejects: list[float]) -> DataFrame:
    """Counts of decisions for a grid of thresholds (reject below theta), in one pass: each row meets the whole small grid."""
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("theta"), F.lit(r).alias("reject")) for t in thetas for r in rejects if r < t)))
    d = decisions.select("n_eligible", "polarity_conflict", "agreement", grid.alias("g")).select("*", "g.*")
    d = d.withColumn("decision", decide(F.col("theta"), F.col("reject")))
    return d.groupBy("theta", "reject").agg(*(F.count_if(F.col("decision") == x).alias(x) for x in ("keep", "reject_", "escalate") if x != "reject_"), F.count_if(F.col("decision") == "reject").alias("rejected"))


def cascade(decisions: DataFrame, theta: float, reject: float) -> DataFrame:
    """Replay levels 1 to 3 of each chunk: the level that decides, and how many levels were asked."""
    best = decisions.groupBy("pmcid", "chunk", "level").agg(F.max("agreement").alias("agreement"), F.max("n_eligible").alias("n_eligible"), F.bool_or("polarity_conflict").alias("polarity_conflict"))
    decided = best.withColumn("d", decide(theta, reject))
    wide = decided.groupBy("pmcid", "chunk").agg(*(F.max(F.when(F.col("level") == k, F.col("d"))).alias(f"d{k}") for k in (1, 2, 3)))
    final = F.when(F.coalesce("d1", F.lit("escalate")) != "escalate", 1).when(F.coalesce("d2", F.lit("escalate")) != "escalate", 2).otherwise(3)
    return wide.select("pmcid", "chunk", final.alias("level"), F.coalesce(F.when(final == 1, F.col("d1")).when(final == 2, F.col("d2")), F.lit("keep")).alias("decision"))


def threshold_metrics(rows: DataFrame, score: str, gold: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall, false accept rate and keep rate for each threshold."""
    t = rows.select(score, gold, F.explode(F.array(*map(F.lit, thresholds))).alias("theta"))
    keep, good = F.col(score) >= F.col("theta"), F.col(gold) == 1
    tp, kept, pos, neg = F.count_if(keep & good), F.count_if(keep), F.count_if(good), F.count_if(~good)
    r = lambda n, d: F.when(d > 0, F.round(n / d, 6)).otherwise(0.0)
    return t.groupBy("theta").agg(kept.alias("kept"), r(tp, kept).alias("precision"), r(tp, pos).alias("recall"), r(kept - tp, neg).alias("far"), r(kept, F.count("*")).alias("keep_rate"))


def select_theta(metrics: DataFrame, far: float, recall: float) -> DataFrame:
    """The largest threshold under both limits (tier 0), else the largest under that on false accepts (1), else the one with
    the fewest false accepts (2), else the largest of all (3). A rate that is null or NaN meets no limit."""
    known = F.col("far").isNotNull() & ~F.isnan("far")
    few = known & (F.col("far") <= far)
    often = F.col("recall").isNotNull() & ~F.isnan("recall") & (F.col("recall") >= recall)
    tier = F.when(few & often, 0).when(few, 1).when(known, 2).otherwise(3)
    return metrics.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") == 2, F.col("far")).otherwise(-F.col("theta")), "theta").limit(1)


def next_level_voters(voters: DataFrame) -> DataFrame:
    """Of voters alike in model and temperature the one at the lowest level runs; later ones reuse its result."""
    key = ["model", "temperature"]
    first = voters.groupBy(*key).agg(F.min("level").alias("_first"))
    return voters.join(first, key).withColumn("reused", F.col("level") > F.col("_first")).drop("_first")


#: Weights of categories, embeddings, entities and evidence in the blend that is shipped (fixed values).
BLEND = (0.15, 0.30, 0.50, 0.05)


def hybrid(sets: list[tuple[Column, Column]], embedding: Column, weights: tuple[float, ...] = BLEND, pass_shares: tuple[Column, Column] | None = None, floor: float = 0.3) -> Column:
    """A blend of four signals of two voters: the Jaccard similarity of their categories, entities and evidence (`sets`, in this
    order; two empty sets are alike) and the alignment of their claims, times the grounding factor if their shares are given."""
    (categories, entities, evidence), (w_category, w_embedding, w_entity, w_evidence) = (T.jaccard(a, b, 1.0) for a, b in sets), weights
    blend = w_category * categories + w_embedding * embedding + w_entity * entities + w_evidence * evidence
    return blend * grounding_factor(*pass_shares, floor=floor) if pass_shares else blend


def grounding_factor(a: Column, b: Column, floor: float = 0.3) -> Column:
    """From `floor` to 1 with the smaller share of grounded findings of two voters."""
    return floor + (1 - floor) * F.least(a, b)


def leave_one_out(outputs: DataFrame, keys: list[str], voter: str, value: str) -> DataFrame:
    """What is left of each group without each of its voters: (keys, without, voters, n, total); voters alone leave an empty rest."""
    own = outputs.groupBy(*keys, voter).agg(F.count("*").alias("_n"), F.sum(value).alias("_t"))
    whole = own.groupBy(*keys).agg(F.count("*").alias("_v"), F.sum("_n").alias("_an"), F.sum("_t").alias("_at"))
    return own.join(whole, keys).select(*keys, F.col(voter).alias("without"), (F.col("_v") - 1).alias("voters"), (F.col("_an") - F.col("_n")).alias("n"), (F.col("_at") - F.col("_t")).alias("total"))
