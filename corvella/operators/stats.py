"""Statistics: percentiles by their several definitions, funnels, metrics, bootstraps, frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_percentile(rows: DataFrame, keys: list[str], value: str, index: Column, tie: str) -> DataFrame:
    """The value at a zero-based place of the sorted values of each key; `index` is an expression over the column n."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return numbered.where(F.col("_i") == index).select(*keys, value)


def nearest_rank(p: float) -> Column:
    """round(p * (n - 1)), half away from zero."""
    return F.round(p * (F.col("n") - 1)).cast("int")


def lower_rank(p: float) -> Column:
    return F.floor(p * (F.col("n") - 1)).cast("int")


def clipped_rank(p: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(p * F.col("n"))).cast("int")


def rate(n: Column, d: Column, digits: int = 6) -> Column:
    """n / d rounded, 0 where d is 0."""
    return F.when(d > 0, F.round(n / d, digits)).otherwise(0.0)


def f_scores(tp: Column, strict: Column, n_pipeline: Column, n_silver: Column) -> dict[str, Column]:
    """Precision, recall, F1 and strict F1 (credits of strict matches in place of counts)."""
    return {"precision": rate(tp, n_pipeline), "recall": rate(tp, n_silver), "f1": rate(2 * tp, n_pipeline + n_silver), "strict_f1": rate(2 * strict, n_pipeline + n_silver)}


def pareto(rows: DataFrame, cost: str, quality: str) -> DataFrame:
    """Rows that no other beats in cost or quality without losing in the other.

    Rows in order of cost are on the frontier if their quality is above the best of all cheaper ones. Costs are first
    reduced to their best quality; the running maximum goes by ranges of cost, so no task sees all rows.
    """
    best = rows.groupBy(cost).agg(F.max(quality).alias("_q"))
    ranged = best.withColumn("_b", F.floor(F.log2(F.col(cost) + 1) * 4).cast("int"))
    tops = ranged.groupBy("_b").agg(F.max("_q").alias("_t"))
    before = tops.select("_b", F.max("_t").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each range
    w = Window.partitionBy("_b").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_own", F.max("_q").over(w)).join(before, "_b")
    front = inside.where(F.col("_q") > F.coalesce(F.greatest("_own", "_before"), F.lit(float("-inf")))).select(F.col(cost).alias("_c"), "_q")
    return rows.join(front, (F.col(cost) == F.col("_c")) & (F.col(quality) == F.col("_q"))).drop("_c", "_q")


def bootstrap(cases: DataFrame, key: str, values: list[str], n_iter: int, n_cases: int, seed: int) -> DataFrame:
    """Sums of `values` over each of n_iter resamples of the cases (numbered 0 to n_cases - 1 in `slot`), drawn with replacement by a keyed hash."""
    draws = cases.sparkSession.range(n_iter * n_cases).select((F.col("id") / n_cases).cast("long").alias("iter"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_cases)).alias("slot"))
    return draws.groupBy("iter", "slot").agg(F.count("*").alias("_k")).join(cases, "slot").groupBy("iter").agg(*(F.sum(F.col(v) * F.col("_k")).alias(v) for v in values))


def paired_bootstrap(papers: DataFrame, n_iter: int = 10_000, seed: int = 42) -> DataFrame:
    """How far a system beats a baseline in micro F1 when whole papers are drawn with replacement: one row with both scores,
    the difference, its bounds at min(n - 1, int(q * n)) for q = 0.025 and 0.975, how often it is above 0, and whether the bounds exclude 0.

    `papers` has one row a paper: tp and n of both systems (a_tp, a_n, b_tp, b_n) and the number of gold findings (gold).
    """
    values = ["a_tp", "a_n", "b_tp", "b_n", "gold"]
    n = papers.count()
    slots = papers.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("paper")) - 1).cast("long").alias("slot"), *values)  # a row a paper
    f1 = lambda x: F.when(F.col(f"{x}_n") + F.col("gold") > 0, 2 * F.col(f"{x}_tp") / (F.col(f"{x}_n") + F.col("gold"))).otherwise(0.0)
    deltas = bootstrap(slots, "slot", values, n_iter, n, seed).select(F.lit(1).alias("one"), "iter", (f1("a") - f1("b")).alias("delta"))
    at = lambda q, name: nth_percentile(deltas, ["one"], "delta", clipped_rank(q), "iter").select("one", F.round("delta", 4).alias(name))
    better = deltas.groupBy("one").agg(F.round(F.count_if(F.col("delta") > 0) / F.count("*"), 4).alias("p_better"))
    full = papers.agg(*(F.sum(v).alias(v) for v in values)).select(F.lit(1).alias("one"), F.round(f1("a"), 4).alias("f1"), F.round(f1("b"), 4).alias("baseline_f1"), F.round(f1("a") - f1("b"), 4).alias("delta"))
    out = full.join(at(0.025, "ci_low"), "one").join(at(0.975, "ci_high"), "one").join(better, "one").drop("one")
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """n rows of each stratum in the order of a keyed hash; the same for any partitioning."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    if not strata:
        return rows.orderBy(h, key).limit(n)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).where(F.col("_rn") <= n).drop("_rn")


#: Buckets of a grounding score: where they begin, their share of a sample, and where a lack is made up (fixed values).
BUCKETS = {"very_low": (0.0, 10), "low": (0.30, 15), "near_threshold_low": (0.45, 25), "near_threshold_high": (0.50, 25), "medium": (0.55, 15), "high": (0.75, 10)}
SPILL = {
    "very_low": ["low", "near_threshold_low", "near_threshold_high", "medium", "high"], "low": ["very_low", "near_threshold_low", "near_threshold_high", "medium", "high"],
    "near_threshold_low": ["low", "very_low", "near_threshold_high", "medium", "high"], "near_threshold_high": ["medium", "high", "near_threshold_low", "low", "very_low"],
    "medium": ["near_threshold_high", "high", "near_threshold_low", "low", "very_low"], "high": ["medium", "near_threshold_high", "near_threshold_low", "low", "very_low"],
}
_REMAINDER = ["near_threshold_low", "near_threshold_high", "low", "medium", "very_low", "high"]


def bucket_of(score: Column) -> Column:
    """The bucket of a score; null is missing, and scores outside 0 to 1 go to the ends."""
    out = F.lit("very_low")
    for name, (low, _) in BUCKETS.items():
        out = F.when(score >= low, name).otherwise(out)
    return F.when(score.isNull(), "missing").otherwise(out)


def targets(n: int) -> dict[str, int]:
    """How many of n each bucket gets: its share rounded down, what is left over to the buckets next to the threshold first."""
    out = {b: max(n, 0) * w // 100 for b, (_, w) in BUCKETS.items()}
    for k in range(max(n, 0) - sum(out.values())):
        out[_REMAINDER[k % len(_REMAINDER)]] += 1
    return out


def drawn(available: dict[str, int], n: int) -> dict[str, int]:
    """How many each bucket gives: its target, then what its neighbours lack, bucket by bucket, as long as it has any."""
    want = targets(n)
    take = {b: min(k, available.get(b, 0)) for b, k in want.items()}
    for b in BUCKETS:
        lack = want[b] - min(want[b], available.get(b, 0))
        for other in SPILL[b]:
            more = min(lack, available.get(other, 0) - take[other])
            take[other] += more
            lack -= more
    return take


def stratified_sample(rows: DataFrame, key: str, score: str, n: int, seed: int) -> DataFrame:
    """n rows (fewer if there are fewer with a score) spread over the buckets of their scores, drawn by a keyed hash of `key`."""
    bucketed = rows.withColumn("bucket", bucket_of(F.col(score)))
    available = {r["bucket"]: r["count"] for r in bucketed.groupBy("bucket").count().collect()}  # seven rows
    take = drawn(available, n)
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    out = []
    for b in BUCKETS:  # the least hashes of each bucket: a top-k, not a sort of it
        if take[b]:
            out.append(bucketed.where(F.col("bucket") == b).orderBy(h, key).limit(take[b]))
    return reduce(DataFrame.union, out) if out else bucketed.limit(0)


def finalists(cells: DataFrame, structure: list[str], quality: str, cost: str, top_k: int = 3, within: float = 0.01, pareto_cap: int = 6, least_quality: float = 0.5, cost_weight: float = 0.1) -> DataFrame:
    """Structures of a sweep that stay, each with its reasons (top-k, within-best, pareto, economy, knee, diversity:<axis>) and its best quality.

    The first two go by the best cell of a structure. The frontier (quality up, cost down) is that of all cells; a structure
    on it stays with its cheapest cell there, at most `pareto_cap` of them, those without other reasons first. economy is the cheapest cell
    of enough quality, knee the cell with the best quality less weighted cost. If all that stay agree on an axis, the best
    one near the top that differs there stays too. Ties: lower cost, then the structure's name.
    """
    s = F.struct(*structure)
    keyed = cells.withColumn("_s", s)
    best = keyed.groupBy("_s").agg(F.max(F.struct(F.col(quality).alias("q"), (-F.col(cost)).alias("c"))).alias("b")).select("_s", "b.q", "b.c").orderBy(F.desc("q"), F.desc("c"), "_s").collect()  # a row a structure
    if not best:
        return cells.sparkSession.createDataFrame([], cells.select(*structure, F.col(quality).alias("best_quality"), F.array(F.lit("")).alias("reasons")).schema)
    top, reasons = best[0]["q"], {}
    ranked = [(tuple(r["_s"]), r["q"]) for r in best]

    def add(x: tuple, why: str) -> None:
        if why not in reasons.setdefault(x, []):
            reasons[x].append(why)

    for x, _ in ranked[:top_k]:
        add(x, "top-k")
    for x, q in ranked:
        if top - q <= within:
            add(x, "within-best")
    front = pareto(cells.select(F.col(cost).cast("double").alias("_cost"), F.col(quality).alias("_quality")).distinct(), "_cost", "_quality")
    on = keyed.join(F.broadcast(front), (F.col(cost) == F.col("_cost")) & (F.col(quality) == F.col("_quality"))).groupBy("_s").agg(F.min(cost).alias("c")).orderBy("c", "_s").collect()
    by_cost = [tuple(r["_s"]) for r in on]
    for x in ([x for x in by_cost if x not in reasons] + [x for x in by_cost if x in reasons])[:pareto_cap]:
        add(x, "pareto")
    cheap = keyed.where(F.col(quality) >= least_quality).orderBy(cost, "_s").limit(1).collect()
    knee = keyed.orderBy(F.desc(F.col(quality) - cost_weight * F.col(cost)), "_s").limit(1).collect()
    for rows, why in ((cheap, "economy"), (knee, "knee")):
        for r in rows:
            add(tuple(r["_s"]), why)
    for i, axis in enumerate(structure):
        if len({x[i] for x in reasons}) == 1:
            other = next((x for x, q in ranked if top - q <= 2 * within and x[i] not in {y[i] for y in reasons}), None)
            if other:
                add(other, f"diversity:{axis}")
    rows = [(*x, q, reasons[x]) for x, q in ranked if x in reasons]
    return cells.sparkSession.createDataFrame(rows, cells.select(*structure, F.col(quality).alias("best_quality"), F.array(F.lit("")).alias("reasons")).schema)


def carry_rate(rules: DataFrame, *keys: str) -> DataFrame:
    """How many final rules carry a quote, a text element, a grounding score, and all three (verbatim, te_id, score), with the shares of the whole."""
    has = {"verbatim": F.coalesce(F.trim("verbatim") != "", F.lit(False)), "text_element": F.col("te_id").isNotNull(), "grounding": F.col("score").isNotNull()}
    has["triple"] = has["verbatim"] & has["text_element"] & has["grounding"]
    return rules.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{n}") for n, c in has.items()), *(F.round(F.count_if(c) / F.count("*"), 4).alias(f"rate_{n}") for n, c in has.items()))
