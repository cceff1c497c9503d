"""One-to-one matching inside a case: greedy and optimal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(similarity: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs in order of falling similarity above the threshold, the earlier row and column first among equals."""
    rows, cols = np.nonzero(similarity > threshold)
    order = np.lexsort((cols, rows, -similarity[rows, cols]))
    used_r, used_c, out = set(), set(), []
    for i, j in zip(rows[order].tolist(), cols[order].tolist(), strict=True):
        if i not in used_r and j not in used_c:
            used_r.add(i)
            used_c.add(j)
            out.append((i, j))
    return out


def optimal(similarity: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The assignment with the largest total similarity (shortest augmenting paths with potentials), then the threshold."""
    flip = similarity.shape[0] > similarity.shape[1]
    cost = -(similarity.T if flip else similarity)
    n, m = cost.shape
    row_price, col_price, row_of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for r in range(n):
        row_of[m] = r
        at, least, before, done = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[at] != n:
            done[at] = True
            i = row_of[at]
            open_ = ~done[:m]
            reduced = cost[i] - row_price[i] - col_price[:m]
            better = open_ & (reduced < least)
            least[better], before[better] = reduced[better], at
            nearest = int(np.where(open_, least, np.inf).argmin())
            step = least[nearest]
            row_price[row_of[done]] += step
            col_price[done] -= step
            least[open_] -= step
            at = nearest
        while at != m:
            row_of[at] = row_of[before[at]]
            at = before[at]
    pairs = [(int(row_of[j]), j) for j in range(m) if row_of[j] != n]
    pairs = [(j, i) for i, j in pairs] if flip else pairs
    return sorted((i, j) for i, j in pairs if similarity[i, j] > threshold)


METHODS: dict[str, Callable[[np.ndarray, float], list[tuple[int, int]]]] = {"greedy": greedy, "optimal": optimal}


def match(pairs: DataFrame, method: str = "optimal", threshold: float = 0.55) -> DataFrame:
    """(case_id, a, b, similarity) of matched pairs, from (case_id, a, b, similarity) of all pairs of each case."""
    solve = METHODS[method]

    def one(case: pd.DataFrame) -> pd.DataFrame:
        table = case.pivot(index="a", columns="b", values="similarity").sort_index().sort_index(axis=1)
        s = table.to_numpy()
        found = solve(s, threshold)
        return pd.DataFrame({"case_id": [case["case_id"].iloc[0]] * len(found), "a": [table.index[i] for i, _ in found], "b": [table.columns[j] for _, j in found], "similarity": [s[i, j] for i, j in found]})

    return pairs.groupBy("case_id").applyInPandas(one, "case_id long, a long, b long, similarity double")


def mismatches(fields: list[str], a: str = "a_", b: str = "b_") -> Column:
    """The fields that both sides of a pair fill and fill differently, but for case and blanks at the ends."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    differs = [F.when((norm(a + f) != "") & (norm(b + f) != "") & (norm(a + f) != norm(b + f)), F.lit(f)) for f in fields]
    return F.filter(F.array(*differs), lambda x: x.isNotNull())


def assemble(matched: DataFrame, silver: DataFrame, pipeline: DataFrame, fields: list[str]) -> DataFrame:
    """Everything about every finding of both sides: (case_id, status, a, b, similarity, mismatched).

    `matched` is what `match` gives; `silver` and `pipeline` have case_id, id and the fields. A status is matched,
    unmatched_silver or unmatched_pipeline.
    """
    side = lambda d, k: d.select("case_id", F.col("id").alias(k), *(F.col(f).alias(f"{k}_{f}") for f in fields))
    s, p = side(silver, "a"), side(pipeline, "b")
    pairs = matched.join(s, ["case_id", "a"]).join(p, ["case_id", "b"]).select("case_id", F.lit("matched").alias("status"), "a", "b", "similarity", mismatches(fields).alias("mismatched"))
    none = F.array().cast("array<string>").alias("mismatched")
    left = s.join(matched, ["case_id", "a"], "left_anti").select("case_id", F.lit("unmatched_silver").alias("status"), "a", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("similarity"), none)
    right = p.join(matched, ["case_id", "b"], "left_anti").select("case_id", F.lit("unmatched_pipeline").alias("status"), F.lit(None).cast("long").alias("a"), "b", F.lit(None).cast("double").alias("similarity"), none)
    return pairs.unionByName(left).unionByName(right)


def metrics(assembled: DataFrame, strict: list[str], *keys: str) -> DataFrame:
    """Precision, recall, F1, mean similarity, strict F1 (half a credit where a field of `strict` differs) and the number of
    differing fields, by key or in total; 0 where there is nothing to divide by."""
    hit = F.col("status") == "matched"
    credit = F.when(hit, F.when(F.arrays_overlap("mismatched", F.array(*map(F.lit, strict))), 0.5).otherwise(1.0))
    m = assembled.groupBy(*keys).agg(
        F.count_if(hit).alias("n_matched"), F.count("a").alias("n_silver"), F.count("b").alias("n_pipeline"), F.avg("similarity").alias("_s"), F.coalesce(F.sum(credit), F.lit(0.0)).alias("_c"), F.coalesce(F.sum(F.size("mismatched")), F.lit(0)).alias("n_mismatches")
    )
    rate = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    out = m.withColumn("_p", rate(F.col("n_matched"), F.col("n_pipeline"))).withColumn("_r", rate(F.col("n_matched"), F.col("n_silver")))
    both = F.col("n_silver") + F.col("n_pipeline")
    return out.select(
        *keys, "n_silver", "n_pipeline", "n_matched", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"), F.round(rate(2 * F.col("n_matched"), both), 4).alias("f1"),
        F.round(F.coalesce("_s", F.lit(0.0)), 4).alias("avg_similarity"), F.round(rate(2 * F.col("_c"), both), 4).alias("strict_f1"), "n_mismatches",
    )


def alignment_f1(pairs: DataFrame, method: str = "optimal", threshold: float = 0.0) -> DataFrame:
    """(case_id, f1): matched similarity over the mean number of both sides; 1 if both are empty can't occur among pairs."""
    sizes = pairs.groupBy("case_id").agg(F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    got = match(pairs, method, threshold).groupBy("case_id").agg(F.sum("similarity").alias("s"))
    return sizes.join(got, "case_id", "left").select("case_id", F.round(2 * F.coalesce("s", F.lit(0.0)) / (F.col("na") + F.col("nb")), 5).alias("f1"))


def verbatim_ratio(rows: DataFrame, quote: str, source: str) -> DataFrame:
    """How much of a quote its source has: 1 if it holds it whole, else the ratio of longest matching blocks. In sources of 200
    characters or more, characters that are more than a hundredth of it start no block (SequenceMatcher's own default)."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(q, s, strict=True)])

    q, s = F.lower(F.trim(F.col(quote))), F.lower(F.trim(F.col(source)))
    return rows.withColumn("ratio", F.when(F.contains(s, q), 1.0).otherwise(F.round(ratio(q, s), 6))).withColumn("code", F.when(F.col("ratio") < 0.25, "FABRICATED").when(F.col("ratio") < 0.6, "WEAK").otherwise("ok"))
