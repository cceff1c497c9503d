"""Choosing documents: relatedness, diversity, hardness, neighbours and greedy sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions.text import jaccard

#: Weights of the sets that relate two papers, and what sharing no disease costs (fixed values).
WEIGHTS = {"disease": 0.30, "biomarker": 0.20, "gene": 0.15, "cui": 0.15, "tissue": 0.10, "method": 0.06, "outcome": 0.04, "generic": 0.02}
NO_SHARED_DISEASE = 0.10


def relatedness(sets: list[str], a: str = "a_", b: str = "b_") -> Column:
    """The weighted Jaccard similarity of two fingerprints, less a penalty if they share no disease; it may be below 0."""
    total: Column = F.lit(0.0)
    for s in sets:
        total = total + WEIGHTS[s] * jaccard(F.col(a + s), F.col(b + s), 0.0)
    if "disease" in sets:
        total = total - F.when(F.size(F.array_intersect(F.col(f"{a}disease"), F.col(f"{b}disease"))) == 0, NO_SHARED_DISEASE).otherwise(0.0)
    return total


def related_pairs(papers: DataFrame, sets: list[str], block: str) -> DataFrame:
    """Relatedness of all papers that share an element of the set `block`; they meet by element, so others are never paired."""
    e = papers.select("id", F.explode(block).alias("e"))
    ids = e.select(F.col("id").alias("i"), "e").join(e.select(F.col("id").alias("j"), "e"), "e").where("i < j").select("i", "j").distinct()
    side = lambda k, p: papers.select(F.col("id").alias(k), *(F.col(s).alias(p + s) for s in sets))
    return ids.join(side("i", "a_"), "i").join(side("j", "b_"), "j").select("i", "j", F.round(relatedness(sets), 6).alias("score"))


def top_neighbours(pairs: DataFrame, m: int, threshold: float) -> DataFrame:
    """Pairs among the best m of either end, above the threshold."""
    both = pairs.select("i", "j", "score").union(pairs.select("j", "i", "score")).where(F.col("score") >= threshold)
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    best = both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m)
    return best.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "score").distinct()


#: What scales the parts of hardness to 0..1, and what a part is worth (fixed values): entities, unique entities and
#: abbreviations a sentence; tables, captions, very short and very long paragraphs an element; relation anchors.
CONTENT = {"n_entities": (4.0, 0.4), "n_unique": (1.5, 0.4), "n_abbreviations": (0.5, 0.2)}
LAYOUT = {"n_tables": (0.05, 0.30), "n_captions": (0.10, 0.20), "n_short": (0.30, 0.25), "n_long": (0.10, 0.25)}
ANCHORS, HARDNESS, NOISE = 30, (0.45, 0.25, 0.30), 0.10


def hardness(papers: DataFrame) -> DataFrame:
    """Parts of hardness (content, layout, relation), the normalised one, and the absolute one that grows with the number of chunks.

    Columns: n_sentences, n_elements, n_chunks, n_anchors, those of CONTENT and LAYOUT, and noise (0 to 1, or null where unknown).
    """

    def part(of: dict[str, tuple[float, float]], per: str) -> Column:
        total: Column = F.lit(0.0)
        for c, (ref, weight) in of.items():
            total = total + F.least(F.col(c) / F.greatest(F.col(per), F.lit(1)) / ref, F.lit(1.0)) * weight
        return total

    layout = part(LAYOUT, "n_elements")
    layout = F.when(F.col("noise").isNotNull(), layout * (1 - NOISE) + F.col("noise") * NOISE).otherwise(layout)
    out = papers.withColumn("content", part(CONTENT, "n_sentences")).withColumn("layout", layout).withColumn("relation", F.least(F.col("n_anchors") / ANCHORS, F.lit(1.0)))
    a, b, c = HARDNESS
    normal = a * F.col("content") + b * F.col("layout") + c * F.col("relation")
    return out.withColumn("normalised", normal).withColumn("absolute", normal * F.log1p("n_chunks"))


# Sets of papers are chosen from pools: the best of all papers by a score (`pool`), as many as the choice may look at.

#: A paper's entities by bucket.
Paper = dict[str, set[str]]
#: What covering entities of a bucket is worth, and how many of them a paper is expected to add (fixed values).
COVERAGE = {"disease": (0.30, 3), "method": (0.20, 2), "outcome": (0.10, 2), "tissue": (0.10, 2), "biomarker": (0.20, 3)}
#: What mean relatedness costs a set, from where on two papers are near-duplicates, and what each such pair costs (fixed values).
PAIR_COST, NEAR_DUPLICATE, NEAR_DUPLICATE_COST = 0.40, 0.65, 0.20


def pool(papers: DataFrame, sets: list[str], score: Column, limit: int) -> dict[int, Paper]:
    """The `limit` papers with the highest score over all `papers`, the smaller id first of equals, with their sets."""
    best = papers.withColumn("_s", score).orderBy(F.desc("_s"), "id").limit(limit).select("id", *sets).collect()
    return {r["id"]: {s: set(r[s]) for s in sets} for r in best}


def related(a: Paper, b: Paper) -> float:
    """`relatedness` of two papers of a pool."""
    total = 0.0
    for s in a:
        union = a[s] | b[s]
        total += WEIGHTS[s] * (len(a[s] & b[s]) / len(union) if union else 0.0)
    return total - (NO_SHARED_DISEASE if "disease" in a and not a["disease"] & b["disease"] else 0.0)


def diversity(papers: list[Paper]) -> float:
    """Coverage of entities by a set of papers, less what their relatedness costs; one paper has coverage alone."""
    n = len(papers)
    if not n:
        return 0.0
    covered = sum(w * len(set().union(*(p.get(s, set()) for p in papers))) / (each * n) for s, (w, each) in COVERAGE.items())
    pairs = [related(a, b) for i, a in enumerate(papers) for b in papers[i + 1 :]]
    return covered - (PAIR_COST * sum(pairs) / len(pairs) + NEAR_DUPLICATE_COST * sum(x >= NEAR_DUPLICATE for x in pairs) if pairs else 0.0)


def greedy_related(papers: dict[int, Paper], k: int) -> list[int]:
    """k papers: the one most related to all others on average, then again and again the one most related to those chosen
    that shares a disease with one of them; if none does, of all."""
    ids = list(papers)
    if not ids or k < 1:
        return []
    score = {(i, j): related(papers[i], papers[j]) for i in ids for j in ids if i != j}
    chosen = [min(ids, key=lambda i: (-sum(score[i, j] for j in ids if j != i), str(i)))]
    while len(chosen) < min(k, len(ids)):
        rest = [i for i in ids if i not in chosen]
        sharing = [i for i in rest if any(papers[i].get("disease", set()) & papers[c].get("disease", set()) for c in chosen)]
        chosen.append(max(sharing or rest, key=lambda i: sum(score[i, c] for c in chosen)))
    return chosen


def greedy_diverse(papers: dict[int, Paper], k: int, sentences: dict[int, int] | None = None) -> list[int]:
    """k papers: the one with the most entities (diseases, methods, biomarkers, outcomes; of equals the shortest), then
    again and again the one with which the set is most diverse."""
    ids, chosen, length = list(papers), [], sentences or {}
    while len(chosen) < min(k, len(ids)):
        rest = [i for i in ids if i not in chosen]
        if not chosen:
            chosen.append(max(rest, key=lambda i: (sum(len(papers[i].get(s, ())) for s in ("disease", "method", "biomarker", "outcome")), -length.get(i, 0))))
        else:
            chosen.append(max(rest, key=lambda i: diversity([papers[c] for c in chosen] + [papers[i]])))
    return chosen


def hard_set(hardness_of: dict[int, tuple[float, float]], k: int = 5) -> list[int]:
    """Two papers of the highest normalised hardness, two of the highest absolute, one from the middle of the 40 to 65 %
    band of what is left; filled up with the hardest. `hardness_of` has (normalised, absolute) by id, in order of preference."""
    ids = list(hardness_of)
    by_normal, by_absolute = (sorted(ids, key=lambda i, x=x: -hardness_of[i][x]) for x in (0, 1))
    chosen = by_normal[:2]
    chosen += [i for i in by_absolute if i not in chosen][:2]
    left = [i for i in sorted(ids, key=lambda i: hardness_of[i][0]) if i not in chosen]
    if left:
        low = int(len(left) * 0.40)
        band = left[low : max(int(len(left) * 0.65), low + 1)]
        chosen.append(band[len(band) // 2])
    return (chosen + [i for i in by_normal if i not in chosen])[:k]


def retained(papers: dict[int, Paper], m: int, threshold: float) -> dict[tuple[int, int], float]:
    """Relatedness of the pairs that reach the threshold and are among the best m of one end."""
    ids, best = list(papers), {}
    for i in ids:
        near = sorted(((related(papers[i], papers[j]), j) for j in ids if j != i), key=lambda x: (-x[0], str(x[1])))
        best |= {(min(i, j), max(i, j)): s for s, j in [x for x in near if x[0] >= threshold][:m]}
    return best


def exact_related(papers: dict[int, Paper], k: int, m: int = 12, threshold: float = 0.05, worth: dict[int, float] | None = None, nodes: int = 200_000) -> tuple[list[int], str]:
    """The k papers with the largest sum of retained relatedness and own worth, by branch and bound, and whether that is
    proven: "optimal", or "feasible" if the search ends after `nodes` steps (the best found so far, the greedy one at least)."""
    edges, own = retained(papers, m, threshold), worth or {}
    score = edges | {(j, i): s for (i, j), s in edges.items()}
    ids = sorted(papers, key=lambda i: -(own.get(i, 0.0) + sum(score.get((i, j), 0.0) for j in papers)))

    def total(chosen: list[int]) -> float:
        return sum(own.get(i, 0.0) for i in chosen) + sum(score.get((i, j), 0.0) for x, i in enumerate(chosen) for j in chosen[x + 1 :])

    start = greedy_related(papers, k)
    best, left = (total(start), sorted(start)), nodes

    def grow(at: int, chosen: list[int], have: float) -> None:
        nonlocal best, left
        left -= 1
        if len(chosen) == k:
            if have > best[0] + 1e-12:
                best = have, sorted(chosen)
            return
        want, rest = k - len(chosen), ids[at:]
        if len(rest) < want or left <= 0:
            return
        bounds = []
        for i in rest:  # what a paper can add: its ties to those chosen, and half of its best ties to others that may come
            ties = sorted((score.get((i, j), 0.0) for j in rest if j != i), reverse=True)[: want - 1]
            bounds.append(own.get(i, 0.0) + sum(score.get((i, c), 0.0) for c in chosen) + sum(ties) / 2)
        if have + sum(sorted(bounds, reverse=True)[:want]) <= best[0] + 1e-12:
            return
        i = ids[at]
        grow(at + 1, [*chosen, i], have + own.get(i, 0.0) + sum(score.get((i, c), 0.0) for c in chosen))
        grow(at + 1, chosen, have)

    grow(0, [], 0.0)
    return best[1], "optimal" if left > 0 else "feasible"


def choose_policy(metrics: DataFrame, most_cost: float, least_quality: float) -> DataFrame:
    """One policy under limits on cost and quality: the best quality, then the least cost."""
    return metrics.where((F.col("cost") <= most_cost) & (F.col("quality") >= least_quality)).orderBy(F.desc("quality"), "cost", "policy").limit(1)
