"""Operators on small rows with known answers."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import agreement as A
from corvella.operators import graph as G
from corvella.operators import layout as L
from corvella.operators import matching as M
from corvella.operators import models as Mo
from corvella.operators import rules as R
from corvella.operators import selection as Sel
from corvella.operators import stats as St
from corvella.sources import artifacts as Ar
from corvella.sources import readers as Rd
from corvella.sources import writers as Wr
from corvella.streaming import incremental as In


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.fix_ligatures("t"), t="eﬃcient ﬂow") == "efficient flow"
    assert one(spark, T.remove_citations("t"), t="The study found. 12 These [1,2] results, 5 in 2020 or 1,2 .") == "The study found. These results, in 2020 or."
    assert one(spark, T.paragraph_class("t"), t=" Table 2. Values") == "table"
    assert [one(spark, T.is_cut_off("t"), t=t) for t in ("ends in hy-", "ends with", "It ends.", "", "see Fig.", "by Smith et al.", "a gene")] == [True, True, False, False, True, True, False]
    assert one(spark, T.sentences("t"), t="One. Two?  Three") == ["One.", "Two?", "Three"]
    assert one(spark, T.unrepeated("t"), t="ababab") == "ab"
    assert one(spark, T.polarity("t"), t="it was not detected") == -1
    assert one(spark, T.polarity("t"), t="Non-expressed but high") == 0
    assert one(spark, T.gene_like("t", ["DNA"]), t="TP53 and DNA and TP53") == ["TP53"]
    assert one(spark, T.mod_of_md5(F.col("t"), 100), t="42:x") == int(__import__("hashlib").md5(b"42:x").hexdigest(), 16) % 100
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0), t="") == 1.0
    assert one(spark, T.is_reference_entry("t"), t="1. Smith J, Jones A. Nature. 2020;123:456.")
    assert not one(spark, T.is_reference_entry("t"), t="The results were significant.")
    assert one(spark, T.fix_ligatures("t"), t="in /uniFB02 uenza Mart í n") == "influenza Martín"


def test_normalize_keeps_incomplete_findings_apart(spark):
    rows = [(1, "P1", "a", "b", "increases", "c", "positive", 0.5, 1), (2, "P2", "a", "b", "increases", "c", "positive", 0.5, 1), (3, "P1", None, "b", "increases", "c", "positive", 0.9, 1), (4, "P1", None, "b", "increases", "c", "positive", None, 1)]
    f = spark.createDataFrame(rows, "fid long, pmcid string, subject string, outcome string, relation string, category string, direction string, score double, te_id long")
    out = {r["best_fid"]: r for r in R.normalize(f).collect()}
    assert set(out) == {1, 3, 4} and out[1]["pmcids"] == "P1,P2" and out[1]["n_members"] == 2


def test_resolve_switches_weights_by_relations(spark):
    rules = spark.createDataFrame([(1, 5, 2, 1.0), (2, 1, 1, 0.5)], "rule_id long, n_findings long, n_papers long, mean_score double")
    plain = {r["rule_id"]: r["final_score"] for r in R.resolve(rules, None).collect()}
    assert plain == {1: 0.95, 2: pytest.approx(0.38)}
    edges = spark.createDataFrame([(1, 2, "CONTRADICT")], "rule_id_a long, rule_id_b long, label string")
    assert {r["rule_id"]: r["final_score"] for r in R.resolve(rules, edges).collect()} == {1: 0.55, 2: pytest.approx(0.07)}


@pytest.mark.parametrize("seed", range(40))
def test_optimal_match_is_optimal(seed):
    rng = np.random.default_rng(seed)
    s = rng.random((rng.integers(1, 6), rng.integers(1, 6))).round(2)
    n, m = s.shape
    best = max(sum(s[i, p[i]] for i in range(n)) if n <= m else sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
    assert sum(s[i, j] for i, j in M.optimal(s, -1.0)) == pytest.approx(best)


def test_greedy_match_takes_the_earlier_of_equals():
    assert M.greedy(np.array([[0.9, 0.9], [0.9, 0.2]]), 0.55) == [(0, 0)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    assert {(r["node"], r["root"]) for r in G.connected_components(edges).collect()} == {(i, 0) for i in range(31)} | {(50, 50), (51, 50)}


def test_decisions(spark):
    rows = spark.createDataFrame([(0, False, 0.9), (1, False, 0.1), (3, True, 0.99), (3, False, 0.95), (3, False, 0.1), (3, False, 0.5)], "n_eligible int, polarity_conflict boolean, agreement double")
    assert [r[0] for r in rows.select(A.decide(0.9, 0.2)).collect()] == ["escalate", "keep", "escalate", "keep", "reject", "escalate"]


def test_merged_boxes_grow_until_none_touch(spark):
    b = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 2.0, 2.0), (1, 1, 2, 5.0, 5.0, 6.0, 6.0), (1, 1, 3, 1.0, 1.0, 5.5, 5.5)], "doc long, page long, id long, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r)[2:] for r in L.merge_boxes(b).collect()] == [(0.0, 0.0, 6.0, 6.0)]


def test_stitching_loses_nothing_unless_asked_to(spark):
    p = spark.createDataFrame([(1, 0, "a -", "narrative", True), (1, 1, "T", "table", False), (1, 2, "b,", "narrative", True), (1, 3, "c.", "narrative", False)], "doc long, pos long, text string, kind string, cut boolean")
    assert sorted(r["text"] for r in L.stitch(p).collect()) == ["T", "a - b, c."]
    assert sorted(r["text"] for r in L.stitch(p, lossless=False).collect()) == ["T", "a - b,"]


def papers(seed, n):
    rng = np.random.default_rng(seed)
    return {i: {s: {f"{s}{x}" for x in rng.integers(0, 6, rng.integers(0, 4))} for s in ("disease", "method", "biomarker", "gene")} for i in range(1, n + 1)}


@pytest.mark.parametrize("seed", range(6))
def test_chosen_sets_against_brute_force(seed):
    pool = papers(seed, 13)
    worth = {i: 0.01 * (i % 4) for i in pool}
    edges = Sel.retained(pool, 12, 0.05)
    total = lambda ids: sum(worth[i] for i in ids) + sum(edges.get(p, 0.0) for p in itertools.combinations(ids, 2))
    ids, status = Sel.exact_related(pool, 4, worth=worth)
    assert status == "optimal" and ids == sorted(ids)
    assert total(ids) == pytest.approx(max(map(total, itertools.combinations(pool, 4))))
    some, status = Sel.exact_related(pool, 4, worth=worth, nodes=3)
    assert status == "feasible" and total(some) <= total(ids) + 1e-9
    related = Sel.greedy_related(pool, 4)
    mean = {i: sum(Sel.related(pool[i], pool[j]) for j in pool if j != i) for i in pool}
    assert mean[related[0]] == max(mean.values())
    for k in range(1, 4):
        rest = [i for i in pool if i not in related[:k]]
        sharing = [i for i in rest if any(pool[i]["disease"] & pool[c]["disease"] for c in related[:k])] or rest
        tied = {i: sum(Sel.related(pool[i], pool[c]) for c in related[:k]) for i in sharing}
        assert related[k] == min(i for i in sharing if tied[i] == max(tied.values()))
    diverse = Sel.greedy_diverse(pool, 4, dict.fromkeys(pool, 10))
    size = {i: sum(len(pool[i][s]) for s in ("disease", "method", "biomarker")) for i in pool}
    assert diverse[0] == min(i for i in pool if size[i] == max(size.values()))
    for k in range(1, 4):
        gain = {i: Sel.diversity([pool[c] for c in [*diverse[:k], i]]) for i in pool if i not in diverse[:k]}
        assert diverse[k] == min(i for i, g in gain.items() if g == max(gain.values()))
    assert Sel.greedy_related({}, 3) == Sel.greedy_diverse({}, 3) == []


def test_relatedness_and_diversity_of_known_papers(spark):
    a, b = {"disease": {"x", "y"}, "method": {"m"}}, {"disease": {"z"}, "method": {"m", "n"}}
    assert Sel.related(a, b) == pytest.approx(0.06 / 2 - 0.10)
    assert Sel.diversity([a]) == pytest.approx(0.30 * 2 / 3 + 0.20 * 1 / 2)
    assert Sel.diversity([a, a]) == pytest.approx(0.30 * 2 / 6 + 0.20 * 1 / 4 - 0.40 * 0.36)
    row = spark.createDataFrame([(["x", "y"], ["m"], ["z"], ["m", "n"])], "a_disease array<string>, a_method array<string>, b_disease array<string>, b_method array<string>")
    assert row.select(Sel.relatedness(["disease", "method"])).first()[0] == pytest.approx(-0.07)


def test_hard_set():
    of = {i: (i / 10, -float(i)) for i in range(10)}
    assert Sel.hard_set(of) == [9, 8, 0, 1, 4]  # of 2 to 7 the band is 4
    assert Sel.hard_set({1: (0.5, 1.0)}) == [1] and Sel.hard_set({}) == []


def test_select_theta_by_tiers(spark):
    def pick(rows, far, recall):
        r = A.select_theta(spark.createDataFrame(rows, "theta double, far double, recall double"), far, recall).first()
        return r["theta"], r["tier"]

    rows = [(0.2, 0.4, 0.9), (0.4, 0.2, 0.7), (0.6, 0.1, 0.5), (0.8, 0.0, 0.1), (0.9, float("nan"), 0.0), (0.95, None, None)]
    assert pick(rows, 0.25, 0.5) == (0.6, 0)
    assert pick(rows, 0.25, 0.95) == (0.8, 1)
    assert pick([(0.2, 0.4, 0.9), (0.4, 0.3, 0.7), (0.6, 0.3, 0.5)], 0.1, 0.5) == (0.4, 2)
    assert pick([(0.2, None, 0.9), (0.4, None, 0.7)], 0.1, 0.5) == (0.4, 3)


def test_node_score_by_first_rule(spark):
    schema = "type string, text string, y1 double, y2 double, white double, rendered boolean, blank boolean, n_words int, coverage double"
    rows = [
        ("TABLE", "", 10.0, 0.0, 1.0, True, True, 0, 0.0), ("TEXT", "  ", 10.0, 0.0, 0.0, True, False, 1, 1.0), ("TEXT", "word", 10.0, 0.0, 0.9, True, False, 1, 1.0),
        ("LIST_ITEM", "x" * 180, 10.0, 0.0, 0.0, True, True, 1, 1.0), ("PARAGRAPH", "word", 10.0, 0.0, 0.0, True, True, 1, 1.0), ("TEXT", "eight ch", 10.0, 0.0, 0.0, False, True, 0, 0.04),
        ("TEXT", "short", 10.0, 0.0, 0.0, False, True, 0, 0.0), ("TEXT", None, 10.0, 0.0, 0.0, True, False, 1, 1.0), ("TEXT", "word", 5.0, 5.0, 0.0, True, False, 0, 0.0),
    ]
    got = spark.createDataFrame(rows, schema).select(L.node_score(most_white=0.5).alias("r"), L.node_score().alias("d"), L.in_header_zone(F.lit(11.0)).alias("top")).collect()
    assert [r["r"] for r in got] == [None, "R0", "R-color", "R3", "R1", "R2", None, "R0", None]
    assert got[2]["d"] is None and [r["top"] for r in got[:1] + got[-1:]] == [True, False]


def test_stratified_sample_spills(spark):
    assert St.targets(100) == {"very_low": 10, "low": 15, "near_threshold_low": 25, "near_threshold_high": 25, "medium": 15, "high": 10}
    assert sum(St.targets(7).values()) == 7 and St.targets(0)["high"] == 0 and St.targets(1)["near_threshold_low"] == 1
    got = St.drawn({"low": 40, "near_threshold_low": 3, "high": 2}, 100)
    assert got == {"very_low": 0, "low": 40, "near_threshold_low": 3, "near_threshold_high": 0, "medium": 0, "high": 2}
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([None, -1.0, 0.0, 0.3, 0.45, 0.5, 0.55, 0.75, 1.0, 2.0])], "id long, s double")
    assert [r["b"] for r in rows.select(St.bucket_of(F.col("s")).alias("b")).collect()] == ["missing", "very_low", "very_low", "low", "near_threshold_low", "near_threshold_high", "medium", "high", "high", "high"]
    sample = St.stratified_sample(rows, "id", "s", 8, 1)
    assert sample.count() == 8 and sample.where("bucket = 'missing'").isEmpty()


def test_finalists_by_reason(spark):
    cells = spark.createDataFrame([("a", "x", 0.90, 0.9), ("a", "x", 0.50, 0.1), ("b", "x", 0.895, 0.5), ("c", "x", 0.70, 0.2), ("d", "y", 0.885, 0.95), ("e", "x", 0.3, 0.0)], "s string, k string, q double, c double")
    got = {r["s"]: (r["best_quality"], list(r["reasons"])) for r in St.finalists(cells, ["s", "k"], "q", "c", top_k=1, within=0.01, pareto_cap=3, least_quality=0.6, cost_weight=1.0).collect()}
    assert got == {"a": (0.90, ["top-k", "within-best", "pareto"]), "b": (0.895, ["within-best"]), "c": (0.70, ["pareto", "economy", "knee"]), "d": (0.885, ["diversity:k"]), "e": (0.3, ["pareto"])}
    assert St.finalists(cells.limit(0), ["s", "k"], "q", "c").count() == 0


def test_agreement_factors(spark):
    pairs = spark.createDataFrame([(1, 1, 10, 0.9), (1, 1, 11, 0.2), (1, 2, 10, 0.8), (1, 2, 11, 0.1)], "k long, a long, b long, similarity double")
    r = A.soft_alignment(pairs, ["k"]).first()
    # both claims of a choose 10: share 1 where 1/2 is expected; of b's claims both choose 1
    assert r["reuse_factor"] == pytest.approx(0.85) and r["count_factor"] == 1.0
    assert r["score"] == pytest.approx((0.85 + 0.55) / 2 * 0.85)
    texts = pairs.withColumn("x", F.when(F.col("a") == 1, "elevated in 5 mm").otherwise("seen")).withColumn("y", F.lit("reduced in 15 mm"))
    assert A.soft_alignment(texts, ["k"], a_claim="x", b_claim="y").first()["contradiction"] == 0.5
    quality = spark.createDataFrame([(1, 1, 0, 1.0, 9.0), (1, 2, 1, 0.2, 9.0), (1, 10, 1, 0.9, 1.0), (1, 11, 4, 0.1, 1.0)], "k long, v long, n_findings long, pass_share double, evidence double")
    same = pairs.withColumn("similarity", F.lit(0.5))
    assert A.consensus(same, ["k"], quality).first()["best_voter"] == 10
    assert A.consensus(same, ["k"], quality.withColumn("n_findings", F.lit(0))).first()["best_voter"] == 1
    assert A.best_output(quality, ["k"]).first()["best_voter"] == 2


def test_match_assembly_and_metrics(spark):
    silver = spark.createDataFrame([(1, 1, "A", "up "), (1, 2, "B", None), (1, 3, "C", "x")], "case_id long, id long, category string, direction string")
    pipeline = spark.createDataFrame([(1, 10, "a", "UP"), (1, 11, "Z", "down")], "case_id long, id long, category string, direction string")
    pairs = spark.createDataFrame([(1, a, b, s) for a, b, s in ((1, 10, 0.9), (1, 11, 0.1), (2, 10, 0.6), (2, 11, 0.8), (3, 10, 0.2), (3, 11, 0.3))], "case_id long, a long, b long, similarity double")
    out = M.assemble(M.match(pairs, "greedy", 0.55), silver, pipeline, ["category", "direction"])
    got = {(r["status"], r["a"], r["b"]): r["mismatched"] for r in out.collect()}
    assert got == {("matched", 1, 10): [], ("matched", 2, 11): ["category"], ("unmatched_silver", 3, None): []}
    m = M.metrics(out, ["category"]).first()
    assert (m["precision"], m["recall"], m["f1"], m["strict_f1"], m["n_mismatches"]) == (1.0, 0.6667, 0.8, 0.6, 1)


def test_stitching_both_ways(spark):
    rows = [(1, 0, "a ", "narrative", True), (1, 1, "T", "table", False), (1, 2, " b", "narrative", True), (1, 3, "c ", "narrative", False), (1, 4, " d", "narrative", False), (2, 0, "e-", "narrative", True)]
    p = spark.createDataFrame(rows, "doc long, pos long, text string, kind string, cut boolean")
    assert sorted((r["doc"], r["pos"], r["text"]) for r in L.stitch(p).collect()) == [(1, 0, "a b c "), (1, 1, "T"), (1, 4, " d"), (2, 0, "e-")]
    assert sorted((r["doc"], r["pos"], r["text"]) for r in L.stitch(p, lossless=False).collect()) == [(1, 0, "a b"), (1, 1, "T"), (1, 4, " d"), (2, 0, "e-")]


def test_nearest_caption_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    box = lambda n, first: [(int(rng.integers(0, 2)), 1, first + i, float(y), float(y + rng.integers(1, 4))) for i, y in enumerate(rng.integers(0, 20, n))]
    media, captions = box(40, 0), box(15, 100)
    schema = "doc long, page long, id long, y1 double, y2 double"
    got = {r["m_id"]: (r["c_id"], r["distance"]) for r in L.nearest_caption(spark.createDataFrame(media, schema), spark.createDataFrame(captions, schema)).collect()}
    want = {}
    for d, _, i, y1, y2 in media:
        near = [(min(abs(y1 - c2), abs(c1 - y2)), c) for e, _, c, c1, c2 in captions if e == d]
        if near:
            want[i] = min(near)[::-1]
    assert got == want


BOXED = "doc long, page long, id long, type string, rotated boolean, text string, x1 double, y1 double, x2 double, y2 double"


def test_footnotes_join_tables(spark):
    rows = [
        (1, 1, 1, "TABLE", False, "", 0.0, 100.0, 50.0, 200.0), (1, 1, 2, "FOOTNOTE", False, "", 0.0, 85.0, 60.0, 90.0), (1, 1, 3, "LIST_ITEM", False, "", 5.0, 70.0, 40.0, 74.0),
        (1, 1, 4, "LIST_ITEM", False, "", 0.0, 40.0, 50.0, 57.0), (1, 1, 5, "TEXT", False, "", 0.0, 10.0, 50.0, 20.0), (1, 1, 6, "TABLE", False, "", 0.0, 100.0, 50.0, 150.0),
        (1, 2, 7, "TABLE", True, "", 100.0, 100.0, 150.0, 200.0), (1, 2, 8, "FOOTNOTE", False, "", 80.0, 150.0, 95.0, 180.0), (1, 2, 9, "TEXT", False, "", 159.0, 150.0, 170.0, 160.0), (1, 2, 10, "FOOTNOTE", False, "", 152.0, 10.0, 160.0, 90.0),
    ]
    got = {r["id"]: (r["x1"], r["y1"], r["x2"], r["y2"], r["absorbed"]) for r in L.with_footnotes(spark.createDataFrame(rows, BOXED)).collect()}
    # 2 joins at a gap of 10, so further ones may be 12 away: 3 is 11 away, 4 is 13 away; table 6 finds them taken, and 5 too far
    assert got[1] == (0.0, 70.0, 60.0, 200.0, 2) and got[6] == (0.0, 100.0, 50.0, 150.0, 0)
    # the rotated one takes 8 on its left; 9 on its right is TEXT and more than 8 away, 10 isn't level with it
    assert got[7] == (80.0, 100.0, 150.0, 200.0, 1)


def test_figures_claim_captions(spark):
    rows = [
        (1, 1, 1, "PICTURE", False, "", 0.0, 100.0, 100.0, 200.0), (1, 1, 2, "FIGURE", False, "", 110.0, 100.0, 200.0, 200.0), (1, 1, 3, "CAPTION", False, "Figure 3. Cells", 0.0, 80.0, 100.0, 90.0),
        (1, 1, 4, "CAPTION", False, "Fig 3 again", 0.0, 500.0, 100.0, 510.0), (1, 1, 5, "PICTURE", False, "", 0.0, 0.0, 10.0, 10.0), (2, 1, 6, "PICTURE", False, "", 0.0, 0.0, 90.0, 90.0),
    ]
    df = spark.createDataFrame(rows, BOXED)
    got = {(r["doc"], r["num"]): (r["figure_id"], r["caption"], r["x2"]) for r in L.captioned_figures(df).collect()}
    assert got == {(1, "3"): ("3", "Figure 3. Cells", 100.0), (1, "3b"): ("3", "Fig 3 again", 200.0), (2, "1"): ("1", None, 90.0)}
    got = {(r["doc"], r["num"]): r["x2"] for r in L.captioned_figures(df, near=30.0).collect()}
    assert got == {(1, "3"): 200.0, (2, "1"): 90.0}


def test_masks_of_sidebars_and_strips(spark):
    rows = [(1, 1, 1, "TEXT", False, "side", 10.0, 300.0, 80.0, 400.0), (1, 1, 2, "TEXT", False, "main", 150.0, 100.0, 500.0, 700.0), (1, 1, 3, "TEXT", False, "low", 150.0, 800.0, 300.0, 805.0), (1, 1, 4, "TEXT", False, " ", 10.0, 420.0, 60.0, 425.0)]
    pages = spark.createDataFrame([(1, 1, 600.0, 842.0)], "doc long, page long, width double, height double")
    got = {tuple(r)[2:] for r in L.masks(spark.createDataFrame(rows, BOXED), pages).collect()}
    assert got == {("sidebar", 10.0, 300.0, 80.0, 400.0), ("header", 0.0, 700.0, 600.0, 842.0), ("footer", 0.0, 0.0, 600.0, 100.0)}
    kept = spark.createDataFrame([(1, 1, i, k, False, t, 0.0, a, 9.0, b) for i, (k, t, a, b) in enumerate([("TEXT", "body text", 100.0, 300.0), ("TEXT", "12", 150.0, 155.0), ("TEXT", "Revised: May", 150.0, 155.0), ("TEXT", "head", 310.0, 315.0), ("LIST_ITEM", "head", 310.0, 315.0), ("TEXT", None, 150.0, 155.0)])], BOXED)
    assert {r["id"] for r in L.artifacts(kept).collect()} == {1, 2, 3, 5}


def test_run_artifacts_over_calls(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = Ar.RunArtifacts(spark, root, "r", papers=["P1"], config={"a": 1}, extra={"x": 1}, chunk_size=5)
    first.completed("map")
    first.finish("failed", "no")
    again = Ar.RunArtifacts(spark, root, "r", papers=["P2", "P1"], config={}, extra={"y": 2}, chunk_size=0)
    m = json.loads(Ar.read_text(spark, f"{root}/r/manifest.json"))
    assert m == again.manifest and m["papers"] == ["P1", "P2"] and m["stages_completed"] == ["map"] and m["config"] == {"a": 1} and m["chunk_size"] == 0
    assert m["status"] == "running" and m["error"] is None and m["extra"] == {"x": 1, "y": 2} and m["timestamp_start"] == first.manifest["timestamp_start"]
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    assert again.write("map", "out", spark.range(3).toDF("x")) and not again.write("map", "bad", bad)
    with pytest.raises(Exception, match="broken"):
        again.write("map", "bad", bad, required=True)
    logged = spark.read.json(f"{root}/r/logs/stage_errors").collect()
    assert len(logged) == 2 and {r["stage"] for r in logged} == {"map"}
    assert Ar.read_text(spark, f"{root}/none") is None
    Ar.write_text(spark, f"{root}/damaged/manifest.json", "{")
    assert Ar.RunArtifacts(spark, root, "damaged").manifest["papers"] == []
    with pytest.raises(ValueError, match="at most 2"):
        Ar.batch_manifest(spark, f"{root}/b.json", "b", {}, spark.createDataFrame([], "section string, key string, value double"), spark.range(3).select(F.col("id").cast("string").alias("pmcid")), {}, most=2)
    assert Ar.config_digest({"b": 1, "a": "é"}) == Ar.config_digest({"a": "é", "b": 1})


def test_reports_escape_and_say_what_they_leave_out(spark):
    rows = spark.createDataFrame([("<b>", 1), (None, 2), ("c", 3)], "name string, n int")
    page = Ar.html_report("R & D", {"t": rows}, most=2)
    assert "&lt;b&gt;" in page and "R &amp; D" in page and page.count("<tr>") == 3 and "The first 2 rows." in page
    assert Ar.text_histogram([("a", 3), ("b", 1)], 6).splitlines() == ["a       3   75.0%  ######", "b       1   25.0%  ##"] and Ar.text_histogram([]) == ""


def test_numbers_begin_words(spark):
    assert one(spark, T.numbers("t"), t="CD20 in 15.5 of 200 (7) x3") == ["15.5", "200", "7"]
    rows = spark.createDataFrame([("5mm", "15 mm"), ("CD20 5", "15"), ("0 cells", "9 cells"), ("5 of 6", "15"), ("5", "9"), (None, "5")], "a string, b string")
    assert [r[0] for r in rows.select(T.numeric_contradiction("a", "b")).collect()] == [True, True, False, False, False, False]


def test_verbatim_ratio_of_long_sources(spark):
    from difflib import SequenceMatcher

    quote, source = "the cells were not stained at all", "abcdefgh the cells " * 30
    row = M.verbatim_ratio(spark.createDataFrame([(quote, source), ("The Cells", source)], "q string, s string"), "q", "s").collect()
    assert row[0]["ratio"] == pytest.approx(SequenceMatcher(None, quote, source.strip()).ratio(), abs=1e-6) and row[1]["ratio"] == 1.0


def test_pareto_and_percentiles(spark):
    p = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (3.0, 3.0), (9.0, 4.0)], "c double, q double")
    assert {tuple(r) for r in St.pareto(p, "c", "q").collect()} == {(1.0, 1.0), (2.0, 3.0), (9.0, 4.0)}
    v = spark.createDataFrame([(1, x) for x in range(10)], "k int, v int").withColumn("t", F.col("v"))
    assert St.nth_percentile(v, ["k"], "v", St.lower_rank(0.5), "t").first()["v"] == 4
    assert St.nth_percentile(v, ["k"], "v", St.clipped_rank(0.99), "t").first()["v"] == 9


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = Rd.jsonl(spark, str(tmp_path / "x.jsonl"), "a long")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    assert Rd.jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    assert Rd.exists_in(good, "a", 2) and not Rd.exists_in(good, "a", 3)
    (tmp_path / "PMC7.txt").write_text("[TITLE]\nA title\n[BODY TEXT]\nfirst\nsecond\n")
    assert [(r["section"], r["text"]) for r in Rd.tagged_sections(spark, str(tmp_path / "PMC7.txt")).orderBy("pos").collect()] == [("TITLE", "A title"), ("BODY TEXT", "first\nsecond")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "PMC8.json").write_text(json.dumps({"elements": [{"element_index": 0, "type": "text", "page": 2, "bbox": {"x1": 1.25, "y1": 2, "x2": 3, "y2": 4}, "text": "t", "level": 1}]}))
    assert Rd.layout_elements(spark, str(tmp_path / "l")).first()["key"] == "PMC8::p2_text_1.3_2.0"
    (tmp_path / "a.xml").write_text('<article xmlns:xlink="x"><self-uri xlink:href="p.pdf"/></article>')
    assert Rd.self_uri(spark, str(tmp_path / "a.xml")).first()["pdf"] == "p.pdf"
    assert [r["bucket"] for r in Rd.selection(spark, '{"x": ["1", "2"], "y": ["2", "3"]}').orderBy("position").collect()] == ["x", "x", "y"]
    with pytest.raises(ValueError, match="there are"):
        Rd.check_filter(good, "a", "9")
    nested = spark.createDataFrame([("P", "C1", [(1, 2, 0.5)])], "pmcid string, chunk_id string, pairwise_scores array<struct<a:int,b:int,s:double>>")
    assert tuple(Wr.pairwise_scores(nested).first()) == ("P", "C1", 1, 2, 0.5)
    Wr.write_by_concept(nested.select("pmcid", "chunk_id"), str(tmp_path / "c"), "chunk_id")
    assert (tmp_path / "c" / "chunk_id=C1").exists()
    counts = spark.createDataFrame([("a", 1), ("a", 2)], "key string, n long")
    assert json.loads(Wr.manifest(counts, {"x": 1}))["counts"] == {"a": 3}
    assert Wr.merge_manifests({"a": {"x": 1}}, {"a": {"y": 2}}) == {"a": {"x": 1, "y": 2}}
    assert "| a | 1 |" in Wr.markdown(counts, "T")
    assert Wr.schema_drift(counts, {"key": "string", "m": "int"}, [["key"]]) == ["missing column m", "key repeats"]


def test_streaming_keeps_the_latest_and_resumes(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": 1}\n{"k": 2, "v": 5}\n')
    stream = In.tail_json(spark, str(src), "k long, v long")
    In.each_batch(stream, str(tmp_path / "cp"), In.latest_by_key(stream, store, "k", "v")).awaitTermination()
    (src / "2.json").write_text('{"k": 1, "v": 9}\n')
    In.each_batch(stream, str(tmp_path / "cp"), In.latest_by_key(stream, store, "k", "v")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{store}/1").collect()} == {(1, 9), (2, 5)}


def test_entailment_stand_in(spark):
    p = spark.createDataFrame([(1, ["the cat sat", "on it"], "cat sat"), (2, [" "], "cat")], "id long, sentences array<string>, claim string")
    assert {r["id"]: r["entailment"] for r in Mo.windowed_entailment(p, Mo.TokenOverlap(), 1).collect()} == {1: 1.0, 2: 0.0}
