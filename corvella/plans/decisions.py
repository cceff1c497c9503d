"""Queries on agreement, matching, selection, layout, graphs and bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.operators import agreement as A
from corvella.operators import graph as G
from corvella.operators import layout as L
from corvella.operators import matching as M
from corvella.operators import rules as R
from corvella.operators import selection as Sel
from corvella.operators import stats as St
from corvella.plans.registry import query
from corvella.plans.rules import RELATIONS
from corvella.sources.domain import CLAIMS, DECISIONS, TEXT_ELEMENTS, claims, decisions, findings, table, text_elements

COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"
SIM = f"(SELECT s.case_id, s.vec_id AS a, p.vec_id AS b, {COS.format(a='s.embedding', b='p.embedding')} AS similarity FROM {CLAIMS} s JOIN {CLAIMS} p ON s.case_id = p.case_id WHERE s.side = 'S' AND p.side = 'P')"
DECIDE = "CASE WHEN n_eligible = 0 THEN 'escalate' WHEN n_eligible = 1 THEN 'keep' WHEN polarity_conflict THEN 'escalate' WHEN agreement >= {t} THEN 'keep' WHEN agreement <= {r} THEN 'reject' ELSE 'escalate' END"


def _pairs(spark, sf_dir):
    c = claims(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return A.similarity_pairs(c.where("side = 'S'"), c.where("side = 'P'"), ["case_id"])


@query(f"SELECT case_id, a, b, round(similarity, 5) AS similarity FROM {SIM}")
def J16_V01_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 5))


CLAIM_TEXT = "CASE {v} % 4 WHEN 0 THEN 'cells increased by ' || CAST({v} % 9 AS VARCHAR) WHEN 1 THEN 'cells decreased by 4' WHEN 2 THEN 'not increased in 2 of 9' ELSE 'seen in CD20 cells' END"


def _claim_text(v):
    k = F.col(v) % 4
    return F.when(k == 0, F.concat(F.lit("cells increased by "), (F.col(v) % 9).cast("string"))).when(k == 1, "cells decreased by 4").when(k == 2, "not increased in 2 of 9").otherwise("seen in CD20 cells")


#: The polarity and the single number of those texts.
_POLE = "CASE {v} % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 0 END"
_NUMBER = "CASE {v} % 4 WHEN 0 THEN {v} % 9 WHEN 1 THEN 4 END"


@query(f"""WITH s AS (SELECT case_id, a, b, CASE WHEN greatest(0.0, least(1.0, similarity)) < 0.15 THEN 0.0 ELSE greatest(0.0, least(1.0, similarity)) END AS s FROM {SIM}),
ba AS (SELECT case_id, a, max(s) AS m, arg_max(b, (s, -b)) AS t FROM s GROUP BY ALL), bb AS (SELECT case_id, b, max(s) AS m, arg_max(a, (s, -a)) AS t FROM s GROUP BY ALL),
x AS (SELECT case_id, sum(m) / sum(k) AS ca, sum(k) AS na, max(k) AS ka FROM (SELECT case_id, t, count(*) AS k, sum(m) AS m FROM ba GROUP BY ALL) GROUP BY case_id), y AS (SELECT case_id, sum(m) / sum(k) AS cb, sum(k) AS nb, max(k) AS kb FROM (SELECT case_id, t, count(*) AS k, sum(m) AS m FROM bb GROUP BY ALL) GROUP BY case_id),
st AS (SELECT case_id, {_POLE.format(v='a')} AS pa, {_POLE.format(v='t')} AS pb, {_NUMBER.format(v='a')} AS xa, {_NUMBER.format(v='t')} AS xb FROM ba WHERE m >= 0.15),
c AS (SELECT case_id, greatest(count(*) FILTER (pa * pb = -1), count(*) FILTER (xa > 0 AND xb > 0 AND greatest(xa, xb) >= 2 * least(xa, xb))) / count(*) AS c FROM st GROUP BY case_id)
SELECT case_id, round(coalesce(c, 0), 4) AS contradiction, round((ca + cb) / 2 * pow(least(na, nb) / greatest(na, nb), 0.25) * ((CASE WHEN nb > 1 THEN 1 - 0.15 * greatest(0, ka / na - 1 / nb) / (1 - 1 / nb) ELSE 1 END) + (CASE WHEN na > 1 THEN 1 - 0.15 * greatest(0, kb / nb - 1 / na) / (1 - 1 / na) ELSE 1 END)) / 2 * (1 - 0.20 * coalesce(c, 0)), 4) AS score
FROM x JOIN y USING (case_id) LEFT JOIN c USING (case_id)""")
def V02_soft_alignment(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("ca", _claim_text("a")).withColumn("cb", _claim_text("b"))
    return A.soft_alignment(pairs, ["case_id"], a_claim="ca", b_claim="cb").select("case_id", F.round("contradiction", 4).alias("contradiction"), F.round("score", 4).alias("score"))


@query(f"""WITH m AS (SELECT case_id, v, round(avg(round(similarity, 1)), 6) AS m FROM (SELECT case_id, a AS v, similarity FROM {SIM} UNION ALL SELECT case_id, b, similarity FROM {SIM}) GROUP BY ALL),
k AS (SELECT *, v % 3 AS n, CASE WHEN v % 3 > 0 THEN round((v % 5) / 5, 6) ELSE 0 END AS p, CASE WHEN v % 3 > 0 THEN v % 7 ELSE 0 END AS e FROM m) SELECT case_id, max(m) AS deferral, arg_max(v, (n > 0, m, p, e, n, -v)) AS best_voter FROM k GROUP BY case_id""")
def V06_consensus(spark, sf_dir):
    v = F.col("vec_id")
    quality = claims(spark, sf_dir).select("case_id", v.alias("v"), (v % 3).alias("n_findings"), F.round((v % 5) / 5, 6).alias("pass_share"), (v % 7).cast("double").alias("evidence"))
    return A.consensus(_pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 1)), ["case_id"], quality)


@query(f"SELECT case_id, arg_max(vec_id, (vec_id % 4, vec_id % 3, -vec_id)) AS best_voter FROM {CLAIMS} GROUP BY case_id")
def D02_best_output(spark, sf_dir):
    v = F.col("vec_id")
    return A.best_output(claims(spark, sf_dir).select("case_id", v.alias("v"), (v % 4).alias("evidence"), (v % 3).alias("n_findings")), ["case_id"])


@query(f"SELECT te_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS lexical FROM (SELECT te_id, list_distinct(string_split(lower(text), ' ')) AS a, list_distinct(string_split(lower(replace(text, 'e', 'a')), ' ')) AS b FROM {TEXT_ELEMENTS})")
def V07_U04_lexical_similarity(spark, sf_dir):
    from corvella.functions.text import jaccard

    a, b = F.split(F.lower("text"), " "), F.split(F.lower(F.replace("text", F.lit("e"), F.lit("a"))), " ")
    return text_elements(spark, sf_dir).select("te_id", F.round(jaccard(a, b, 1.0), 6).alias("lexical"))


@query("""WITH d AS (SELECT doc_id, n_chars AS n, doc_id AS i FROM documents), s AS (SELECT doc_id, (n % 100) / 100.0 AS e, (n % 37) / 37.0 AS ga, (i % 11) / 11.0 AS gb,
 list_distinct(list_filter([n % 3, n % 5, 7], lambda x: x > 1)) AS ca, list_distinct(list_filter([i % 3, i % 7], lambda x: x > 1)) AS cb, list_distinct([n % 4, n % 6]) AS ea, list_distinct([i % 4, i % 6]) AS eb, list_distinct(list_filter([n % 2], lambda x: x > 0)) AS va, list_distinct(list_filter([i % 2], lambda x: x > 0)) AS vb FROM d),
j AS (SELECT *, CASE WHEN len(ca) + len(cb) = 0 THEN 1 ELSE len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))) END AS c, len(list_intersect(ea, eb)) / len(list_distinct(list_concat(ea, eb))) AS n, CASE WHEN len(va) + len(vb) = 0 THEN 1 ELSE len(list_intersect(va, vb)) / len(list_distinct(list_concat(va, vb))) END AS v FROM s)
SELECT doc_id, round(0.15 * c + 0.30 * e + 0.50 * n + 0.05 * v + 1e-9, 6) AS hybrid, round((0.15 * c + 0.30 * e + 0.50 * n + 0.05 * v) * (0.3 + 0.7 * least(ga, gb)) + 1e-9, 6) AS grounded FROM j""")
def V04_V05_hybrid_and_grounding(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id")
    some = lambda least, *x: F.filter(F.array(*x), lambda v: v > least)
    sets = [(some(1, n % 3, n % 5, F.lit(7).cast("long")), some(1, i % 3, i % 7)), (F.array(n % 4, n % 6), F.array(i % 4, i % 6)), (some(0, n % 2), some(0, i % 2))]
    e, shares = (n % 100) / 100.0, ((n % 37) / 37.0, (i % 11) / 11.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(A.hybrid(sets, e) + 1e-9, 6).alias("hybrid"), F.round(A.hybrid(sets, e, pass_shares=shares) + 1e-9, 6).alias("grounded"))


@query(f"SELECT level, decision, count(*) AS n FROM (SELECT level, {DECIDE.format(t=0.8, r=0.2)} AS decision FROM {DECISIONS}) GROUP BY ALL")
def D01_D03_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).withColumn("decision", A.decide(0.8, 0.2)).groupBy("level", "decision").agg(F.count("*").alias("n"))


@query("SELECT gate, count(*) AS n FROM (SELECT CASE WHEN e >= 2 THEN 'agreement' WHEN e = 1 THEN 'policy' WHEN u = 0 THEN 'escalate' WHEN s = u THEN 'reject_schema' ELSE 'reject_grounding' END AS gate FROM (SELECT event_id % 3 AS e, event_id % 4 AS u, event_id % 5 AS s FROM events)) GROUP BY gate")
def D04_router(spark, sf_dir):
    e, u, s = (F.col("event_id") % k for k in (3, 4, 5))
    return table(spark, sf_dir, "events").select(A.route(e, u, s).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT pmcid, chunk, level, max(agreement) AS agreement, max(n_eligible) AS n_eligible, bool_or(polarity_conflict) AS polarity_conflict FROM {DECISIONS} GROUP BY ALL), d AS (SELECT pmcid, chunk, level, {DECIDE.format(t=0.9, r=0.2)} AS d FROM b),
w AS (SELECT pmcid, chunk, max(CASE WHEN level = 1 THEN d END) AS d1, max(CASE WHEN level = 2 THEN d END) AS d2 FROM d GROUP BY ALL)
SELECT level, decision, count(*) AS n FROM (SELECT CASE WHEN coalesce(d1, 'escalate') <> 'escalate' THEN 1 WHEN coalesce(d2, 'escalate') <> 'escalate' THEN 2 ELSE 3 END AS level, CASE WHEN coalesce(d1, 'escalate') <> 'escalate' THEN d1 WHEN coalesce(d2, 'escalate') <> 'escalate' THEN d2 ELSE 'keep' END AS decision FROM w) GROUP BY ALL""")
def D05_cascade_replay(spark, sf_dir):
    return A.cascade(decisions(spark, sf_dir), 0.9, 0.2).groupBy("level", "decision").agg(F.count("*").alias("n"))


@query(f"SELECT theta, reject, count(*) FILTER (d = 'keep') AS keep, count(*) FILTER (d = 'escalate') AS escalate, count(*) FILTER (d = 'reject') AS rejected FROM (SELECT theta, reject, {DECIDE.format(t='theta', r='reject')} AS d FROM {DECISIONS}, (VALUES (0.3::DOUBLE), (0.6), (0.9)) AS t(theta), (VALUES (0.0::DOUBLE), (0.2), (0.4)) AS r(reject) WHERE reject < theta) GROUP BY ALL")
def D06_D10_sweep(spark, sf_dir):
    return A.sweep(decisions(spark, sf_dir), [0.3, 0.6, 0.9], [0.0, 0.2, 0.4])


@query("SELECT t AS theta, count(*) FILTER (score >= t) AS kept, coalesce(round(count(*) FILTER (score >= t AND quality = 1) / nullif(count(*) FILTER (score >= t), 0), 6), 0.0) AS precision, round(count(*) FILTER (score >= t AND quality = 1) / count(*) FILTER (quality = 1), 6) AS recall, round(count(*) FILTER (score >= t AND quality = 0) / count(*) FILTER (quality = 0), 6) AS far, round(count(*) FILTER (score >= t) / count(*), 6) AS keep_rate FROM (SELECT quality, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)), (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) AS g(t) GROUP BY t")
def D07_D09_D12_threshold_metrics(spark, sf_dir):
    return A.threshold_metrics(_scored(spark, sf_dir), "score", "quality", [0.1, 0.3, 0.5, 0.7, 0.9])


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("""WITH s AS (SELECT quality = 1 AS good, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
m AS (SELECT t / 20.0::DOUBLE AS theta, count(*) FILTER (score >= t / 20.0::DOUBLE) AS kept, count(*) FILTER (score >= t / 20.0::DOUBLE AND good) AS tp, count(*) FILTER (good) AS pos, count(*) FILTER (NOT good) AS neg, count(*) AS n FROM s, range(1, 20) AS g(t) GROUP BY t),
r AS (SELECT theta, kept, coalesce(round(tp / nullif(kept, 0), 6), 0.0) AS precision, coalesce(round(tp / nullif(pos, 0), 6), 0.0) AS recall, coalesce(round((kept - tp) / nullif(neg, 0), 6), 0.0) AS far, round(kept / n, 6) AS keep_rate FROM m)
SELECT *, CASE WHEN far <= 0.5 AND recall >= 0.3 THEN 0 WHEN far <= 0.5 THEN 1 ELSE 2 END AS tier FROM r ORDER BY tier, CASE WHEN tier = 2 THEN far ELSE -theta END, theta LIMIT 1""")
def O08_select_theta(spark, sf_dir):
    return A.select_theta(A.threshold_metrics(_scored(spark, sf_dir), "score", "quality", [x / 20 for x in range(1, 20)]), 0.5, 0.3)


@query("SELECT model, temperature, level, level > min(level) OVER (PARTITION BY model, temperature) AS reused FROM (SELECT DISTINCT event_id % 4 AS model, user_id % 3 AS temperature, CAST(event_id % 3 + 1 AS INTEGER) AS level FROM events)")
def D14_voter_reuse(spark, sf_dir):
    v = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("model"), (F.col("user_id") % 3).alias("temperature"), (F.col("event_id") % 3 + 1).cast("int").alias("level")).distinct()
    return A.next_level_voters(v)


GREEDY = f"""p AS (SELECT case_id, a, b, similarity FROM {SIM} WHERE similarity > 0.05),
g AS (SELECT DISTINCT case_id, []::BIGINT[] AS ua, []::BIGINT[] AS ub, {{{{'s': 0.0::DOUBLE, 'a': 0::BIGINT, 'b': 0::BIGINT}}}} AS m FROM p
 UNION ALL SELECT case_id, list_append(ua, -m.a), list_append(ub, -m.b), m FROM (SELECT g.case_id, g.ua, g.ub, max({{{{'s': p.similarity, 'a': -p.a, 'b': -p.b}}}}) AS m FROM g JOIN p ON p.case_id = g.case_id AND NOT list_contains(g.ua, p.a) AND NOT list_contains(g.ub, p.b) GROUP BY ALL)),
matched AS (SELECT case_id, -m.a AS a, -m.b AS b, m.s AS similarity FROM g WHERE len(ua) > 0)""".replace("{{", "{").replace("}}", "}")


GREEDY_OF_VOTERS = GREEDY.replace(f"SELECT case_id, a, b, similarity FROM {SIM} WHERE", f"SELECT x.case_id * 10 + c.voter AS case_id, a, b, similarity FROM {SIM} x JOIN {CLAIMS} c ON c.vec_id = x.b WHERE").replace("matched AS (SELECT case_id,", "matched AS (SELECT case_id % 10 AS voter,")


@query("""WITH v AS (SELECT user_id % 25 AS paper, event_id % 4 AS voter, count(*) AS n, CAST(sum(event_id % 10) AS BIGINT) AS t FROM events GROUP BY ALL), w AS (SELECT paper, count(*) AS k, sum(n) AS n, sum(t) AS t FROM v GROUP BY paper)
SELECT v.paper, v.voter AS without, w.k - 1 AS voters, CAST(w.n - v.n AS BIGINT) AS n, CAST(w.t - v.t AS BIGINT) AS total FROM v JOIN w USING (paper)""")
def D13_leave_one_out(spark, sf_dir):
    k = F.col("event_id")
    return A.leave_one_out(table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("paper"), (k % 4).alias("voter"), (k % 10).alias("x")), ["paper"], "voter", "x")


@query(f"WITH RECURSIVE {GREEDY_OF_VOTERS}, n AS (SELECT voter, count(*) AS n FROM {CLAIMS} WHERE side = 'P' GROUP BY voter), s AS (SELECT count(*) AS gold FROM {CLAIMS} WHERE side = 'S'), t AS (SELECT voter, count(*) AS tp FROM matched GROUP BY voter) SELECT voter, n, gold, coalesce(tp, 0) AS tp, round(2 * coalesce(tp, 0) / (n + gold), 4) AS f1 FROM n JOIN s ON true LEFT JOIN t USING (voter)")
def D15_single_model_baselines(spark, sf_dir):
    """Each voter's claims alone against the silver ones."""
    c = claims(spark, sf_dir)
    pairs = _pairs(spark, sf_dir).join(c.where("side = 'P'").select(F.col("vec_id").alias("b"), "voter"), "b")
    alone = pairs.withColumn("case_id", F.col("case_id") * 10 + F.col("voter"))
    tp = M.match(alone, "greedy", 0.05).groupBy((F.col("case_id") % 10).cast("int").alias("voter")).agg(F.count("*").alias("tp"))
    gold = c.where("side = 'S'").agg(F.count("*").alias("gold"))
    n = c.where("side = 'P'").groupBy("voter").agg(F.count("*").alias("n"))
    tp0 = F.coalesce("tp", F.lit(0))
    return n.join(F.broadcast(gold), F.lit(True)).join(tp, "voter", "left").select("voter", "n", "gold", tp0.alias("tp"), F.round(2 * tp0 / (F.col("n") + F.col("gold")), 4).alias("f1"))  # one row of gold


@query(f"WITH RECURSIVE {GREEDY} SELECT case_id, a, b, round(similarity, 5) AS similarity FROM matched")
def M01_greedy_match(spark, sf_dir):
    return M.match(_pairs(spark, sf_dir), "greedy", 0.05).withColumn("similarity", F.round("similarity", 5))


@query()
def M02_optimal_match(spark, sf_dir):
    return M.match(_pairs(spark, sf_dir), "optimal", 0.05).withColumn("similarity", F.round("similarity", 5))


FIELDS = ["category", "voter", "note"]
_NOTE = "CASE WHEN {v} % 3 = 0 THEN ' Seen' WHEN {v} % 3 = 1 THEN 'seen ' END"


def _assembled(spark, sf_dir):
    c = claims(spark, sf_dir).withColumnRenamed("vec_id", "id").withColumn("note", F.when(F.col("id") % 3 == 0, " Seen").when(F.col("id") % 3 == 1, "seen "))
    return M.assemble(M.match(_pairs(spark, sf_dir), "greedy", 0.05), c.where("side = 'S'"), c.where("side = 'P'"), FIELDS)


ASSEMBLED = f"""WITH RECURSIVE {GREEDY}, c AS (SELECT *, {_NOTE.format(v='vec_id')} AS note FROM {CLAIMS}),
x AS (SELECT m.case_id, 'matched' AS status, m.a, m.b, m.similarity, list_filter([CASE WHEN trim(lower(CAST(s.category AS VARCHAR))) <> trim(lower(CAST(p.category AS VARCHAR))) THEN 'category' END, CASE WHEN s.voter <> p.voter THEN 'voter' END, CASE WHEN trim(lower(s.note)) <> trim(lower(p.note)) THEN 'note' END], lambda f: f IS NOT NULL) AS mismatched
 FROM matched m JOIN c s ON s.vec_id = m.a JOIN c p ON p.vec_id = m.b
 UNION ALL SELECT case_id, 'unmatched_silver', vec_id, NULL, NULL, [] FROM c WHERE side = 'S' AND vec_id NOT IN (SELECT a FROM matched)
 UNION ALL SELECT case_id, 'unmatched_pipeline', NULL, vec_id, NULL, [] FROM c WHERE side = 'P' AND vec_id NOT IN (SELECT b FROM matched))"""


@query(f"{ASSEMBLED} SELECT case_id, status, a, b, round(similarity, 5) AS similarity, array_to_string(mismatched, ',') AS mismatched FROM x")
def M03_match_assembly(spark, sf_dir):
    return _assembled(spark, sf_dir).withColumn("similarity", F.round("similarity", 5)).withColumn("mismatched", F.array_join("mismatched", ","))


@query(f"""{ASSEMBLED}, t AS (SELECT case_id, count(a) AS n_silver, count(b) AS n_pipeline, count(*) FILTER (status = 'matched') AS n_matched, avg(similarity) AS s, coalesce(sum(CASE WHEN status = 'matched' THEN CASE WHEN list_contains(mismatched, 'category') THEN 0.5 ELSE 1.0 END END), 0) AS c, sum(len(mismatched)) AS k FROM x GROUP BY case_id)
SELECT case_id, n_silver, n_pipeline, n_matched, round(coalesce(n_matched / nullif(n_pipeline, 0), 0), 4) AS precision, round(coalesce(n_matched / nullif(n_silver, 0), 0), 4) AS recall, round(2 * n_matched / (n_silver + n_pipeline), 4) AS f1, round(coalesce(s, 0), 4) AS avg_similarity, round(2 * c / (n_silver + n_pipeline), 4) AS strict_f1, CAST(k AS BIGINT) AS n_mismatches FROM t""")
def A49_match_metrics(spark, sf_dir):
    return M.metrics(_assembled(spark, sf_dir), ["category"], "case_id")


@query(f"""WITH RECURSIVE e AS (SELECT rule_id_a AS a, rule_id_b AS b FROM {RELATIONS} UNION SELECT rule_id_b, rule_id_a FROM {RELATIONS}), w(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node)
SELECT node, min(root) AS root FROM w GROUP BY node""")
def G01_connected_components(spark, sf_dir):
    return G.connected_components(R.relations(findings(spark, sf_dir)).select(F.col("rule_id_a").alias("a"), F.col("rule_id_b").alias("b")))


@query(f"SELECT node, count(*) AS degree FROM (SELECT rule_id_a AS node FROM {RELATIONS} UNION ALL SELECT rule_id_b FROM {RELATIONS}) GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def A33_O02_hubs(spark, sf_dir):
    e = R.relations(findings(spark, sf_dir)).select(F.col("rule_id_a").alias("a"), F.col("rule_id_b").alias("b"))
    return G.degrees(e).orderBy(F.desc("degree"), "node").limit(20)


BOX = "(SELECT l_linenumber % 2 AS kind, l_orderkey // 50 AS doc, l_partkey % 3 AS page, l_orderkey * 1000003 + l_partkey * 101 + l_suppkey * 11 + l_linenumber AS id, l_quantity * 8 AS x1, l_quantity * 8 + l_tax * 2000 + 10 AS x2, CAST(l_suppkey * 5 AS DOUBLE) AS y1, l_suppkey * 5.0 + l_discount * 900 + 5 AS y2 FROM lineitem)"


def _boxes(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_linenumber") % 2).alias("kind"), F.floor(c("l_orderkey") / 50).alias("doc"), (c("l_partkey") % 3).alias("page"), (c("l_orderkey") * 1000003 + c("l_partkey") * 101 + c("l_suppkey") * 11 + c("l_linenumber")).alias("id"),
        (c("l_quantity") * 8).alias("x1"), (c("l_quantity") * 8 + c("l_tax") * 2000 + 10).alias("x2"), (c("l_suppkey") * 5.0).alias("y1"), (c("l_suppkey") * 5.0 + c("l_discount") * 900 + 5).alias("y2"),
    )


OVERLAP = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"SELECT DISTINCT a.id FROM {BOX} a JOIN {BOX} b ON a.doc = b.doc AND a.page = b.page WHERE a.kind = 0 AND b.kind = 1 AND {OVERLAP} >= 0.8 * (a.x2 - a.x1) * (a.y2 - a.y1)")
def F18_F19_tables_in_figures(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return L.inside_one(b.where("kind = 0"), b.where("kind = 1"))


@query(f"SELECT DISTINCT b.id FROM {BOX} a JOIN {BOX} b ON a.doc = b.doc AND a.page = b.page WHERE a.id < b.id AND {OVERLAP} > 0.5 * least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))")
def J14_V08_duplicate_boxes(spark, sf_dir):
    return L.duplicates(_boxes(spark, sf_dir))


@query(f"SELECT a.id AS m_id, arg_min(b.id, (least(abs(a.y1 - b.y2), abs(b.y1 - a.y2)), b.id)) AS c_id, min(least(abs(a.y1 - b.y2), abs(b.y1 - a.y2))) AS distance FROM {BOX} a JOIN {BOX} b ON a.doc = b.doc AND a.page = b.page WHERE a.kind = 0 AND b.kind = 1 GROUP BY a.id")
def J13_nearest_caption(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return L.nearest_caption(b.where("kind = 0"), b.where("kind = 1"))


@query(f"SELECT doc, page, max(y2) AS top, min(y1) AS bottom FROM {BOX} WHERE y2 - y1 >= 15 GROUP BY doc, page")
def A54_anchor_bounds(spark, sf_dir):
    return L.anchor_bounds(_boxes(spark, sf_dir))


_ELEMENT = f"(SELECT *, CASE WHEN id % 4 = 0 THEN 'LIST_ITEM' ELSE 'TEXT' END AS type, CASE id % 5 WHEN 0 THEN '12.3' WHEN 1 THEN 'Received: 1 May' WHEN 2 THEN NULL ELSE 'words of text' END AS text FROM {BOX})"


def _elements(spark, sf_dir):
    i = F.col("id")
    text = F.when(i % 5 == 0, "12.3").when(i % 5 == 1, "Received: 1 May").when(i % 5 == 2, F.lit(None)).otherwise("words of text")
    return _boxes(spark, sf_dir).withColumn("type", F.when(i % 4 == 0, "LIST_ITEM").otherwise("TEXT")).withColumn("text", text)


@query(f"""WITH t AS (SELECT doc, page, max(y2) AS top, min(y1) AS bottom FROM {BOX} WHERE y2 - y1 >= 60 GROUP BY doc, page)
SELECT DISTINCT b.id FROM {_ELEMENT} b LEFT JOIN t USING (doc, page) WHERE NOT regexp_matches(trim(coalesce(text, '')), '[a-zA-Z]') OR regexp_matches(text, '^Received[: ]') OR (type = 'TEXT' AND y2 - y1 < 60 AND (y2 > top OR y1 < bottom))""")
def F02_artifacts(spark, sf_dir):
    return L.artifacts(_elements(spark, sf_dir), 60.0).distinct()


@query(f"""WITH e AS (SELECT *, lead(x1) OVER (PARTITION BY doc ORDER BY x1, id) AS nx FROM {_ELEMENT} WHERE y2 - y1 >= 60), g AS (SELECT doc, min((x1, id, nx)) AS first, CASE WHEN count(*) > 1 THEN max(x1) END AS r FROM e WHERE nx - x1 > 40 GROUP BY doc),
s AS (SELECT b.*, x2 - x1 < 90 AND (coalesce(x2 < struct_extract_at(first, 3), false) OR coalesce(x1 > r, false)) AS side FROM {_ELEMENT} b LEFT JOIN g USING (doc)),
t AS (SELECT doc, page, max(y2) AS top, min(y1) AS bottom FROM s WHERE NOT side AND y2 - y1 >= 60 GROUP BY doc, page)
SELECT doc, page, kind, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 3) AS area FROM (SELECT doc, page, 'sidebar' AS kind, x1, y1, x2, y2 FROM s WHERE side AND trim(coalesce(text, '')) <> ''
 UNION ALL SELECT doc, page, 'header', 0, top, CASE WHEN page = 0 THEN 600.0 ELSE 595.0 END, CASE WHEN page = 0 THEN 900.0 ELSE 842.0 END FROM t WHERE top < CASE WHEN page = 0 THEN 900.0 ELSE 842.0 END UNION ALL SELECT doc, page, 'footer', 0, 0, CASE WHEN page = 0 THEN 600.0 ELSE 595.0 END, bottom FROM t WHERE bottom > 0) GROUP BY doc, page, kind""")
def W19_masks(spark, sf_dir):
    e = _elements(spark, sf_dir)
    pages = e.where("page = 0").select("doc", "page").distinct().select("doc", "page", F.lit(600.0).alias("width"), F.lit(900.0).alias("height"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return L.masks(e, pages, 40.0, 90.0, 60.0).groupBy("doc", "page", "kind").agg(F.count("*").alias("n"), F.round(F.sum(area), 3).alias("area"))


@query()
def W16_footnotes(spark, sf_dir):
    i = F.col("id")
    kind = F.when(i % 9 == 0, "TABLE").when(i % 3 == 1, "FOOTNOTE").when(i % 3 == 2, "LIST_ITEM").otherwise("TEXT")
    return L.with_footnotes(_boxes(spark, sf_dir).withColumn("page", F.col("page").cast("long")).withColumn("type", kind).withColumn("rotated", i % 2 == 0))


@query()
def W17_captioned_figures(spark, sf_dir):
    i = F.col("id")
    kind = F.when(i % 5 == 0, "CAPTION").when(i % 5 == 1, "PICTURE").when(i % 5 == 2, "FIGURE").otherwise("TEXT")
    text = F.when(i % 10 == 0, F.concat(F.lit("Figure "), (i % 7).cast("string"), F.lit(". Cells"))).otherwise("A caption")
    return L.captioned_figures(_boxes(spark, sf_dir).withColumn("page", F.col("page").cast("long")).withColumn("type", kind).withColumn("text", text))


@query("""SELECT rule, count(*) AS n, count(*) FILTER (top) AS in_header FROM (SELECT CASE WHEN l_returnflag = 'N' THEN NULL WHEN trim(t) = '' THEN 'R0' WHEN l_tax * 10 > 0.7 THEN 'R-color' WHEN abs(y1 - y2) > 0 AND length(trim(t)) / abs(y1 - y2) > 15 THEN 'R3'
 WHEN l_linenumber <> 7 AND l_linestatus = 'O' THEN 'R1' WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 AND l_discount < 0.05 AND length(trim(t)) >= 8 THEN 'R2' END AS rule, (842.0 - greatest(y1, y2)) / 842.0 <= 0.15 AS top
 FROM (SELECT *, CASE WHEN l_quantity > 48 THEN ' ' ELSE repeat('x', CAST(l_quantity AS INTEGER)) END AS t, 800.0 - l_suppkey % 400 AS y1, 800.0 - l_suppkey % 400 - l_partkey % 4 AS y2 FROM lineitem)) GROUP BY rule""")
def F20_node_scorer(spark, sf_dir):
    c = F.col
    y1 = 800.0 - c("l_suppkey") % 400
    e = table(spark, sf_dir, "lineitem").select(
        F.when(c("l_returnflag") == "N", "TABLE").otherwise("PARAGRAPH").alias("type"), F.when(c("l_quantity") > 48, " ").otherwise(F.repeat(F.lit("x"), c("l_quantity").cast("int"))).alias("text"), y1.alias("y1"), (y1 - c("l_partkey") % 4).alias("y2"),
        (c("l_tax") * 10).alias("white"), (c("l_linenumber") != 7).alias("rendered"), (c("l_linestatus") == "O").alias("blank"), (c("l_suppkey") % 3).alias("n_words"), c("l_discount").alias("coverage"),
    )
    return e.select(L.node_score(most_white=0.7).alias("rule"), L.in_header_zone(F.lit(842.0)).alias("top")).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("top").alias("in_header"))


@query()
def W18_merge_boxes(spark, sf_dir):
    return L.merge_boxes(_boxes(spark, sf_dir).withColumn("page", F.col("page").cast("long")))


@query(f"""WITH t AS (SELECT te_id // 100000 AS doc, pos, text, CASE pos % 5 WHEN 4 THEN 'table' ELSE 'narrative' END AS kind, pos % 3 = 1 OR pos % 7 = 2 AS cut FROM {TEXT_ELEMENTS}),
n AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc ORDER BY pos), false) AS taken FROM t WHERE kind = 'narrative'),
c AS (SELECT *, sum(CASE WHEN taken THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chain FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY doc, chain ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc, chain) AS k FROM c),
s AS (SELECT doc, chain, pos, k, CASE WHEN i > 1 AND i < k THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') WHEN i < k THEN regexp_replace(text, '\\s+$', '') WHEN i > 1 THEN regexp_replace(text, '^\\s+', '') ELSE text END AS text FROM l)
SELECT doc, min(pos) AS pos, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (k = 1 OR trim(text) <> ''), '') AS text FROM s GROUP BY doc, chain UNION ALL SELECT doc, pos, text FROM t WHERE kind <> 'narrative'""")
def W09_stitch(spark, sf_dir):
    k = F.col("pos")
    te = text_elements(spark, sf_dir).select(F.floor(F.col("te_id") / 100000).cast("long").alias("doc"), "pos", "text", F.when(k % 5 == 4, "table").otherwise("narrative").alias("kind"), ((k % 3 == 1) | (k % 7 == 2)).alias("cut"))
    return L.stitch(te)


@query()
def W15_table_rows(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("doc", F.col("page").cast("long").alias("page"), F.col("y1").alias("y"), F.when(F.col("id") % 7 == 0, "caption").otherwise("row").alias("kind"))
    return L.expand_rows(b, 12.0)


@query("SELECT l_orderkey // 50 AS doc, count(*) FILTER (l_linenumber % 3 = 0) AS texts, count(*) FILTER (l_linenumber % 3 = 1) AS figures, count(*) FILTER (l_linenumber % 3 = 2) AS tables, CAST(sum(800 - l_suppkey * 5) AS DOUBLE) AS flipped FROM lineitem GROUP BY 1")
def F27_V09_roles(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 50).alias("doc")).agg(F.count_if(k == 0).alias("texts"), F.count_if(k == 1).alias("figures"), F.count_if(k == 2).alias("tables"), F.round(F.sum(800 - F.col("l_suppkey") * 5.0), 3).alias("flipped"))


PAPERS = "(SELECT c_custkey AS id, [CAST(c_nationkey AS VARCHAR), c_mktsegment] AS disease, ['g' || CAST(c_custkey % 17 AS VARCHAR), 'g' || CAST(c_custkey % 5 AS VARCHAR)] AS gene, ['m' || CAST(c_custkey // 8 AS VARCHAR)] AS method FROM customer)"


def _papers(spark, sf_dir):
    c, s = F.col("c_custkey"), (lambda p, x: F.concat(F.lit(p), x.cast("string")))
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.array(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("disease"), F.array(s("g", c % 17), s("g", c % 5)).alias("gene"), F.array(s("m", F.floor(c / 8))).alias("method"))


RELATED = f"""(SELECT a.id AS i, b.id AS j, round(0.30 * len(list_intersect(a.disease, b.disease)) / len(list_distinct(list_concat(a.disease, b.disease))) + 0.15 * len(list_intersect(list_distinct(a.gene), list_distinct(b.gene))) / len(list_distinct(list_concat(a.gene, b.gene)))
 + 0.06 * len(list_intersect(a.method, b.method)) / len(list_distinct(list_concat(a.method, b.method))) - CASE WHEN len(list_intersect(a.disease, b.disease)) = 0 THEN 0.10 ELSE 0.0 END, 6) AS score FROM {PAPERS} a JOIN {PAPERS} b ON a.method = b.method WHERE a.id < b.id)"""


@query(f"SELECT i, j, score FROM {RELATED}")
def V10_relatedness(spark, sf_dir):
    return Sel.related_pairs(_papers(spark, sf_dir), ["disease", "gene", "method"], "method")


@query(f"SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM (SELECT i, j, score FROM {RELATED} UNION ALL SELECT j, i, score FROM {RELATED}) WHERE score >= 0.05) WHERE r <= 2")
def O03_O04_top_neighbours(spark, sf_dir):
    return Sel.top_neighbours(Sel.related_pairs(_papers(spark, sf_dir), ["disease", "gene", "method"], "method"), 2, 0.05)


@query("""WITH p AS (SELECT doc_id, n_chars // 90 AS ns, n_chars // 300 AS ne, n_chars // 1000 AS nc, doc_id % 41 AS anchors, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0 END AS noise, doc_id FROM documents),
q AS (SELECT *, greatest(ns, 1) AS s, greatest(ne, 1) AS e FROM p),
c AS (SELECT *, least(doc_id % 90 / s / 4.0, 1) * 0.4 + least(doc_id % 50 / s / 1.5, 1) * 0.4 + least(doc_id % 9 / s / 0.5, 1) * 0.2 AS content,
 least(doc_id % 2 / e / 0.05, 1) * 0.3 + least(doc_id % 3 / e / 0.1, 1) * 0.2 + least(doc_id % 4 / e / 0.3, 1) * 0.25 + least(doc_id % 5 / e / 0.1, 1) * 0.25 AS lay, least(anchors / 30, 1) AS relation FROM q),
l AS (SELECT *, CASE WHEN noise IS NULL THEN lay ELSE lay * 0.9 + noise * 0.1 END AS layout FROM c)
SELECT doc_id, round(content + 1e-9, 6) AS content, round(layout + 1e-9, 6) AS layout, round(relation + 1e-9, 6) AS relation, round(0.45 * content + 0.25 * layout + 0.30 * relation + 1e-9, 6) AS normalised, round((0.45 * content + 0.25 * layout + 0.30 * relation) * ln(1 + nc) + 1e-9, 6) AS absolute FROM l""")
def V12_hardness(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id")
    counts = {"n_entities": 90, "n_unique": 50, "n_abbreviations": 9, "n_tables": 2, "n_captions": 3, "n_short": 4, "n_long": 5, "n_anchors": 41}
    p = table(spark, sf_dir, "documents").select("doc_id", F.floor(n / 90).alias("n_sentences"), F.floor(n / 300).alias("n_elements"), F.floor(n / 1000).alias("n_chunks"), F.when(i % 3 == 0, (i % 10) / 10.0).alias("noise"), *((i % k).alias(c) for c, k in counts.items()))
    return Sel.hardness(p).select("doc_id", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("content", "layout", "relation", "normalised", "absolute")))


@query("SELECT c_mktsegment, count(DISTINCT n) AS concepts, round(sum(1.0 / f), 6) AS bonus FROM (SELECT c_mktsegment, c_nationkey AS n, count(*) OVER (PARTITION BY c_nationkey) AS f FROM customer) GROUP BY c_mktsegment")
def U05_U06_coverage(spark, sf_dir):
    freq = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("f"))
    return table(spark, sf_dir, "customer").join(freq, "c_nationkey").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("concepts"), F.round(F.sum(1.0 / F.col("f")), 6).alias("bonus"))


@query("SELECT policy, cost, quality FROM (SELECT p_brand AS policy, round(avg(p_retailprice), 4) AS cost, round(avg(p_size), 4) AS quality FROM part GROUP BY p_brand) WHERE cost <= 100000 AND quality >= 10 ORDER BY quality DESC, cost, policy LIMIT 1")
def O18_choose_policy(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("policy")).agg(F.round(F.avg("p_retailprice"), 4).alias("cost"), F.round(F.avg("p_size"), 4).alias("quality"))
    return Sel.choose_policy(m, 100000, 10)


SETS = ["disease", "gene", "method"]


def _pool(spark, sf_dir, limit):
    """The papers that a choice looks at: of all customers the most telling ones for their length."""
    papers = _papers(spark, sf_dir).withColumn("length", F.col("id") % 300 + 40)
    return Sel.pool(papers, SETS, (F.size("disease") + F.size(F.array_distinct("gene"))) / F.log1p(F.col("length") + 10), limit)


@query(f"""WITH p AS (SELECT * FROM (SELECT *, disease[1] AS nation, row_number() OVER (PARTITION BY disease[1] ORDER BY id) AS r FROM {PAPERS}) WHERE r <= 4),
c AS (SELECT nation, count(*) AS n, 0.30 * len(list_distinct(flatten(list(disease)))) / (3 * count(*)) + 0.20 * len(list_distinct(flatten(list(method)))) / (2 * count(*)) AS cover FROM p GROUP BY nation),
r AS (SELECT a.nation, 0.30 * len(list_intersect(a.disease, b.disease)) / len(list_distinct(list_concat(a.disease, b.disease))) + 0.15 * len(list_intersect(list_distinct(a.gene), list_distinct(b.gene))) / len(list_distinct(list_concat(a.gene, b.gene))) + 0.06 * len(list_intersect(a.method, b.method)) / len(list_distinct(list_concat(a.method, b.method))) AS s FROM p a JOIN p b ON a.nation = b.nation AND a.id < b.id),
q AS (SELECT nation, avg(s) AS mean, count(*) FILTER (s >= 0.65) AS near FROM r GROUP BY nation)
SELECT nation, n, round(cover - coalesce(0.40 * mean + 0.20 * near, 0) + 1e-9, 6) AS diversity FROM c LEFT JOIN q USING (nation)""")
def V11_diversity(spark, sf_dir):
    """The diversity of every nation's papers that a choice would look at first."""
    papers = _papers(spark, sf_dir)
    nations = papers.withColumn("nation", F.col("disease")[0]).withColumn("r", F.row_number().over(Window.partitionBy("nation").orderBy("id"))).where("r <= 4").collect()  # four papers a nation: a top-k
    of = {}
    for r in nations:
        of.setdefault(r["nation"], []).append({s: set(r[s]) for s in SETS})
    return spark.createDataFrame([(n, len(p), round(Sel.diversity(p) + 1e-9, 6)) for n, p in of.items()], "nation string, n long, diversity double")


@query()
def O14_greedy_related(spark, sf_dir):
    chosen = Sel.greedy_related(_pool(spark, sf_dir, 150), 5)
    return spark.createDataFrame(list(enumerate(chosen)), "rank long, id long")


@query()
def O15_greedy_diverse(spark, sf_dir):
    papers = _pool(spark, sf_dir, 150)
    chosen = Sel.greedy_diverse(papers, 5, {i: i % 300 + 40 for i in papers})
    return spark.createDataFrame(list(enumerate(chosen)), "rank long, id long")


@query()
def O16_calibration_set(spark, sf_dir):
    """Five related, five diverse and five hard papers, none twice."""
    papers = _pool(spark, sf_dir, 150)
    related = Sel.greedy_related(papers, 5)
    diverse = Sel.greedy_diverse({i: p for i, p in papers.items() if i not in related}, 5)
    hard = Sel.hard_set({i: (i % 97 / 97, i % 97 / 97 * (i % 13)) for i in papers if i not in related + diverse})
    return spark.createDataFrame([(kind, k, i) for kind, ids in (("related", related), ("diverse", diverse), ("hard", hard)) for k, i in enumerate(ids)], "kind string, rank long, id long")


@query()
def O17_exact_selection(spark, sf_dir):
    papers = _pool(spark, sf_dir, 40)
    worth = {i: 0.05 * sum(min(len(x) / 5, 0.2) for x in p.values()) - 0.02 * min((i % 300 + 40) / 350, 2) for i, p in papers.items()}
    ids, status = Sel.exact_related(papers, 5, worth=worth)
    return spark.createDataFrame([(status, i) for i in ids], "status string, id long")


@query()
def B01_bootstrap(spark, sf_dir):
    """Strict F1 over 1,000 resamples of the cases: bounds at int(p * (n - 1)) of the sorted values."""
    case = claims(spark, sf_dir).groupBy("case_id").agg(F.count_if(F.col("side") == "S").alias("s"), F.count_if(F.col("side") == "P").alias("p"))
    hit = M.match(_pairs(spark, sf_dir), "greedy", 0.05).groupBy("case_id").agg(F.count("*").alias("tp"))
    c = case.join(hit, "case_id", "left").fillna(0, ["tp"]).withColumnRenamed("case_id", "slot")
    b = St.bootstrap(c, "slot", ["tp", "s", "p"], 1000, c.count(), 5).withColumn("f1", F.round(2 * F.col("tp") / (F.col("s") + F.col("p")), 9)).withColumn("all", F.lit(1))
    low = St.nth_percentile(b, ["all"], "f1", St.lower_rank(0.025), "iter").select(F.lit("low").alias("bound"), "f1")
    return low.union(St.nth_percentile(b, ["all"], "f1", St.lower_rank(0.975), "iter").select(F.lit("high").alias("bound"), "f1"))


@query()
def B02_paired_bootstrap(spark, sf_dir):
    """All voters against the first one alone, by paper (a twelfth of the cases), 10,000 draws."""
    paper = (F.col("case_id") % 12).alias("paper")
    c = claims(spark, sf_dir)
    first = c.where("side = 'P' AND voter = 0").select(F.col("vec_id").alias("b"))
    pairs = _pairs(spark, sf_dir)
    tp = lambda p, name: M.match(p, "greedy", 0.05).groupBy(paper).agg(F.count("*").alias(name))
    n = c.groupBy(paper).agg(F.count_if(F.col("side") == "P").alias("a_n"), F.count_if((F.col("side") == "P") & (F.col("voter") == 0)).alias("b_n"), F.count_if(F.col("side") == "S").alias("gold"))
    return St.paired_bootstrap(n.join(tp(pairs, "a_tp"), "paper", "left").join(tp(pairs.join(first, "b", "left_semi"), "b_tp"), "paper", "left").fillna(0, ["a_tp", "b_tp"]))


@query(f"SELECT voter, count(*) AS n, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, round(min(m), 4) AS least FROM (SELECT s.voter, s.vec_id, max({COS.format(a='s.embedding', b='p.embedding')}) AS m FROM {CLAIMS} s JOIN {CLAIMS} p ON s.case_id = p.case_id WHERE s.side = 'S' AND p.side = 'P' GROUP BY s.voter, s.vec_id) GROUP BY voter")
def Y07_family_bias(spark, sf_dir):
    voter = claims(spark, sf_dir).select(F.col("vec_id").alias("a"), "voter")
    best = _pairs(spark, sf_dir).groupBy("a").agg(F.max("similarity").alias("m")).join(voter, "a")
    return best.groupBy("voter").agg(F.count("*").alias("n"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("std"), F.round(F.min("m"), 4).alias("least"))


@query("SELECT label, count(*) AS n, count(*) FILTER (d > 1) AS duplicates, count(*) FILTER (vec_id % 5 = 0) AS test FROM (SELECT label, vec_id, count(*) OVER (PARTITION BY vec_id) AS d FROM embeddings) GROUP BY label")
def D16_dataset_checks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    per = e.groupBy("vec_id").agg(F.count("*").alias("d"))
    return e.join(per, "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 1).alias("duplicates"), F.count_if(F.col("vec_id") % 5 == 0).alias("test"))
