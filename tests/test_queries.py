"""Every query of the library beside its SQL, or a plain version of it in Python, on the smallest data directory."""

import re
from collections import defaultdict
from difflib import SequenceMatcher
from functools import cache, reduce
from pathlib import Path

import duckdb
import pytest
from compare import rows_of

from corvella.functions.text import CITATIONS
from corvella.operators import rules as R
from corvella.plans import QUERIES, SQL
from corvella.plans.decisions import SIM, TEXT_ELEMENTS
from corvella.sources.domain import CLAIMS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def by_case(con):
    cases = defaultdict(dict)
    for case, a, b, x in con.sql(f"SELECT * FROM {SIM}").fetchall():
        cases[case][a, b] = x
    return cases


def best_total(similarity, threshold):
    """The largest total similarity of a one-to-one assignment over all pairs, less pairs up to the threshold afterwards: (total, pairs) by exhaustive search."""
    rows, cols = (sorted({k[i] for k in similarity}) for i in (0, 1))
    if len(rows) > len(cols):
        total, pairs = best_total({(b, a): x for (a, b), x in similarity.items()}, threshold)
        return total, {(b, a) for a, b in pairs}

    @cache
    def best(i, used):
        if i == len(rows):
            return 0.0, ()
        return max(((similarity[rows[i], c] + (rest := best(i + 1, used | 1 << j))[0], ((rows[i], c), *rest[1])) for j, c in enumerate(cols) if not used >> j & 1), key=lambda x: x[0])

    pairs = {p for p in best(0, 0)[1] if similarity[p] > threshold}
    return sum(similarity[p] for p in pairs), pairs


def optimal_match(con):
    return [(c, a, b, round(s[a, b], 5)) for c, s in by_case(con).items() for a, b in best_total(s, 0.05)[1]]


def optimal_f1(con):
    size = dict(con.sql(f"SELECT case_id, count(*) FROM {CLAIMS} GROUP BY case_id").fetchall())
    return [(c, round(2 * best_total(s, 0.0)[0] / size[c], 5)) for c, s in by_case(con).items()]


def verbatim(con):
    found = defaultdict(list)
    for te_id, text in con.sql(f"SELECT te_id, text FROM {TEXT_ELEMENTS}").fetchall():
        quote = (text[4:44] if te_id % 2 == 0 else text[:40][::-1]).lower().strip(" ")
        source = text.lower().strip(" ")
        ratio = 1.0 if quote in source else round(SequenceMatcher(None, quote, source).ratio(), 6)
        found["FABRICATED" if ratio < 0.25 else "WEAK" if ratio < 0.6 else "ok"].append(ratio)
    return [(k, len(v), round(sum(v) / len(v), 6)) for k, v in found.items()]


def without_citations(con):
    cut = [(re.compile(p, re.ASCII), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in CITATIONS]
    rows = con.sql(f"SELECT te_id, text || ' [1,2] ends. 14 Next, 5 more 1,2 .' FROM {TEXT_ELEMENTS}").fetchall()
    return [(i, reduce(lambda t, c: c[0].sub(c[1], t), cut, t)) for i, t in rows]


BOXES = "SELECT l_orderkey // 50, l_partkey % 3, l_orderkey * 1000003 + l_partkey * 101 + l_suppkey * 11 + l_linenumber, l_quantity * 8, CAST(l_suppkey * 5 AS DOUBLE), l_quantity * 8 + l_tax * 2000 + 10, l_suppkey * 5.0 + l_discount * 900 + 5 FROM lineitem"


def united(con):
    pages = defaultdict(list)
    for doc, page, _, *box in con.sql(BOXES).fetchall():
        pages[doc, page].append(tuple(box))
    out = []
    for at, boxes in pages.items():
        boxes = set(boxes)
        while pair := next(((p, q) for p in boxes for q in boxes if p != q and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]), None):
            p, q = pair
            boxes = boxes - {p, q} | {(min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))}
        out += [(*at, *b) for b in boxes]
    return out


def rebuilt(con):
    pages = defaultdict(list)
    for doc, page, i, _, y, *_ in con.sql(BOXES).fetchall():
        pages[doc, page].append((y, i % 7 == 0))
    out = []
    for at, rows in pages.items():
        table, ys = 0, []
        for y, caption in sorted(rows, key=lambda r: (-r[0], not r[1])):
            if caption:
                table, ys = table + 1, [y]
            elif ys:
                gaps = [a - b for a, b in zip(ys, ys[1:], strict=False)]
                if ys[-1] - y <= max(12.0, 1.5 * sum(gaps) / len(gaps) if gaps else 0):
                    ys.append(y)
                    out.append((*at, table, y))
                else:
                    ys = []
    return out


#: Queries that SQL can't express, as plain Python: rows in the order of the columns named.
PLAIN = {
    "M02_optimal_match": (["case_id", "a", "b", "similarity"], optimal_match), "V03_optimal_f1": (["case_id", "f1"], optimal_f1), "F15_verbatim_ratio": (["code", "n", "mean"], verbatim),
    "T02_remove_citations": (["te_id", "cleaned"], without_citations), "W18_merge_boxes": (["doc", "page", "x1", "y1", "x2", "y2"], united),
    "W15_table_rows": (["doc", "page", "table", "y"], rebuilt),
}


def test_bootstrap_bounds_enclose_the_whole(spark, con):
    """The bounds repeat from run to run and hold the F1 of all cases between them."""
    runs = [{r["bound"]: r["f1"] for r in QUERIES["B01_bootstrap"](spark, SF).collect()} for _ in range(2)]
    tp = con.sql("SELECT count(*) FROM (" + SQL["M01_greedy_match"] + ")").fetchall()[0][0]
    n = con.sql(f"SELECT count(*) FROM {CLAIMS}").fetchall()[0][0]
    assert runs[0] == runs[1] and runs[0]["low"] < 2 * tp / n < runs[0]["high"]
    paired = QUERIES["B02_paired_bootstrap"](spark, SF).collect()[0]
    assert paired["f1"] == round(2 * tp / n, 4) and paired["ci_low"] < paired["delta"] < paired["ci_high"]
    assert paired["delta"] == pytest.approx(paired["f1"] - paired["baseline_f1"], abs=2e-4) and paired["significant"] == (paired["ci_low"] > 0 or paired["ci_high"] < 0)


@pytest.mark.parametrize("step", [1, -1])
def test_top_rules_in_any_order_of_rows(spark, tmp_path, step):
    """Brand#1 has a mean of 0.5265625, halfway at six digits and once scored at four; sums of doubles end above or below it by their order. Keys may be null."""
    discounts = [(1, 0.05)] * 47 + [(1, 0.06)] * 17 + [(2, 0.052), (2, 0.053), (2, 0.053), (3, None), (4, None)]
    lines = [(i, part, None if part == 3 else 1, 3, 1.0, d, "R", "O") for i, (part, d) in enumerate(discounts)][::step]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k}", "PROMO", 1) for k in range(1, 5)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in QUERIES["O01_top_rules"](spark, str(tmp_path)).collect()}
    first = {part: f"FR_{min(o for o, p, *_ in lines if p == part) * 1000003 + part * 101 + 14}" for part in (1, 2, 4)}
    assert got == {(first[1], 1), (first[2], 2), (first[4], 3), (None, 4)}
    if step == 1:  # the order in which the SQL's doubles come out right
        c = duckdb.connect()
        for t in ("lineitem", "part"):
            c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        assert got == set(c.sql(SQL["O01_top_rules"]).fetchall())


def test_exact_mean_of_odd_scores(spark):
    rows = [("tie", x) for x in [0.6] * 17 + [0.5] * 47] + [("negative", -x) for x in [0.6] * 17 + [0.5] * 47] + [("null", None), ("some", None), ("some", 0.25), ("nan", float("nan")), ("nan", 0.5), ("inf", float("inf")), ("large", 123456.5), ("large", 0.5), ("fine", 0.12345678), ("fine", 0.5)]
    got = {r["k"]: r["x"] for r in spark.createDataFrame(rows, "k string, score double").coalesce(1).groupBy("k").agg(R.exact_mean("score").alias("x")).collect()}
    assert str(got.pop("nan")) == "nan"
    assert got == {"tie": 0.526563, "negative": -0.526563, "null": None, "some": 0.25, "inf": float("inf"), "large": 61728.5, "fine": 0.311728}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name in PLAIN:
        columns, plain = PLAIN[name]
        assert sorted(columns) == sorted(df.columns)
        assert [repr(x) for x in got] == [repr(x) for x in rows_of(columns, plain(con))]
    if name not in SQL:
        return
    r = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert [repr(x) for x in got] == [repr(x) for x in rows_of(r.columns, r.fetchall())]
