"""The pipeline's stages against brute force on a small corpus, and the registered queries beside their SQL."""

from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import rows_of

import corpus_pipeline
from corvella.llm import queries as Q
from corvella.llm.bpe import read_ranks
from corvella.llm.jaccard_join import shingle_sets
from corvella.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_beside_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df, r = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    assert sorted(df.columns) == sorted(r.columns)
    assert [repr(x) for x in got] == [repr(x) for x in rows_of(r.columns, r.fetchall())]


def test_every_query_has_ten_numbers():
    assert {int(n[2:].split("_")[0]) for n in Q.queries()} == set(range(1, 11))


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rejected = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
    left = {i: t for i, t in rows.items() if i not in rejected}
    largest = {t: i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if largest[t] == i}
    sets = {i: set(shingle_sets([t.encode()], 5)[0].tolist()) for i, t in left.items()}
    root = {i: i for i in left}
    ids, changed = sorted(left), True
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    left = {i: t for i, t in left.items() if root[i] == i}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    dirty = {r[0] for r in con.sql(f"select doc_id from ({Q.oracle_sql()['op1_decontamination']}) where contaminated").fetchall()}
    left = {i: t for i, t in left.items() if i not in dirty}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in left.items()}
    assert rejected and len(left) < len(rows) and np.all([len(v) for v in got.values()])


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, doc string, predicted int, contaminated boolean, kept boolean, text_hash long, id long, row long, words string, held_out string, hits string"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "d", 1, True, False, 7, 8, 9, "w", "h", "x") for i, t in rows], CLASHING).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    """Nulls, empty and very long texts, repeated ids and rows, and extra columns with names that operators use inside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, long), (5, long + " more"), (None, long + " end"), (6, "x")]
    got = stage(spark, awkward(spark, rows), SF)
    out = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] if "text" in got.columns else None) for r in got.collect()), key=repr)
    kept = {
        "toxicity": rows, "decontamination": rows, "exact_dedup": [(1, "a b c"), (1, "other words here"), (3, ""), (4, long), (5, long + " more"), (None, long + " end"), (6, "x")],
        # near copies of the long text: the null id ranks first; texts alike are a class of their own
        "ngram_jaccard": [(None, "a b c"), (1, "other words here"), (None, None), (2, None), (3, ""), (None, long + " end"), (6, "x")],
    }
    if name == "bpe":
        assert len(out) == len(rows)
    else:
        assert out == sorted(((i is None, i or 0, t) for i, t in kept[name]), key=repr)
        assert got.columns == awkward(spark, rows).columns
    assert stage(spark, awkward(spark, rows).limit(0), SF).count() == 0
