"""The queries of this subpackage: one thin opN_<name> for each operator, with the production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvella.llm.bpe import bpe_encode_decode
from corvella.llm.common import table
from corvella.llm.decontaminate import contamination_report, decontaminate
from corvella.llm.exact_dedup import exact_dedup
from corvella.llm.jaccard_join import jaccard_classes
from corvella.llm.line_dedup import line_dedup
from corvella.llm.sharding import shuffle_into_shards
from corvella.llm.substring_dedup import substring_dedup
from corvella.llm.suffix_dedup import suffix_dedup
from corvella.llm.toxicity import toxicity
from corvella.llm.url_filter import url_filter


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of `documents` lie in passages of `benchmark`."""
    return contamination_report(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates among `documents`, and how many documents each is linked to."""
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_hash", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each text of `documents` is toxic, as `labels` marks it."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("words")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of `documents` stay when of equal texts the one with the largest doc_id does."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` in strings of 100 bytes that occur earlier, removed."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents` in three-line windows that occur earlier, removed."""
    return line_dedup(table(spark, sf_dir, "documents")).drop("text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` in passages of 20 words that occur earlier, removed."""
    return substring_dedup(table(spark, sf_dir, "documents")).drop("text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` as ids of a byte-level vocabulary, and decoded again."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode_decode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` dealt to shards 0 to 23 as a uniform shuffle with exact shard sizes."""
    return shuffle_into_shards(table(spark, sf_dir, "documents"), n_shards=24)


#: The rules of the url query: (host, path).
BLOCK = [("net", "/"), ("example.com", "/de/")]
ALLOW = [("example.net", "/en/"), ("org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of `pages`."""
    return url_filter(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_ngram_jaccard, op3_toxicity, op4_exact_dedup, op5_suffix_dedup, op6_line_dedup, op7_substring_dedup, op8_bpe, op9_sharding, op10_url_filter)}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, w[i:i + 12] AS win FROM bi),
ls AS (SELECT DISTINCT len(win) AS l FROM bw),
di AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
h AS (SELECT di.doc_id, di.i, di.l, bw.item_id FROM di JOIN bw ON bw.win = di.w[di.i:di.i + di.l - 1]),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


OP5_SQL = """
WITH l AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, list_transform(range(0, greatest(len(h) // 2 - 99, 0)), lambda i: hash(encode(h)[2 * i + 1:2 * i + 200])) AS ws FROM l),
w AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS win FROM p),
f AS (SELECT win, min((doc_id, i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
late AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) > f.first),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM late)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM s),
r AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM k JOIN l ON l.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT l.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM l LEFT JOIN r ON r.doc_id = l.doc_id
"""

OP6_SQL = """
WITH l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l),
w AS (SELECT doc_id, i, lines[i + 1:i + 3] AS win FROM p WHERE i + 3 <= len(lines)),
f AS (SELECT win, min((doc_id, i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
late AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) > f.first),
gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM late),
m AS (SELECT p.doc_id, p.i, p.lines[p.i + 1] AS line, g.i IS NOT NULL AS out FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
s AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (starts) AS n_spans,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP7_SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM l),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS win FROM p WHERE i + 19 <= len(ws)),
f AS (SELECT win, min((doc_id, i)) AS first FROM w GROUP BY win HAVING count(*) > 1),
late AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) > f.first),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM late),
a AS (SELECT p.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(p.ws[p.i], ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS kept
      FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP10_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rhost, rpath, rverdict)),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS v
      FROM u, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op5_suffix_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op10_url_filter": OP10_SQL}
