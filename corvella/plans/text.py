"""Queries on text: functions, filters, sentences, chunks, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import sequences as S
from corvella.plans.registry import query
from corvella.sources.domain import TEXT_ELEMENTS, table, text_elements

_ABBREVIATIONS, _CONNECTORS = (", ".join(f"'{w}'" for w in x) for x in (T.ABBREVIATIONS, T.CONNECTORS))
SENTENCES = rf"""(SELECT pmcid, te_id, s AS sentence, i - 1 AS k FROM (SELECT pmcid, te_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM
 (SELECT pmcid, te_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM {TEXT_ELEMENTS})))"""


def _sentences(spark, sf_dir):
    return text_elements(spark, sf_dir).select("pmcid", "te_id", F.posexplode(T.sentences("text")).alias("k", "sentence"))


@query(f"SELECT pmcid, te_id, k, sentence FROM {SENTENCES}")
def T06_sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir).withColumn("k", F.col("k").cast("long"))


@query(rf"SELECT te_id, regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '([A-Za-z{T.ACCENTED}]) ([{T.ACCENTED}])', '\1\2', 'g'), '([{T.ACCENTED}]) ([A-Za-z{T.ACCENTED}])', '\1\2', 'g') AS fixed FROM (SELECT te_id, replace(replace(text, 'fi', 'ﬁ'), 'ff', 'ﬀ') AS text FROM {TEXT_ELEMENTS})")
def T01_fix_ligatures(spark, sf_dir):
    te = text_elements(spark, sf_dir).withColumn("text", F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("ff"), F.lit("ﬀ")))
    return te.select("te_id", T.fix_ligatures("text").alias("fixed"))


@query()
def T02_remove_citations(spark, sf_dir):
    return text_elements(spark, sf_dir).withColumn("t", F.concat("text", F.lit(" [1,2] ends. 14 Next, 5 more 1,2 ."))).select("te_id", T.remove_citations("t").alias("cleaned"))


@query(rf"""SELECT path, count(*) FILTER (regexp_matches(h, '^(table |[-|*•])')) AS n_table, count(*) FILTER (NOT regexp_matches(h, '^(table |[-|*•])') AND NOT starts_with(h, 'figure ')) AS n_narrative
 FROM (SELECT path, lower(substr(trim(CASE te_id % 5 WHEN 0 THEN 'Table 1 ' || text WHEN 1 THEN 'Figure 2 ' || text WHEN 2 THEN '| ' || text ELSE text END, ' '), 1, 50)) AS h FROM {TEXT_ELEMENTS}) GROUP BY path""")
def T04_paragraph_class(spark, sf_dir):
    k, text = F.col("te_id") % 5, F.col("text")
    c = T.paragraph_class(F.when(k == 0, F.concat(F.lit("Table 1 "), text)).when(k == 1, F.concat(F.lit("Figure 2 "), text)).when(k == 2, F.concat(F.lit("| "), text)).otherwise(text))
    return text_elements(spark, sf_dir).groupBy("path").agg(F.count_if(c == "table").alias("n_table"), F.count_if(c == "narrative").alias("n_narrative"))


@query(rf"""WITH t AS (SELECT path, t, list_transform(regexp_split_to_array(lower(t), '\s+'), lambda x: rtrim(x, '.,;:')) AS w FROM (SELECT path, regexp_replace(CASE te_id % 4 WHEN 0 THEN text || ' see Fig.' WHEN 1 THEN rtrim(text, '.') || ' and the' ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM {TEXT_ELEMENTS}))
SELECT path, count(*) FILTER (CASE WHEN t = '' THEN false WHEN regexp_matches(t, '[-,]$') THEN true WHEN w[-1] IN ({_ABBREVIATIONS}) OR coalesce(w[-2] || ' ' || w[-1] IN ({_ABBREVIATIONS}), false) THEN true
 WHEN regexp_matches(t, '[.?!)\]"''»]$') THEN false ELSE w[-1] IN ({_CONNECTORS}) END) AS n_cut, count(*) AS n FROM t GROUP BY path""")
def T05_cut_off(spark, sf_dir):
    k, text = F.col("te_id") % 4, F.col("text")
    t = F.when(k == 0, F.concat(text, F.lit(" see Fig."))).when(k == 1, F.concat(F.rtrim(text, F.lit(".")), F.lit(" and the"))).otherwise(text)
    return text_elements(spark, sf_dir).groupBy("path").agg(F.count_if(T.is_cut_off(t)).alias("n_cut"), F.count("*").alias("n"))


@query(f"SELECT pmcid, string_agg('[S' || CAST(pos AS VARCHAR) || '|' || pmcid || '|' || CAST(te_id AS VARCHAR) || '] ' || text, chr(10) ORDER BY pos) AS prompt FROM {TEXT_ELEMENTS} GROUP BY pmcid")
def T07_citation_lines(spark, sf_dir):
    line = T.citation_line(F.col("pos"), F.col("pmcid"), F.col("te_id"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return text_elements(spark, sf_dir).groupBy("pmcid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"))


REFS = f"(SELECT te_id, pmcid, pos, CASE te_id % 5 WHEN 0 THEN 'S' || CAST(pos AS VARCHAR) || '|' || pmcid || '|' || CAST(te_id AS VARCHAR) WHEN 1 THEN 'bad' WHEN 2 THEN 'S' || CAST(pos + 900 AS VARCHAR) || '|' || pmcid || '|' || CAST(te_id AS VARCHAR) WHEN 3 THEN 'S' || CAST(pos AS VARCHAR) || '|PMCx|' || CAST(te_id AS VARCHAR) ELSE 'S' || CAST(pos AS VARCHAR) || '|' || pmcid || '|1' END AS ref FROM {TEXT_ELEMENTS})"


def _refs(spark, sf_dir):
    s = lambda pos, pmcid, te: F.concat(F.lit("S"), pos.cast("string"), F.lit("|"), pmcid, F.lit("|"), te.cast("string"))
    pos, pmcid, te, k = F.col("pos"), F.col("pmcid"), F.col("te_id"), F.col("te_id") % 5
    ref = F.when(k == 0, s(pos, pmcid, te)).when(k == 1, "bad").when(k == 2, s(pos + 900, pmcid, te)).when(k == 3, s(pos, F.lit("PMCx"), te)).otherwise(s(pos, pmcid, F.lit(1)))
    return text_elements(spark, sf_dir).select("te_id", "pmcid", "pos", ref.alias("ref"))


@query(rf"SELECT te_id, CAST(nullif(regexp_extract(ref, '^S(\d+)\|PMC[A-Za-z0-9_-]+\|\d+$', 1), '') AS BIGINT) AS cited_pos, nullif(regexp_extract(ref, '^S\d+\|(PMC[A-Za-z0-9_-]+)\|\d+$', 1), '') AS cited_pmcid, CAST(nullif(regexp_extract(ref, '^S\d+\|PMC[A-Za-z0-9_-]+\|(\d+)$', 1), '') AS BIGINT) AS cited_te FROM {REFS}")
def T08_T09_parse_citations(spark, sf_dir):
    p = _refs(spark, sf_dir).withColumn("p", T.parse_citation("ref"))
    return p.select("te_id", F.col("p.pos").alias("cited_pos"), F.col("p.pmcid").alias("cited_pmcid"), F.col("p.te_id").alias("cited_te"))


@query(rf"""SELECT code, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(ref, '^S\d+\|PMC[A-Za-z0-9_-]+\|\d+$') THEN 'INVALID_SENTENCE_ID' WHEN split_part(ref, '|', 2) <> r.pmcid THEN 'CROSS_DOCUMENT_SOURCE_ERROR'
 WHEN t.te_id IS NULL THEN 'NONEXISTENT_SOURCE' WHEN t.te_id <> TRY_CAST(split_part(ref, '|', 3) AS BIGINT) THEN 'INVALID_TEXT_ELEMENT_ID' ELSE 'ok' END AS code
 FROM {REFS} r LEFT JOIN {TEXT_ELEMENTS} t ON t.pmcid = r.pmcid AND t.pos = TRY_CAST(substr(split_part(ref, '|', 1), 2) AS BIGINT)) GROUP BY code""")
def F14_A56_provenance_codes(spark, sf_dir):
    return S.provenance_codes(_refs(spark, sf_dir), text_elements(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query(rf"""SELECT pmcid, count(*) AS n_kept FROM {REFS} WHERE te_id % 5 = 0 GROUP BY pmcid""")
def F16_citation_filter(spark, sf_dir):
    return S.provenance_codes(_refs(spark, sf_dir), text_elements(spark, sf_dir)).where("code = 'ok'").groupBy("pmcid").agg(F.count("*").alias("n_kept"))


@query("SELECT p_partkey, lower(CASE p_partkey % 3 WHEN 1 THEN p_name || ' overexpression' ELSE p_name END) AS name FROM part")
def T11_strip_marker(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").withColumn("n", F.concat("p_name", F.when(k == 0, " Expression").when(k == 1, " overexpression").otherwise("")))
    return p.select("p_partkey", T.strip_marker("n").alias("name"))


@query("SELECT direction, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'unclear' END AS direction FROM part) GROUP BY direction")
def T12_infer_direction(spark, sf_dir):
    k = F.col("p_partkey") % 4
    t = F.concat("p_name", F.when(k == 0, " Absent").when(k == 1, " was seen").when(k == 2, " not detected but found").otherwise(""))
    return table(spark, sf_dir, "part").select(T.infer_direction(t).alias("direction")).groupBy("direction").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_acctbal < 0 THEN '' ELSE '[scope: ' || concat_ws(' | ', CASE WHEN c_nationkey % 3 <> 0 THEN 'population=' || c_mktsegment END, CASE WHEN c_acctbal >= 0 THEN 'method=' || c_name END) || '] ' END AS prefix, concat_ws(' | ', CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END, c_name) AS embed_text FROM customer")
def T14_T15_T19_scope_and_embedding_text(spark, sf_dir):
    pop, method = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" "), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", T.scope_prefix({"population": pop, "method": method}).alias("prefix"), T.joined_fields(pop, F.col("c_name")).alias("embed_text"))


@query("SELECT doc_id, substr(sha256(text), 1, 8) AS id8, 'NF_' || substr(sha256(source || '|' || lang), 1, 16) AS id16, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS claim, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS filename FROM documents")
def T16_T20_T21_ids_claims_filenames(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring(F.sha2("text", 256), 1, 8).alias("id8"), F.concat(F.lit("NF_"), F.substring(F.sha2(F.concat_ws("|", "source", "lang"), 256), 1, 16)).alias("id16"),
        T.normal_claim("text").alias("claim"), T.safe_filename("text").alias("filename"),
    )


@query(r"SELECT page_id, list_distinct(m) IS NOT NULL AS found, len(m) AS n_numbers, array_to_string(m, ',') AS numbers FROM (SELECT page_id, regexp_extract_all(url, '\b(\d+(?:\.\d+)?)', 1) AS m FROM pages)")
def T22_numbers(spark, sf_dir):
    n = T.numbers("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lit(True).alias("found"), F.size(n).cast("long").alias("n_numbers"), F.array_join(n, ",").alias("numbers"))


@query("SELECT pmcid, fig FROM (SELECT 'PMC' || CAST(p_partkey AS VARCHAR) AS pmcid, CAST(p_size AS VARCHAR) AS fig FROM part UNION SELECT 'PMC' || CAST(p_partkey AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR) FROM part)")
def T18_J12_mentions(spark, sf_dir):
    size, seven = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")
    text = F.concat(F.lit("see Figure "), size, F.lit(", fig. "), seven, F.lit(" and Fig "), size)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("PMC"), F.col("p_partkey").cast("string")).alias("pmcid"), F.explode(T.mentions(text, "fig")).alias("fig"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS number, p_name AS caption FROM part")
def T17_captions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("c", F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(". x"))).withColumn("r", F.repeat("p_name", F.lit(3)))
    return p.select("p_partkey", T.caption_number("c").alias("number"), T.unrepeated("r").alias("caption"))


@query("SELECT doc_id, (CASE WHEN contains(lower(text), 'idiot') THEN 'idiot,' ELSE '' END) || (CASE WHEN contains(lower(text), 'trash') THEN 'trash,' ELSE '' END) AS hits FROM documents")
def T23_keyword_hits(spark, sf_dir):
    hits = T.keyword_hits("text", ["idiot", "trash"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(hits, lambda h: F.concat(h, F.lit(","))), "").alias("hits"))


@query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'FAST' WHEN regexp_matches(o_orderpriority, 'MEDIUM') THEN 'MID' ELSE 'OTHER' END AS code FROM orders) GROUP BY code")
def T25_A41_reason_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(T.reason_code("o_orderpriority", {"FAST": "URGENT|HIGH", "MID": "MEDIUM"}).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN list_reduce(list_prepend(0, list_transform(string_split(md5('42:' || CAST(doc_id AS VARCHAR)), ''), lambda x: strpos('0123456789abcdef', x) - 1)), lambda a, d: (a * 16 + d) % 100) < 80 THEN 'dev' ELSE 'test' END AS split FROM documents) GROUP BY split")
def O12_hash_split(spark, sf_dir):
    m = T.mod_of_md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 100)
    return table(spark, sf_dir, "documents").select(F.when(m < 80, "dev").otherwise("test").alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query(f"SELECT path, count(*) FILTER (n_words >= 40) AS useful, count(*) FILTER (length(text) >= 200) AS long_enough, count(*) FILTER (regexp_matches(path, 'src[0-3] ')) AS boilerplate FROM {TEXT_ELEMENTS} GROUP BY path")
def F05_F21_F22_useful_paragraphs(spark, sf_dir):
    return text_elements(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("n_words") >= 40).alias("useful"), F.count_if(F.length("text") >= 200).alias("long_enough"), F.count_if(F.col("path").rlike("src[0-3] ")).alias("boilerplate"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|moron') AND NOT regexp_matches(lower(text), 'clown') GROUP BY doc_id")
def F01_include_exclude(spark, sf_dir):
    t = F.lower("text")
    return table(spark, sf_dir, "documents").where(t.rlike("idiot|moron") & ~t.rlike("clown")).select("doc_id").distinct()


@query(f"""SELECT pmcid, start // 8 AS chunk, count(*) AS n, min(p.pos) AS first_pos FROM (SELECT pmcid, pos, max(pos) OVER (PARTITION BY pmcid) AS last, unnest(range(greatest(0, (pos - 9) // 8 * 8), pos + 1, 8)) AS start FROM {TEXT_ELEMENTS}) p
 WHERE start <= pos AND pos < start + 10 AND start <= last GROUP BY pmcid, start""")
def W10_overlapping_chunks(spark, sf_dir):
    return S.overlapping_chunks(text_elements(spark, sf_dir), 10, 2).groupBy("pmcid", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(f"SELECT pmcid, 'C' || CAST(pos // 15 + 1 AS VARCHAR) AS chunk, sum(n_words) AS n_words FROM {TEXT_ELEMENTS} GROUP BY ALL")
def W11_disjoint_chunks(spark, sf_dir):
    return S.disjoint_chunks(text_elements(spark, sf_dir), 15).groupBy("pmcid", "chunk").agg(F.sum("n_words").alias("n_words"))


@query(f"SELECT te_id, pmcid, path, row_number() OVER (PARTITION BY pmcid, path ORDER BY pos) - 1 AS position FROM {TEXT_ELEMENTS}")
def W04_section_position(spark, sf_dir):
    return text_elements(spark, sf_dir).select("te_id", "pmcid", "path", (F.row_number().over(Window.partitionBy("pmcid", "path").orderBy("pos")) - 1).cast("long").alias("position"))


@query(f"SELECT pmcid, path, text, min(te_id) AS te_id FROM {TEXT_ELEMENTS} GROUP BY pmcid, path, text")
def W06_first_seen_text(spark, sf_dir):
    return S.first_seen(text_elements(spark, sf_dir), ["pmcid", "path", "text"], "te_id").select("pmcid", "path", "text", "te_id")


@query("SELECT conv_id, island, min(turn) AS first_turn, count(*) AS n, min(role) AS role FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS new FROM conversations)) GROUP BY conv_id, island")
def W07_contiguous_runs(spark, sf_dir):
    runs = S.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "role")
    return runs.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.min("role").alias("role"))


@query(f"SELECT pmcid, count(*) AS n_elements, count(*) FILTER (skipped) AS n_skipped FROM (SELECT *, CASE WHEN k THEN sum(CAST(r AS INT)) OVER (PARTITION BY pmcid, island) >= 2 ELSE false END AS skipped FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY pmcid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, k IS DISTINCT FROM lag(k) OVER (PARTITION BY pmcid ORDER BY pos) AS new FROM (SELECT pmcid, pos, n_words < 30 AS k, n_words < 12 AS r FROM {TEXT_ELEMENTS})))) GROUP BY pmcid")
def W08_bibliography_runs(spark, sf_dir):
    te = text_elements(spark, sf_dir).select("pmcid", "pos", (F.col("n_words") < 30).alias("k"), (F.col("n_words") < 12).alias("r"))
    return S.reference_runs(te, ["pmcid"], ["pos"], "k", "r").groupBy("pmcid").agg(F.count("*").alias("n_elements"), F.count_if("skipped").alias("n_skipped"))


@query(f"SELECT te_id, h1, h2 FROM (SELECT te_id, pos, last_value(CASE WHEN lv = 1 THEN te_id END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN lv = 1 THEN te_id END IGNORE NULLS) OVER w AS x1, CASE WHEN last_value(CASE WHEN lv = 2 THEN te_id END IGNORE NULLS) OVER w > coalesce(last_value(CASE WHEN lv = 1 THEN te_id END IGNORE NULLS) OVER w, -1) THEN last_value(CASE WHEN lv = 2 THEN te_id END IGNORE NULLS) OVER w END AS h2 FROM (SELECT *, CASE WHEN n_words % 11 = 0 THEN 1 WHEN n_words % 7 = 0 THEN 2 END AS lv FROM {TEXT_ELEMENTS}) WINDOW w AS (PARTITION BY pmcid ORDER BY pos ROWS UNBOUNDED PRECEDING))")
def W05_section_hierarchy(spark, sf_dir):
    te = text_elements(spark, sf_dir).withColumn("level", F.when(F.col("n_words") % 11 == 0, 1).when(F.col("n_words") % 7 == 0, 2))
    return S.section_headers(te, ["pmcid"], "pos", "level", "te_id", 2).select("te_id", "h1", "h2")


@query("SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def A58_best_per_group(spark, sf_dir):
    return S.best_per_group(table(spark, sf_dir, "documents"), ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("doc_id", "lang", "n_chars")
