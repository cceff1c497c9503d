"""Operators against brute force, exact round trips, laws and awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from corvella.llm import jaccard_join as Jac
from corvella.llm import toxicity as Tox
from corvella.llm.bpe import Codec, Utf8Stream, bpe_encode_decode, read_ranks
from corvella.llm.common import join_facts
from corvella.llm.components import components
from corvella.llm.decontaminate import contamination_report, decontaminate
from corvella.llm.exact_dedup import exact_dedup
from corvella.llm.induced import sorted_suffixes
from corvella.llm.jaccard_join import jaccard_classes, shingle_sets
from corvella.llm.line_dedup import line_dedup
from corvella.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards
from corvella.llm.substring_dedup import substring_dedup
from corvella.llm.suffix_dedup import suffix_dedup
from corvella.llm.textops import Runs
from corvella.llm.url_filter import listed_in, build_cascade, url_filter

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
CLASH = "doc_id long, text string, id long, row long, kept boolean, text_sha256 string, best long, n long, size long, path string, key string, slot int, th long, start long, stop long, spans string, doc string, hits string, items string, label int, words string, _id long, sid long, _own_id long"


def clashing(rows):
    """Rows with many extra columns named like those that operators use inside."""
    return [(i, t, *([None] * (len(CLASH.split(",")) - 2))) for i, t in rows]


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


def corpus(seed=5, n=60):
    """Documents with exact copies, near copies, shared passages, shared lines, empty and long texts."""
    rng = random.Random(seed)
    passage, lines = prose(rng, 60), "\n".join(prose(rng, 6) for _ in range(5))
    out = []
    for i in range(n):
        t = prose(rng, rng.choice([0, 3, 30, 150]))
        if i % 5 == 1:
            t += " " + passage
        if i % 7 == 2:
            t += "\n" + lines + "\n" + prose(rng, 5)
        if i % 9 == 4:
            t = out[rng.randrange(len(out))][1]
        if i % 9 == 5 and len(out[-1][1].split()) > 100:
            w = out[-1][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i, t))
    return [*out, (n, None), (n + 1, ""), (n + 2, "x" * 5000), (n + 3, "ab " * 3000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(clashing(rows), CLASH).repartition(parts)


OPERATORS = {
    "decontaminate": lambda d: contamination_report(decontaminate(d, d.sparkSession.createDataFrame([(1, "one two"), (None, None), (2, "")], "item_id long, text string"))),
    "jaccard": jaccard_classes, "toxicity": lambda d: Tox.toxicity(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")), "exact": exact_dedup,
    "suffix": suffix_dedup, "line": line_dedup, "substring": substring_dedup, "bpe": lambda d: bpe_encode_decode(d, VOCABULARY, P.PATTERN), "shard": shuffle_into_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_a_row_each(spark, name):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, "a b c"), (5, "é" * 40000), (6, "one two\n" * 900)]
    out = OPERATORS[name](frame(spark, rows))
    got = [r["doc_id"] for r in out.collect()]
    assert Counter(got) == Counter(i for i, _ in rows)
    assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], CLASH)).count() == 0


def brute_windows(units, width):
    """Which units are covered by windows that start earlier: documents in order of id."""
    seen, out = set(), []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width])
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        out.append(gone)
    return out


def test_substring_dedup_against_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup(frame(spark, docs)).collect()}
    units = [(t or "").split() for _, t in docs]
    for (i, _), u, gone in zip(docs, units, brute_windows(units, 20), strict=True):
        assert got[i] == (len(u), gone.sum(), " ".join(w for w, g in zip(u, gone, strict=True) if not g))


@pytest.mark.parametrize("limit", [100_000, 2])
@pytest.mark.parametrize("together", [0, 500_000])
def test_repeats_on_awkward_rows_against_brute_force(spark, monkeypatch, limit, together):
    """Null and repeated ids, copies, one word again and again; anchors alone and in crowds, and those that repeat in a batch or only elsewhere."""
    from corvella.llm import windows

    monkeypatch.setattr(windows, "GROUP_LIMIT", limit)
    monkeypatch.setattr(windows, "TOGETHER", together)
    docs = [(None, corpus(12)[3][1]), *corpus(12), (70, None), (71, " ".join(["again"] * 90)), (72, "again " * 70)]
    for operator, width, units in ((substring_dedup, 20, [(t or "").split() for _, t in docs]), (suffix_dedup, 100, [(t or "").encode() for _, t in docs])):
        got = {r["doc_id"]: r["n_removed"] for r in operator(frame(spark, docs)).collect()}
        assert got == {i: int(g.sum()) for (i, _), g in zip(docs, brute_windows(units, width), strict=True)}


def test_substring_dedup_of_crowded_anchors(spark, monkeypatch):
    from corvella.llm import windows

    monkeypatch.setattr(windows, "GROUP_LIMIT", 2)
    test_substring_dedup_against_brute_force(spark)


def test_suffix_dedup_against_brute_force(spark):
    docs = corpus(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup(frame(spark, docs)).collect()}
    units = [(t or "").encode() for _, t in docs]
    for (i, _), u, gone in zip(docs, units, brute_windows(units, 100), strict=True):
        assert got[i] == (len(u), gone.sum(), np.frombuffer(u, np.uint8)[~gone].tobytes())


@pytest.mark.parametrize("memory", [4, 1 << 20])
def test_induced_sorting_with_queues_on_disk(tmp_path, memory):
    for seed in range(60):
        rng = random.Random(seed)
        t = []
        for _ in range(rng.randint(1, 4)):
            part = [rng.randint(1, 3) for _ in range(rng.randint(1, 20))]
            t += (part + [0]) * rng.randint(1, 2)
        text = np.array(t, np.uint16)
        parts = list(sorted_suffixes(text, 4, 1000, str(tmp_path), memory))[::-1]
        order, prefix = np.concatenate([p for _, p, _ in parts]).tolist(), np.concatenate([x for _, _, x in parts]).tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order == want

        def shared(a, b):
            k = 0
            while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k] != 0:
                k += 1
            return k

        assert prefix == [0] + [shared(a, b) for a, b in zip(want, want[1:], strict=False)]


def test_line_dedup_against_brute_force(spark):
    docs = corpus(7)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup(frame(spark, docs)).collect()}
    units = [t.split("\n") if t else [] for _, t in docs]
    for (i, _), u, gone in zip(docs, units, brute_windows(units, 3), strict=True):
        assert got[i] == (len(u), gone.sum(), "\n".join(x for x, g in zip(u, gone, strict=True) if not g))


def test_jaccard_classes_against_brute_force(spark):
    docs = corpus(8, 90)
    want = brute_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, docs)).collect()}
    assert got == want and any(n for _, n in want.values())


def brute_classes(docs, n=5):
    sets = [set(shingle_sets([(t or "").encode()], n)[0].tolist()) for _, t in docs]
    links, root = defaultdict(set), {i: i for i, _ in docs}
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[docs[i][0]].add(docs[j][0])
                links[docs[j][0]].add(docs[i][0])
    changed = True
    while changed:
        changed = False
        for a, bs in links.items():
            least = min([root[a], *(root[b] for b in bs)])
            changed |= least != root[a]
            root[a] = least
    return {i: (root[i], len(links[i])) for i, _ in docs}


def family(rng, base, n, changes, first):
    """Near copies of a text of `base` words: in each some words are changed."""
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("hot_keys", [1024, 4])
def test_jaccard_of_crowds_that_no_split_takes_apart(spark, monkeypatch, hot_keys):
    """Splits go deep, pivots settle crowds, and buckets are both few (known to all) and many (met by path)."""
    monkeypatch.setattr(Jac, "BUCKET", 4)
    monkeypatch.setattr(Jac, "BLOCK_SETS", 16)
    monkeypatch.setattr(Jac, "HOT_KEYS", hot_keys)
    rng = random.Random(9)
    base = [[f"b{k}w{i}" for i in range(150)] for k in range(4)]
    docs = [*family(rng, base[0], 60, 1, 0), *family(rng, base[1], 40, 3, 100), *family(rng, base[2], 40, 6, 200), *family(rng, base[3], 30, 14, 300)]
    want = brute_classes(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, docs)).collect()}
    found, all_links = (sum(v[1] for v in x.values()) for x in (got, want))
    assert 0.99 * all_links <= found <= all_links and all_links > 3000
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_jaccard_takes_pairs_exactly_at_the_threshold(spark):
    words = [f"w{i}" for i in range(9)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join([*words[:7], "y"])), (4, "z " + " ".join(words[:3])), (5, "z " + " ".join(words[:3]))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows), n=1, recall=0.999999).collect()}
    assert got == brute_classes(rows, 1) and got[1] == (1, 1)  # 8 of 9 words, and 7 of 10


def test_jaccard_keeps_one_row_of_a_class(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text + " a"), (None, text + " b"), (7, text), (7, text + " c"), (8, "other words"), (None, None), (9, None)]
    got = jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r["class_id"], r["kept"]) for r in got) == {(None, True): 2, (None, False): 3, (8, True): 1, (9, True): 1}


def thue_morse(a, b, n=10):
    s = t = ""
    s, t = a, b
    for _ in range(n):
        s, t = s + t, t + s
    return s, t


def test_words_that_collide_modulo_a_power_of_two(spark):
    """The Thue-Morse word of 1,024 letters and its complement have equal polynomial hashes modulo 2**64 in any odd base."""
    one, two = thue_morse("a", "b")
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {same}"), (2, f"{two} {same}")]
    assert [r["n_removed"] for r in substring_dedup(frame(spark, rows)).collect()] == [0, 0]
    assert [r["n_links"] for r in jaccard_classes(frame(spark, [(1, f"{one} a b c d"), (2, f"{two} a b c d")])).collect()] == [0, 0]
    lines = [(1, f"{one}\nx\ny"), (2, f"{two}\nx\ny")]
    assert [r["n_removed"] for r in line_dedup(frame(spark, lines)).collect()] == [0, 0]
    for k in (100, 1024):
        assert [r["n_removed"] for r in suffix_dedup(frame(spark, [(1, one[:k]), (2, two[:k])]), width=k).collect()] == [0, 0]
    numbers = [np.array([ord(c) for c in x], np.uint8) for x in (one, two)]
    for which in (0, 1):
        assert len({int(Runs(n, which).grams(1024)[0]) for n in numbers}) == 2


def test_jaccard_finds_pairs_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(Jac, "BUCKET", 16)
    common, rows = [f"c{i}" for i in range(140)], []
    for p in range(60):
        shared = [f"s{p}x{i}" for i in range(22)]
        rows += [(2 * p + k, " ".join(common + shared + [f"u{p}x{k}x{i}" for i in range(20)])) for k in (0, 1)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows), n=1).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}


def test_exact_dedup_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["same", f"t{rng.randrange(40)}", f"u{i}"])) for i in range(400)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(frame(spark, rows, 37), keep=keep, fan_in=3).collect()}
        assert got == {i: (best(groups[t]), len(groups[t]), i == best(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}


def test_decontamination_of_short_and_overlapping_items(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    bench = spark.createDataFrame([(7, item), (10, "Alpha BETA"), (9, None), (7, item)], "item_id long, text string")
    rows = [(1, f"x {item.upper()} y"), (2, "alpha, beta! gamma alpha"), (3, " ".join(item.split()[:12])), (4, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(frame(spark, rows), bench).collect()}
    assert got == {1: (17, 15, ["7"]), 2: (4, 2, ["10"]), 3: (12, 0, []), 4: (0, 0, [])}


def test_decontamination_in_blocks(spark, monkeypatch):
    from corvella.llm import decontaminate as D

    rng = random.Random(4)
    items = [(i, prose(rng, 40)) for i in range(8)]
    rows = [(i, prose(rng, 20) + " " + items[i % 8][1] + " " + items[(i + 3) % 8][1][:80]) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate(frame(spark, rows), bench).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted(map(str, decontaminate(frame(spark, rows), bench).collect())) == whole


def test_bpe_equals_the_library_and_round_trips():
    ranks = read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = Codec(ranks, P.PATTERN), random.Random(2)
    for _ in range(800):
        s = "".join(rng.choice(["a", "e", "th", " ", "\n", "0", "ß", "é", "漢", "🙂", "'s", "\t", "ing", "The", "xyz", "!!", "%", "aaaa"]) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(s)
        assert "".join(codec.decode_stream(ids, block=rng.randint(1, 5))) == s


def test_vocabularies_in_turn_on_one_worker(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    docs = spark.createDataFrame([(1, "the words of a text")], "doc_id long, text string").coalesce(1)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    whole, parts = library.encode_ordinary("the words of a text"), list(b"the words of a text")
    for vocabulary, want in ((VOCABULARY, whole), (str(path), parts)) * 3:
        assert bpe_encode_decode(docs, vocabulary, P.PATTERN).first()["ids"] == want


def test_bpe_when_little_is_remembered():
    ranks = read_ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = Codec(ranks, P.PATTERN, pieces=20), random.Random(4)
    for _ in range(200):
        s = "".join(rng.choice(["a", "e", "th", " ", "ing", "xyz", "ß", "漢", "qq", "er", "in"]) for _ in range(60))
        assert np.frombuffer(codec.encode(s), "<u4").tolist() == library.encode_ordinary(s)


def test_utf8_stream_takes_any_cut():
    text = "aß漢🙂é" * 3
    for cut in range(1, 6):
        stream, raw = Utf8Stream(), text.encode()
        assert "".join(stream.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) == text
        stream.close()
    with pytest.raises(ValueError):
        s = Utf8Stream()
        s.feed("漢".encode()[:2])
        s.close()


def test_bpe_query_columns(spark):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    docs = corpus(3, 20)
    for r in bpe_encode_decode(frame(spark, docs), VOCABULARY, P.PATTERN).collect():
        text = dict(docs)[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_sharding_law_sizes_and_slots(spark):
    docs = corpus(9, 200)
    rows = shuffle_into_shards(frame(spark, docs, 7), n_shards=24).collect()
    count = Counter(r["shard"] for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
    text = dict(docs)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_sharding_in_buckets(spark, monkeypatch):
    from corvella.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 2)
    test_sharding_law_sizes_and_slots(spark)


def test_communication_matrix_is_hypergeometric():
    m = sum(communication_matrix([5, 7, 8], [10, 10], seed) for seed in range(3000)) / 3000
    assert np.abs(m - np.array([[2.5, 2.5], [3.5, 3.5], [4, 4]])).max() < 0.1
    m = communication_matrix([3, 0, 9], [4, 4, 4], 1)
    assert m.sum(axis=1).tolist() == [3, 0, 9] and m.sum(axis=0).tolist() == [4, 4, 4]


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(1)
    good, bad, drawn = 4 * 10**9, 6 * 10**9, 10**6
    x = np.array([hypergeometric(rng, good, bad, drawn) for _ in range(400)])
    assert abs(x.mean() - 4e5) < 5 * 490 / 20 and 400 < x.std() < 600


def test_url_rules(spark):
    urls = ["http://a.net/x", "HTTP://A.NET/x", "http://net", "http://example.net/en/1", "http://w.example.net/en/1", "http://example.net/de/", "http://example.com/de/x?y#z", "http://notexample.com/de/x",
            "http://x.org/fr/", "http://x.org/en/", None, "no scheme", "x://b.net?q=/de/", "http://sub.example.com/de", "://net/"]
    pages = spark.createDataFrame([(i, u, "net/") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    block, allow = [("net", "/"), ("example.com", "/de/")], [("example.net", "/en/"), ("org", "/fr/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, block, allow).collect()}
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for v, rules in (("block", block), ("allow", allow)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    assert got == want
    assert url_filter(pages.limit(0), block, allow).count() == 0


def brute_urls(urls, block, allow):
    want = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), h + p, v) for v, rules in (("block", block), ("allow", allow)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((host, path, *(max(fit)[2:] if fit else (None, "allow"))))
    return want


def test_url_rules_against_brute_force_on_awkward_rows(spark):
    rng = random.Random(8)
    name = lambda: rng.choice(["a", "b", "cc", "É", "x" * 300, "net", ""])
    host = lambda n: ".".join(name() for _ in range(n))
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host(rng.randint(1, 4)).upper() if rng.random() < 0.3 else host(rng.randint(1, 4))}{rng.choice(['', '/', '/a/b', '/A/b?c', '#/a', '?/a', '/' + 'y' * 5000])}" for _ in range(400)]
    urls += urls[:40] + [None, "", "://", "no", "a://b://c/d", None]
    rules = list({(h, p) for h, p in ((host(rng.randint(1, 3)), rng.choice(["/", "", "/a/", "/A/b"])) for _ in range(60)) if h.strip(".")})
    block, allow = rules[: len(rules) // 2], rules[len(rules) // 2 :]
    ids = [i if i % 7 else None for i in range(len(urls))]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in zip(ids, urls, strict=True)], "page_id long, url string, host string, _keys string").repartition(3)
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, block, allow).collect())
    assert got == Counter((i, *w) for i, w in zip(ids, brute_urls(urls, block, allow), strict=True))
    assert {r["verdict"] for r in url_filter(pages, [], []).collect()} == {"allow"}


def test_sharding_is_a_uniform_permutation(spark):
    """Over many seeds every row is in every shard and slot equally often, whatever partition it lies in."""
    docs = spark.createDataFrame([(i, "t") for i in range(5)], "doc_id long, text string").repartition(2)
    seen = Counter()
    runs = 60
    for seed in range(runs):
        for r in shuffle_into_shards(docs, n_shards=2, seed=seed).collect():
            seen[r["doc_id"], r["shard"], r["slot"]] += 1
    cells = [seen[i, s, k] for i in range(5) for s in range(2) for k in range(3 - s)]
    chi2 = sum((c - runs / 5) ** 2 / (runs / 5) for c in cells)  # 25 cells with 16 degrees of freedom: above 39.3 once in 1,000 times
    assert sum(cells) == 5 * runs and chi2 < 39.3


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 13 == 0).alias("listed"))
    levels = build_cascade(universe, "listed")
    assert len(levels) > 1
    assert universe.where(listed_in(levels, F.col("key")) != F.col("listed")).count() == 0


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(3)
    bad = ["idiot", "worthless", "scum"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60, 3000).split()
        words = ["the ordinary words of a language model"[rng.randrange(30) :] if rng.random() < 0.1 else w for w in words]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    hidden = [(1000, "you are an 1d10t"), (1001, "so w o r t h l e s s today"), (1002, "such scuuuum here"), (1003, "an id.i.ot speaks"), (1004, "fine words 55-12"), (1005, None)]
    out = Tox.toxicity(frame(spark, rows + hidden), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in out.collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert held == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert [got[i]["predicted"] for i in range(1000, 1006)] == [1, 1, 1, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def restorer():
    counts = np.ones((Tox.SYMBOLS,) * 4)
    said = "   you are a worthless idiot and a moron or scum or a clown said the other one with a good letter   " * 50
    codes = Tox._TABLE[np.frombuffer(said.encode(), np.uint8)].astype(int)
    np.add.at(counts, (codes[:-3], codes[1:-2], codes[2:-1], codes[3:]), 1)
    return Tox.Restorer(-np.log(counts / counts.sum(axis=-1, keepdims=True)).astype(np.float32))


def exhaustive(r, text):
    """The cheapest of all readings of a lattice."""
    best = (np.inf, "")
    number = {" ": 0, "¿": 27, "#": 28}
    for path in itertools.product(*r.lattice(text), [(" ", 0.0)]):
        cost, at = 0.0, 0
        for out, price in path:
            cost += price
            for x in out:
                s = number.get(x)
                s = ord(x) - 96 if s is None else s
                cost += r.costs[at * Tox.SYMBOLS + s]
                at = at % Tox.SYMBOLS**2 * Tox.SYMBOLS + s
        best = min(best, (cost, "".join(o for o, _ in path).strip()))
    return best


def test_toxicity_decodes_the_likeliest_reading():
    r, rng = restorer(), random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice("idot1!*0m@$csu+(|6 ") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))
        assert r.decode(text) == exhaustive(r, text)[1]


def test_toxicity_finds_what_full_decoding_finds():
    r, rng, lexicon = restorer(), random.Random(7), {"idiot", "worthless", "scum", "moron", "clown", "größe", "the", "ee"}
    said = ["1d10t", "m0r0n", "id.i.ot", "w o r t h l e s s", "(lown", "c.l.o.w.n", "*diot", "größe", "GRÖSSE", "st upid", "a_moron_b", "sc\tum", "ıdiot", "£oser", "ß", "s-c-u-m", "$cum)", "x/idiot:y", "tr@@@sh", "İdiot", "\x1cidiot\x85scum", "a\u2003moron\xa0b", "the", "and", "12"]
    texts = [None, "", *(" ".join(rng.choice(said) for _ in range(rng.randint(0, 9))) for _ in range(600))]
    assert Tox.Finder(r, lexicon).found(texts) == [sorted(r.restored(t or "") & lexicon) for t in texts]
    assert Tox.Finder(r, []).found(["idiot", None]) == [[], []]


def test_toxicity_learns_words_from_few_labels():
    counts = [(4, 4, 5), (4, 1, 250), (4, 0, 250), (3, 3, 3), (3, 0, 600), (2, 2, 80), (2, 0, 2000)]
    assert [x[:2] for x in Tox.telling(counts, 0.147)] == [(4, 4)]
    assert Tox.telling([(4, 4, 5), (4, 1, 25000)], 0.147) == [] and Tox.telling([], 0.5) == []


def test_toxicity_models_in_turn_on_one_worker(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    docs = [spark.createDataFrame([(i, f"{a} {b} {'scum' if i % 3 == 0 else 'fine'} {i} sc0m") for i in range(60)], "doc_id long, text string").coalesce(1) for a, b in (("scum", "words"), ("som", "som"))]
    first = [sorted(map(str, Tox.toxicity(d, labels).collect())) for d in docs]
    assert [sorted(map(str, Tox.toxicity(d, labels).collect())) for d in docs] == first


def test_toxicity_decodes_at_any_length():
    r, spaced = restorer(), " ".join("youareaworthlessidiot" * 4)
    assert len(spaced) > 96 and {"worthless", "idiot"} <= r.restored(spaced)
    assert "idiot" in r.restored("an idi" + "o" * 60 + "t")
    assert {"idiot", "scum"} <= r.restored(".".join(["you"] * 15 + ["idiot", "sc0m", "scum"]))
    assert "idiot" in r.restored("_".join(["other"] * 10 + ["1d10t"]))


@pytest.mark.parametrize(("text", "word"), [("iddiott", "idiot"), ("mmoron", "moron"), ("sccum", "scum"), ("i d ! o t", "idiot"), ("i  d  i  o  t", "idiot"), ("i\td\ni\to\tt", "idiot"), ("i d * o t", "idiot"), ("i*d*i*o*t", "idiot"), ("*diot", "idiot"), ("idi*t", "idiot"), ("m*ron.", "moron"), ("(lown", "clown"), ("<lown,", "clown"), ("a good letter", "good")])
def test_toxicity_takes_usual_disguises_to_the_lattice(text, word):
    assert word in restorer().restored(f"you {text} there")


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}


def test_clean_up_removes_what_was_written(spark):
    from pathlib import Path

    from corvella.llm import common

    common.clean_up(spark)
    rows = common.materialize(spark.range(5).toDF("id"))
    folder = Path(rows.inputFiles()[0].removeprefix("file:")).parent
    assert rows.count() == 5 and folder.exists()
    assert common.clean_up(spark) == 1 and not folder.exists() and common.clean_up(spark) == 0


def test_join_facts_serves_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k3'")
    out = join_facts(rows, facts, "k", "n").groupBy("k").agg(F.min("n").alias("n"), F.count("*").alias("c")).collect()
    assert all(r["n"] == (None if r["k"] == "k3" else r["c"]) for r in out) and sum(r["c"] for r in out) == 1000
