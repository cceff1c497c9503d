"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded_batches
from corvella.llm.textops import WORD, Runs, Words, slices

#: Bytes of item text that one block of the benchmark may have; larger benchmarks are joined block by block.
BLOCK_BYTES = 16 << 20
#: Words of a shingle, the tokens of the join; a shorter window is one shingle.
SHINGLE = 5


class Windows:
    """The distinct item-sized windows of a block of benchmark items, as sets of shingles.

    A document holds a window only if it holds all of the window's shingles, so the necessary prefix of each window, with
    shingles ordered by rarity, is the rarest one alone.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.items: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            words = Words([(text or "").encode()], WORD, lower=True)
            n = len(words.start)
            for i in range(max(n - width, 0) + 1 if n else 0):
                self.items[words.text(i, min(i + width, n))].add(item)
        self.text = list(self.items)
        self.ids = [sorted(self.items[t]) for t in self.text]
        self.n_words = np.array([t.count(b" ") + 1 for t in self.text], np.int64)
        words = Words(self.text, WORD, lower=False)
        runs, at = Runs(words.hash), words.first[:-1]
        size = np.minimum(self.n_words, SHINGLE)
        n_shingles = self.n_words - size + 1
        self.window = np.repeat(np.arange(len(self.text)), n_shingles)
        self.offset = np.arange(len(self.window)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        start = (at[self.window] + self.offset).astype(np.int64)
        self.shingle = runs.hash(start, start + size[self.window])
        self.whole = runs.hash(at.astype(np.int64), at + self.n_words)
        self.sizes = sorted(set(size.tolist()))
        self.known = np.unique(self.shingle)

    def order(self, frequency: dict[int, int]) -> None:
        """Keep each window's rarest shingle: the fewest places in the corpus, then the smaller hash."""
        often = np.array([frequency.get(int(h), 0) for h in self.known.view(np.int64)])[np.searchsorted(self.known, self.shingle)] if len(self.known) else np.zeros(0, np.int64)
        by = np.lexsort((self.offset, self.shingle, often, self.window))
        best = by[np.flatnonzero(np.diff(self.window[by], prepend=-1))]
        best = best[often[best] > 0]  # a shingle that no document has keeps its window out of the join
        best = best[np.argsort(self.shingle[best], kind="stable")]
        self.prefix, self.prefix_window, self.prefix_offset = self.shingle[best], self.window[best], self.offset[best]
        self.known = np.unique(self.prefix)
        self.sizes = sorted(set(np.minimum(self.n_words[self.prefix_window], SHINGLE).tolist()))
        del self.window, self.offset, self.shingle

    def sieve(self) -> np.ndarray:
        """Which 20-bit ends known shingles have: most of a text's shingles need no closer look."""
        out = np.zeros(1 << 20, bool)
        out[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out


def _probe(words: Words, windows: Windows, sieve: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: the size, the places (numbers of first words) of known shingles, and their hashes."""
    runs = Runs(words.hash)
    for k in windows.sizes:
        h = runs.grams(k)
        at = np.flatnonzero(sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found = h[at]
        i = np.searchsorted(windows.known, found)
        hit = windows.known[np.minimum(i, len(windows.known) - 1)] == found if len(windows.known) else np.zeros(len(found), bool)
        at, found = at[hit], found[hit]
        doc = np.searchsorted(words.first, at, side="right") - 1
        inside = at + k <= words.first[doc + 1]
        yield k, at[inside], found[inside]


def _count(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        sieve, counts = windows.sieve(), np.zeros(len(windows.known), np.int64)
        for batch in batches:
            for _, texts in slices(batch["text"]):
                for _, _, found in _probe(Words(texts, WORD, lower=True), windows, sieve):
                    counts += np.bincount(np.searchsorted(windows.known, found), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(windows.known[some].view(np.int64)), "n": pa.array(counts[some])})

    return run


def _matches(words: Words, windows: Windows, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every verified occurrence of a window."""
    runs, starts, which = Runs(words.hash), [], []
    for k, at, found in _probe(words, windows, sieve):
        low, high = np.searchsorted(windows.prefix, found), np.searchsorted(windows.prefix, found, side="right")
        n = high - low
        pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = windows.prefix_window[pick]
        at = np.repeat(at, n)
        doc = np.searchsorted(words.first, at, side="right") - 1
        start, size = at - windows.prefix_offset[pick], windows.n_words[window]
        ok = (np.minimum(size, SHINGLE) == k) & (start >= words.first[doc])  # the position in the document leaves room before
        ok &= (start + size <= words.first[doc + 1]) & (size <= (words.first[1:] - words.first[:-1])[doc])  # and after, and in it
        start, window, size = start[ok], window[ok], size[ok]
        ok = runs.hash(start, start + size) == windows.whole[window]
        starts.append(start[ok])
        which.append(window[ok])
    start, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which))
    exact = np.array([words.text(s, s + int(windows.n_words[w])) == windows.text[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)], bool)
    return start[exact], window[exact]


def _texts(batch: pa.RecordBatch, text_col: str | None) -> pa.Array:
    return batch["doc"].field(text_col) if text_col else batch["text"]


def _join(shared, text_col: str | None):
    """Add one block's hits (a bit for each word) and items to the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        sieve = windows.sieve()
        for batch in batches:
            hits, items = batch["hits"].to_pylist(), [set(x or ()) for x in batch["items"].to_pylist()]
            for first, texts in slices(_texts(batch, text_col)):
                words = Words(texts, WORD, lower=True)
                start, window = _matches(words, windows, sieve)
                cover = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + windows.n_words[window], -1)
                hit = np.cumsum(cover[:-1]) > 0
                for doc, w in set(zip((np.searchsorted(words.first, start, side="right") - 1).tolist(), window.tolist(), strict=True)):
                    items[first + doc].update(windows.ids[w])
                for i, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
                    before = hits[first + i]
                    own = hit[a:b]
                    if before is not None:
                        own = own | np.unpackbits(np.frombuffer(before[8:], np.uint8), count=b - a).astype(bool)
                    hits[first + i] = int(b - a).to_bytes(8, "little") + np.packbits(own).tobytes()
            marks = {"hits": pa.array(hits, pa.binary()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict({n: marks.get(n, batch[n]) for n in batch.schema.names})

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id_col, n_words, n_hit, items (sorted ids of items found), hits (8 bytes: n_words; then a bit for each word).
    Other columns are neither read nor returned; with carry=True the whole row comes along instead, as the struct `doc`.

    Words are runs of lower-cased letters, digits and non-ASCII characters. A window is `width` consecutive words of an
    item, or all words of a shorter one; a document's word is hit if it lies in any occurrence of any window.

    1. Every window becomes a set of shingles of SHINGLE words. One scan counts these in the whole corpus.
    2. A second scan joins documents with windows on each window's rarest shingle, the necessary prefix for containment.
       Where the shingle lies must leave room for the window before and after it, inside the document.
    3. Candidates are verified: the hash of the whole window, then its words byte by byte.

    The broadcast holds the windows of at most BLOCK_BYTES of items; a larger benchmark takes more blocks, each a map over
    the documents in the same stage. Documents are never shuffled.

    * A null text has no words, no hits and no items. Null item ids count as the empty string; rows that repeat an item
      are one item. Null or repeated document ids are rows like any others. Empty tables: no rows, or no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    doc = [F.struct(*docs.columns).alias("doc")] if carry else [F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")]
    state = docs.select(*doc, F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()  # BLOCK_BYTES or thereabouts
        windows = Windows([(r["item"], r["text"]) for r in part], width)
        shared = spark.sparkContext.broadcast(windows)
        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        windows.order({r["shingle"]: r["n"] for r in counted.collect()})  # no more rows than the block has shingles
        state = state.mapInArrow(_join(spark.sparkContext.broadcast(windows), text_col if carry else None), state.schema)
    zero = F.lit(0).cast("long")
    totals = state.select("doc", zero.alias("n_words"), zero.alias("n_hit"), "items", "hits")
    out = state.select("doc", "items", "hits").mapInArrow(_totals, totals.schema)
    return out if carry else out.withColumnRenamed("doc", id_col)


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = batch["hits"].to_pylist()
        n_words = [int.from_bytes(h[:8], "little") for h in hits]
        n_hit = [int.from_bytes(h[8:], "little").bit_count() for h in hits]
        yield pa.RecordBatch.from_pydict({"doc": batch["doc"], "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": batch["items"], "hits": batch["hits"]})


def contamination_report(found: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """The digest columns: id_col, n_words, n_hit, n_items, items_sha256, contaminated (one word in `share` is hit, or more)."""
    return found.select(
        *([id_col] if id_col in found.columns else ["doc"]), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )

