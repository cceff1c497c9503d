"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded_batches, join_facts, materialize, safe_id
from corvella.llm.textops import Runs, slices


def _windows(width: int):
    """(_id, _th, pos, window): two independent 64-bit hashes of each run of `width` consecutive lines, from the lines up, and the number of its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch["text"]):
                data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                end = np.flatnonzero(data == 10)
                start = np.append(0, end[:-1] + 1)
                first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # of each text's lines
                one, two = (Runs(Runs(data, which).hash(start, end), which).grams(width) for which in (0, 1))
                at = np.arange(len(one))
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + width <= first[doc + 1]
                at, doc = at[inside], doc[inside]
                keys = pa.py_buffer(np.stack([one[at], two[at]], axis=1).tobytes())
                picked = pa.array(begin + doc)
                yield pa.RecordBatch.from_pydict({
                    "_id": batch["_id"].take(picked), "_th": batch["_th"].take(picked), "pos": pa.array((at - first[doc]).astype(np.int32)),
                    "window": pa.Array.from_buffers(pa.binary(16), len(at), [None, keys]).cast(pa.binary()),
                })

    return run


def _cut(width: int):
    schema = pa.schema([("row", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for row, text, starts in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), batch["starts"], strict=True):
                lines = text.split("\n") if text else []
                gone = np.zeros(len(lines) + 1, dtype=np.int32)
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                removed = np.cumsum(gone[:-1]) > 0
                spans = int(np.count_nonzero(removed & ~np.concatenate([[False], removed[:-1]]))) if len(lines) else 0
                left = "\n".join(x for x, r in zip(lines, removed, strict=True) if not r) if removed.any() else text or ""
                for column, v in zip(out, (row, left, len(lines), int(removed.sum()), spans, hashlib.sha256(left.encode()).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return cut


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of `docs`: id_col, text (what is left), n_lines, n_removed, n_spans, kept_sha256. Other columns are neither read nor returned.

    Lines are what newlines separate, compared unchanged. A window is `width` consecutive lines of one document. Of all
    places of a window the first stays (smallest id, then earliest line); every line covered by a later one is removed.
    Windows are judged on the input. Overlapping later windows merge into spans.

    * A null or empty text has no lines; a document of fewer than `width` lines has no window and stays whole.
    * Null ids rank below all others. Rows that repeat an id are places of one document: the earlier line is the first,
      and rows alike in id and text get the same result, neither being earlier than the other.
    * Windows are counted by hash with partial sums before the shuffle, so one that is everywhere costs each task a row.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("row"), safe_id(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("text"))
    found = rows.select("_id", "_th", "text").mapInArrow(_windows(width), "_id long, _th long, pos int, window binary")
    repeated = materialize(found.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("_id", "pos")).alias("first")).where("n > 1"))
    places = join_facts(found, repeated, "window", "n").where((F.col("n") > 1) & (F.struct("_id", "pos") > F.col("first")))
    starts = places.groupBy("_id", "_th").agg(F.collect_set("pos").alias("starts"))  # no more than one document has windows
    joined = rows.join(starts, ["_id", "_th"], "left").select(F.col("row").cast("long"), "text", "starts")
    cut = joined.mapInArrow(_cut(width), "row long, text string, n_lines long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumnRenamed("row", id_col)
