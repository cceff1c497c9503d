"""Suffix-array deduplication by external induced sorting."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvella.llm.common import release
from corvella.llm.induced import MEMORY_ITEMS, sorted_suffixes
from corvella.llm.windows import Pieces, Scheme, numbered, removed_mask, repeated_spans, with_spans


def _later(group: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which members of each group come after its first one by (doc, place)."""
    by = np.lexsort((place, doc, group))
    new = np.diff(group[by], prepend=-1) != 0
    lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return by[(doc[by] != doc[lead]) | (place[by] != place[lead])]


def later_windows(width: int, memory: int = MEMORY_ITEMS):
    """The method: which windows of a block of pieces occur earlier, as (pieces, first bytes, numbers of windows).

    The different pieces, each ended by symbol 0, are one string. Where neighbours in its suffix array share `width` bytes
    or more, their windows are equal, and those of a piece with several places are equal to themselves elsewhere; of such
    a run's places all but the first by (id, place) are returned.
    """

    def confirm(pieces: list[bytes], anchor: np.ndarray, id_: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own = Pieces(pieces)
        data = np.frombuffer(b"\0".join(own.text) + b"\0", np.uint8)
        sizes = np.array([len(p) + 1 for p in own.text])
        begins = np.cumsum(sizes) - sizes
        text = data.astype(np.uint16) + np.uint16(1)
        text[begins + sizes - 1] = 0
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        again = (own.n > 1)[of] & (np.arange(len(of)) + width < (begins + sizes)[of])  # windows with several places, whatever their neighbours are
        alone = np.zeros(len(text) + 1, bool)  # of these, the ones that no neighbour in the suffix array shares
        with tempfile.TemporaryDirectory() as folder:
            for _, position, prefix in sorted_suffixes(text, 257, width, folder, memory):
                joined = prefix >= width
                member = joined | np.append(joined[1:], False)
                alone[position] = again[position] & ~member
                if not member.any():
                    continue
                position, group = position[member], np.cumsum(~joined)[member]
                piece = of[position]
                row, piece, at = own.places(piece, position - begins[piece])
                late = _later(group[row], id_[piece], start[piece] + at)
                yield piece[late], at[late], np.ones(len(late), np.int64)
        edge = np.flatnonzero(np.diff(alone, prepend=False))
        first, last = edge[0::2], edge[1::2]  # runs of windows end where their piece does, or before
        piece = of[first]
        row, piece, at = own.places(piece, first - begins[piece])
        late = _later(row, id_[piece], start[piece] + at)
        yield piece[late], at[late], (last - first)[row[late]]

    return confirm


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, n_spans, kept, digests = [], [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            gone = removed_mask(len(raw), spans)
            left = raw[~gone].tobytes()
            sizes.append(len(raw))
            removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(raw) else 0)
            kept.append(left)
            digests.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_pydict({"row": batch["row"], "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 32) -> DataFrame:
    """One row per row of `docs`: id_col, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256. Other columns are neither read nor returned.

    Texts are UTF-8 bytes. Every byte covered by a string of `width` bytes that also starts earlier (smaller id, or earlier
    in the same document) is removed; strings are judged on the input and never cross documents. What is left may begin or
    end within a character, hence bytes.

    `windows` sets aside what cannot be repeated and brings text that may be to the shard of its anchor; there external
    induced sorting (`induced`) builds the shard's suffix array with common prefixes, which shows every repeated string.

    * A null or empty text has no bytes. A text of fewer than `width` bytes stays whole.
    * Null ids rank below all others. Rows that repeat an id are told apart by place only; rows alike in id and text get
      the same result, neither being earlier than the other. An empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows.select("id", "th", "text"), Scheme(width, gram, of_words=False), later_windows(width))
    release(docs.sparkSession)
    cut = with_spans(rows, spans).mapInArrow(_cut, "row long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return cut.withColumnRenamed("row", id_col)
