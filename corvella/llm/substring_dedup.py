"""Substring deduplication by automata of repeated phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvella.llm.common import release
from corvella.llm.textops import NOT_SPACE, Runs, Words
from corvella.llm.windows import Pieces, Scheme, numbered, removed_mask, repeated_spans, with_spans

#: Phrases that one automaton is compiled of.
AUTOMATON_PHRASES = 50_000


def _letters(words: Words) -> list[str]:
    """Each text as a string with one character for each word; equal words have equal characters."""
    one, two = words.hash, Runs(words.data, 1).hash(words.start, words.end)
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    if not (two[first][number] == two).all():  # words that differ have equal hashes
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(words.data[s:e].tobytes(), len(known)) for s, e in zip(words.start, words.end, strict=True)])
    number = number.astype(np.uint32)
    number[number >= 0xD800] += np.uint32(0x800)  # there are no characters D800 to DFFF
    whole = number.tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False)]


def locate(width: int):
    """The method: which windows of a block of pieces occur earlier, as (pieces, first words, numbers of windows).

    Recurring passages are confirmed first, by the hashes of windows: a window that two different pieces have, or one twice, is
    a phrase; a piece with several places is one as a whole, for its windows that no other has. From these automata of at most
    AUTOMATON_PHRASES phrases are compiled (a letter stands for a word), and all pieces are streamed through them, which
    locates every occurrence exactly. Of a window's places all but the first by (id, place) are returned.
    """

    def confirm(pieces: list[bytes], anchor: np.ndarray, id_: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own = Pieces(pieces)
        words = Words(own.text, NOT_SPACE, lower=False)
        hashes = Runs(words.hash).grams(width)
        at = np.arange(len(hashes))
        piece = np.searchsorted(words.first, at, side="right") - 1
        inside = at + width <= words.first[piece + 1]
        at, piece, hashes = at[inside] - words.first[piece[inside]], piece[inside], hashes[inside]
        _, index, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        shared, several = counts[inverse] > 1, own.n[piece] > 1
        letters = _letters(words)
        phrases = [letters[p][a : a + width] for p, a in zip(piece[index[counts > 1]].tolist(), at[index[counts > 1]].tolist(), strict=True)]
        whole = set(phrases)
        phrases += [x for x in (letters[p] for p in np.unique(piece[several & ~shared]).tolist()) if x not in whole]
        streamed = np.unique(piece[shared | several]).tolist()
        for low in range(0, len(phrases), AUTOMATON_PHRASES):
            automaton = ahocorasick.Automaton()
            for k, phrase in enumerate(phrases[low : low + AUTOMATON_PHRASES]):
                automaton.add_word(phrase, (k, len(phrase)))
            automaton.make_automaton()
            found = [(k, n, p, end - n + 1) for p in streamed for end, (k, n) in automaton.iter(letters[p])]
            if not found:
                continue
            phrase, size, text, unit = np.array(found, np.int64).T
            n = size - width + 1  # windows of a phrase: one, or those of a whole piece
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            phrase, text, unit = phrase[row] * (int(n.max()) + 1) + offset, text[row], unit[row] + offset
            row, where, unit = own.places(text, unit)
            phrase, doc, place = phrase[row], id_[where], start[where] + unit
            by = np.lexsort((place, doc, phrase))
            new = np.diff(phrase[by], prepend=-1) != 0
            lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            late = by[(doc[by] != doc[lead]) | (place[by] != place[lead])]
            yield where[late], unit[late], np.ones(len(late), np.int64)

    return confirm


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, digests = [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            raw = (text.as_py() or "").encode()
            words = Words([raw], NOT_SPACE, lower=False)
            gone = removed_mask(len(words.start), spans)
            left = b" ".join([raw[s:e] for s, e in zip(words.start[~gone].tolist(), words.end[~gone].tolist(), strict=True)])
            n_words.append(len(gone))
            n_removed.append(int(gone.sum()))
            kept.append(left.decode())
            digests.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_pydict({"row": batch["row"], "text": pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, gram: int = 6) -> DataFrame:
    """One row per row of `docs`: id_col, text (kept words joined by one space), n_words, n_removed, kept_sha256. Other columns are neither read nor returned.

    Words are what ASCII white space separates, unchanged. Every word covered by a run of `width` words that also starts
    earlier (smaller id, or earlier in the same document) is removed; runs are judged on the input.

    `windows` finds recurring passages and sends the text around their anchors to the shard of the anchor; there automata
    confirm and locate every occurrence (`locate`). So each document passes through the automata of just those shards whose
    phrases it can hold, and an automaton's size is bounded however large the corpus.

    * A null or empty text has no words. A document of fewer than `width` words stays whole.
    * Null ids rank below all others. Rows that repeat an id are told apart by place only; rows alike in id and text get
      the same result, neither being earlier than the other. An empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows.select("id", "th", "text"), Scheme(width, gram, of_words=True), locate(width))
    release(docs.sparkSession)
    cut = with_spans(rows, spans).mapInArrow(_cut, "row long, text string, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumnRenamed("row", id_col)
