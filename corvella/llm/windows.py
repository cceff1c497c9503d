"""First occurrences of fixed-size windows over a whole corpus, without a row for each window.

Two windows can only be equal if they have the same anchor: the run of `gram` units in the window with the least hash (the
leftmost of equals). Neighbouring windows mostly share one, so a document is cut into contexts - an anchor and all units
of the windows that have it - of which there is one for about every (window - gram) / 2 units:

1. Scan: a row for each context: hash of the anchor, document, place.
2. Contexts meet by anchor. One that is alone has nothing repeated and is set aside; this is all that hashes decide.
3. The text of the others is fetched and goes by anchor to an operator's own method, which finds in blocks of whole anchors
   the windows that occur earlier.
4. Spans are gathered by document and cut out of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded_batches, join_facts, materialize, release, safe_id
from corvella.llm.textops import NOT_SPACE, Runs, Words, slices

#: Contexts of one anchor that one task may get; those of anchors with more are compared window by window, byte by byte, in as many tasks as it takes.
GROUP_LIMIT = 100_000
#: Contexts among which a scan looks for anchors that repeat before they are exchanged.
TOGETHER = 500_000
#: Bytes of context text that are confirmed together.
BLOCK_BYTES = 4 << 20
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)

CONTEXTS = "kind int, anchor long, id long, th long, start long, stop long"
SPANS = "id long, th long, start long, stop long"


@dataclass(frozen=True)
class Scheme:
    """What a window is: `window` units, each a byte or a word, anchored by runs of `gram` units."""

    window: int
    gram: int
    of_words: bool

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of some texts one after the other, and where each text's begin."""
        if self.of_words:
            words = Words(texts, NOT_SPACE, lower=False)
            return words.hash, words.first.astype(np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def cutter(self, text: bytes) -> tuple[bytes, np.ndarray, int]:
        """(whole, begin, gap): units [a, b) of a text are whole[begin[a] : begin[b] - gap]; words are joined by one space."""
        if not self.of_words:
            return text, np.arange(len(text) + 1), 0
        words = Words([text], NOT_SPACE, lower=False)
        begin = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
        return words.text(0, len(words.start)) + b" ", begin, 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def contexts(units: np.ndarray, first: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, start, stop) of each context; places count from the document's first unit."""
    n, w = len(units), scheme.window
    sizes = np.diff(first)
    if n < w or not (sizes >= w).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    runs = Runs(units)
    grams = runs.grams(scheme.gram)
    least = sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), w - scheme.gram + 1)
    ends = np.zeros(n + 1, np.int64)
    some = sizes >= w
    np.add.at(ends, first[:-1][some], 1)
    np.add.at(ends, first[1:][some] - w + 1, -1)
    starts = np.flatnonzero(np.cumsum(ends[:-1]) > 0)  # of windows inside one document
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = (np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1)
    new |= np.isin(starts, first[:-1][some])
    at = np.flatnonzero(new)
    start, stop = starts[at], starts[np.append(at[1:], len(starts)) - 1] + w
    doc = np.searchsorted(first, start, side="right") - 1
    return doc, grams[anchor[at]].view(np.int64), start - first[doc], stop - first[doc]


def merged(id_: np.ndarray, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the same document that overlap or touch, united."""
    if not len(id_):
        return id_, th, start, stop
    by = np.lexsort((start, th, id_))
    id_, th, start, stop = id_[by], th[by], start[by], stop[by]
    new_doc = np.concatenate([[True], (np.diff(id_) != 0) | (np.diff(th) != 0)])
    shift = np.cumsum(new_doc) * (int(stop.max()) + 2)  # documents one after the other on one line
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(id_)) - 1
    return id_[at], th[at], start[at], (reach - shift)[last]


def _first_flags(keys: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


#: Kinds of rows: an anchor met once in a batch; one of several there, which stands for all; the others of these.
ONE, FIRST, MORE = 0, 1, 2


def _scan(scheme: Scheme):
    """A row for each context. Of an anchor that is everywhere each batch sends one row to the others; the rest only pass through."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        parts: list[tuple] = []
        for batch in batches:
            ids, ths = batch["id"].to_numpy(), batch["th"].to_numpy()
            for begin, texts in slices(batch["text"]):
                doc, *rest = contexts(*scheme.units(texts), scheme)
                parts.append((ids[begin + doc], ths[begin + doc], *rest))
            if sum(len(p[0]) for p in parts) > TOGETHER:
                yield parts
                parts = []
        if parts:
            yield parts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in found(batches):
            id_, th, anchor, start, stop = (np.concatenate(p) for p in zip(*parts, strict=True))
            by = np.argsort(anchor)
            first = _first_flags([anchor[by]])
            alone = first & np.append(first[1:], True)
            kind = np.empty(len(by), np.int32)
            kind[by] = np.where(alone, ONE, np.where(first, FIRST, MORE))
            yield _batch({"kind": kind, "anchor": anchor, "id": id_, "th": th, "start": start, "stop": stop})

    return run


def _meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> those whose anchor has several; an anchor that a row of kind MORE has is one of these. It holds one batch, and the last row as long as its anchor is alone."""
    held: pa.RecordBatch | None = None
    last: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, anchor = batch["kind"].to_numpy(), batch["anchor"].to_numpy()
        same = anchor[1:] == anchor[:-1]
        meets = np.concatenate([[anchor[0] == last], same]) | np.concatenate([same, [False]]) | (kind != ONE)
        if held is not None and anchor[0] == last:
            yield held
        if meets.any():
            yield batch.filter(pa.array(meets))
        held, last = (None if meets[-1] else batch.slice(batch.num_rows - 1, 1)), int(anchor[-1])


def _extract(scheme: Scheme):
    """The texts of documents' contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["places"]
            edges = places.offsets.to_numpy() - places.offsets[0].as_py()
            flat = places.flatten()
            anchor, start, stop = (flat.field(n).to_numpy() for n in ("anchor", "start", "stop"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            pieces: list[bytes] = []
            size = done = 0

            def told(upto: int, done: int, pieces: list[bytes]) -> pa.RecordBatch:
                own, picked = slice(done, upto), pa.array(row[done:upto])
                return pa.RecordBatch.from_pydict({"anchor": pa.array(anchor[own]), "id": batch["id"].take(picked), "th": batch["th"].take(picked), "start": pa.array(start[own]), "piece": pa.array(pieces, pa.binary())})  # noqa: B023

            for i, text in enumerate(batch["text"]):
                whole, begin, gap = scheme.cutter((text.as_py() or "").encode())
                own = slice(edges[i], edges[i + 1])
                pieces += [whole[x:y] for x, y in zip(begin[start[own]].tolist(), (begin[stop[own]] - gap).tolist(), strict=True)]
                size += int((begin[stop[own]] - begin[start[own]]).sum())
                if size > BLOCK_BYTES:
                    yield told(int(edges[i + 1]), done, pieces)
                    pieces, size, done = [], 0, int(edges[i + 1])
            yield told(int(edges[-1]), done, pieces)

    return run


class Pieces:
    """Different texts among some pieces, and the places of each: equal ones are worked on once. `text`: the different ones; `n`: how many places each has."""

    def __init__(self, pieces: list[bytes]):
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        self.text = list(number)
        self.order = np.argsort(of, kind="stable")
        self.n = np.bincount(of, minlength=len(number))
        self.begin = np.cumsum(self.n) - self.n

    def places(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, piece, unit): for each (text, unit) all its places; row numbers what was given."""
        n = self.n[text]
        row = np.repeat(np.arange(len(text)), n)
        piece = self.order[np.repeat(self.begin[text], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        return row, piece, at[row]


Confirm = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _confirm(scheme: Scheme, confirm: Confirm):
    """Run an operator's method over blocks of whole anchors; its runs of windows (piece, first unit, number of windows) become spans."""

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        id_, th, start = (t[n].to_numpy() for n in ("id", "th", "start"))
        found = list(confirm(t["piece"].to_pylist(), t["anchor"].to_numpy(), id_, start))
        piece, at, n = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        i, h, a, b = merged(id_[piece], th[piece], start[piece] + at, start[piece] + at + n + (scheme.window - 1))
        return _batch({"id": i, "th": h, "start": a, "stop": b})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch["anchor"].to_numpy()
            if size > BLOCK_BYTES:  # a block may end where an anchor does
                cut = int(np.searchsorted(np.cumsum(_first_flags([anchor])), 2)) if held and held[-1]["anchor"][-1].as_py() == anchor[0] else 0
                if cut < batch.num_rows:
                    yield spans([*held, batch.slice(0, cut)] if cut else held)
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch["piece"].nbytes
        if held:
            yield spans(held)

    return run


def _window_rows(scheme: Scheme):
    """Every window of some pieces as a row with its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, th, start, piece in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["start"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                whole, begin, gap = scheme.cutter(piece)
                n = len(begin) - scheme.window
                windows = pa.array([whole[begin[i] : begin[i + scheme.window] - gap] for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_pydict({"window": windows, "id": pa.array(np.full(n, id_, np.int64)), "th": pa.array(np.full(n, th, np.int64)), "start": pa.array(start + np.arange(n))})

    return run


def repeated_spans(docs: DataFrame, scheme: Scheme, confirm: Confirm) -> DataFrame:
    """The spans (id, th, start, stop) of `docs` (id, th, text) that windows occurring earlier cover."""
    bounded_batches(docs.sparkSession)
    scanned = docs.mapInArrow(_scan(scheme), CONTEXTS)
    more = F.col("kind") == MORE
    dealt = scanned.repartition(F.when(more, F.xxhash64("id", "start")).otherwise(F.col("anchor")))
    met = materialize(dealt.sortWithinPartitions("anchor").mapInArrow(_meeting, CONTEXTS).drop("kind"))
    release(docs.sparkSession)
    crowds = met.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_LIMIT)
    n_crowds = crowds.count()
    wanted = met.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "start", "stop")).alias("places"))  # a document's own
    pieces = docs.join(wanted, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(_extract(scheme), "anchor long, id long, th long, start long, piece binary")
    known: DataFrame | None = None
    if n_crowds:  # fewer than (contexts / GROUP_LIMIT) anchors
        pieces = materialize(pieces)
        crowded = pieces.join(F.broadcast(crowds) if n_crowds < 100_000 else crowds, "anchor").drop("n")
        pieces = pieces.join(F.broadcast(crowds) if n_crowds < 100_000 else crowds, "anchor", "left_anti")
        rows = crowded.mapInArrow(_window_rows(scheme), "window binary, id long, th long, start long")
        firsts = materialize(rows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("id", "start")).alias("first")).where("n > 1"))
        late = join_facts(rows, firsts, "window", "n").where(F.struct("id", "start") > F.col("first"))
        known = late.select("id", "th", "start", (F.col("start") + scheme.window).alias("stop"))
    confirmed = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_confirm(scheme, confirm), SPANS)
    return materialize(confirmed if known is None else known.unionByName(confirmed))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (id, th, text, row): `th` tells texts apart where ids repeat, and is 0 throughout where none does."""
    ids = docs.select(safe_id(id_col).alias("id"))
    repeats = not ids.groupBy("id").count().where("count > 1").isEmpty()
    th = F.coalesce(F.xxhash64(text_col), F.lit(0)) if repeats else F.lit(0)
    return docs.select(safe_id(id_col).alias("id"), th.cast("long").alias("th"), F.col(text_col).alias("text"), F.col(id_col).alias("row"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of `docs` with its spans, an array of (start, stop) or null."""
    own = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # no more than the document has units
    return docs.join(own, ["id", "th"], "left").select(F.col("row").cast("long"), "text", "spans")


def removed_mask(n: int, spans: pa.Scalar) -> np.ndarray:
    """Which of n units spans cover."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
    np.add.at(edge, spans.values.field("stop").to_numpy(), -1)
    return np.cumsum(edge[:-1]) > 0
