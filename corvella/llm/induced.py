"""External induced suffix sorting with common-prefix values.

Suffixes are L (greater than the next suffix) or S (smaller); S* are those S whose left neighbour is L. Sorted S* suffixes
induce the order of all L, and these that of all S: whoever precedes the next smallest (largest) suffix is the next in the
bucket of its own first symbol. Suffix tuples (position, common prefix with the one before) wait in priority queues over
symbols, which keep what exceeds their memory on disk; all tuples of the least symbol leave together, so the work is done
on arrays. S* are sorted by the same induction applied to their substrings, then to the string of the substrings' names,
and so on until the names fit in memory. The common prefix of two induced suffixes is one more than the least among the
suffixes between those that induced them, which is carried along for each bucket.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from corvella.llm.textops import Runs

#: Tuples that a queue keeps in memory, and names that are sorted in memory.
MEMORY_ITEMS = 8 << 20
_FAR = np.int64(1 << 60)


class SymbolQueue:
    """A priority queue of (position, common prefix) arrays by symbol, first in first out within one; the rest is on disk."""

    def __init__(self, folder: str, memory_items: int, largest_first: bool = False):
        self.sign = -1 if largest_first else 1
        self.folder, self.memory_items = tempfile.mkdtemp(dir=folder), memory_items
        self.heap: list[int] = []
        self.waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        self.spilled: set[int] = set()
        self.items = 0

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if symbol not in self.waiting and symbol not in self.spilled:
            heapq.heappush(self.heap, self.sign * symbol)
        self.waiting[symbol].append(np.stack([position, prefix]))
        self.items += len(position)
        if self.items > self.memory_items:
            self._spill()

    def _spill(self) -> None:
        for symbol, parts in self.waiting.items():
            with open(os.path.join(self.folder, str(symbol)), "ab") as f:
                for part in parts:
                    f.write(np.ascontiguousarray(part.T).tobytes())
            self.spilled.add(symbol)
        self.waiting.clear()
        self.items = 0

    def least(self) -> int | None:
        """The symbol whose turn it is."""
        return self.sign * self.heap[0] if self.heap else None

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """All that waits at a symbol, in order of arrival; what arrives meanwhile waits for the next call."""
        if symbol not in self.waiting and symbol not in self.spilled:
            return
        self.heap.remove(self.sign * symbol) if self.heap[0] != self.sign * symbol else heapq.heappop(self.heap)
        heapq.heapify(self.heap)
        parts = self.waiting.pop(symbol, [])
        self.items -= sum(p.shape[1] for p in parts)
        if symbol in self.spilled:
            self.spilled.remove(symbol)
            path = os.path.join(self.folder, str(symbol))
            os.rename(path, path + ".taken")
            with open(path + ".taken", "rb") as f:
                while block := f.read(16 * self.memory_items):
                    yield np.frombuffer(block, np.int64).reshape(-1, 2).T
            os.remove(path + ".taken")
        if parts:
            yield np.concatenate(parts, axis=1)


class _Carried:
    """For each bucket, the least common prefix met since its last tuple."""

    def __init__(self, sigma: int):
        self.least = np.zeros(sigma, np.int64)

    def induce(self, symbols: np.ndarray, from_: np.ndarray, prefix: np.ndarray, cap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each symbol that precedes members of a sequence: their places in it, and the induced common prefixes."""
        overall = prefix.min()
        by = np.argsort(symbols, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(symbols[by])) + 1) if len(by) else []
        renewed = {}
        for group in groups:
            d, at = int(symbols[group[0]]), from_[group]
            ends = np.append(0, at + 1)
            tail = _FAR
            if ends[-1] == len(prefix):
                least = np.minimum.reduceat(prefix, ends[:-1])
            else:
                least = np.minimum.reduceat(prefix, ends)
                tail, least = least[-1], least[:-1]
            least[0] = min(least[0], self.least[d])
            renewed[d] = tail
            yield d, at, np.minimum(least + 1, cap)
        np.minimum(self.least, overall, out=self.least)
        for d, tail in renewed.items():
            self.least[d] = tail


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last one is."""
    n = len(text)
    up = np.ones(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])  # the type of i is that of the last of its run of equal symbols
    differs = np.zeros(n, np.int64)
    differs[change] = 1
    nxt = np.cumsum(differs) - differs  # which change is the next one from here
    inside = nxt < len(change)
    at = change[nxt[inside]]
    up[inside] = text[at] < text[at + 1]
    return up


def _run_length(text: np.ndarray, at: int, cap: int) -> int:
    n = 1
    while n < cap and at + n < len(text) and text[at + n] == text[at]:
        n += 1
    return n


def _induce(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, star_prefix: np.ndarray, sigma: int, cap: int, folder: str, memory: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All suffixes by buckets from the largest symbol to the least: (symbol, positions in ascending order, common prefixes)."""
    starts = np.searchsorted(text[stars], np.arange(sigma + 1)) if sigma <= 1 << 16 else None
    star_symbols = text[stars]

    def stars_of(c: int) -> tuple[int, int]:
        return (int(starts[c]), int(starts[c + 1])) if starts is not None else tuple(np.searchsorted(star_symbols, [c, c + 1]).tolist())

    queue, left = SymbolQueue(folder, memory), SymbolQueue(folder, memory, largest_first=True)
    carried, last = _Carried(sigma), {}

    def step(position: np.ndarray, prefix: np.ndarray, to: SymbolQueue, valid: np.ndarray) -> None:
        from_ = np.flatnonzero(valid)
        before = position[from_] - 1
        for d, at, induced in carried.induce(text[before], from_, prefix, cap):
            to.push(d, position[at] - 1, induced)

    nonempty = np.unique(star_symbols).tolist()[::-1]
    while nonempty or queue.least() is not None:
        c = min(x for x in (nonempty[-1] if nonempty else None, queue.least()) if x is not None)
        fresh = True
        while queue.least() == c:
            for part in queue.take(c):
                position, prefix = part[0], part[1].copy()
                if fresh:
                    prefix[0], fresh = 0, False
                left.push(c, position, prefix)
                last[c] = int(position[-1])
                step(position, prefix, queue, (position > 0) & (text[position - 1] >= text[position]))
        if nonempty and nonempty[-1] == c:
            nonempty.pop()
            a, b = stars_of(c)
            prefix = star_prefix[a:b].copy()
            prefix[0] = 0 if fresh else min(_run_length(text, last[c], cap), _run_length(text, int(stars[a]), cap))
            step(stars[a:b], prefix, queue, (stars[a:b] > 0) & ~is_s[stars[a:b] - 1])

    queue, carried = SymbolQueue(folder, memory, largest_first=True), _Carried(sigma)
    # the last suffix is the least of all; it is induced by none, and what precedes it is L
    end = np.array([len(text) - 1])
    while queue.least() is not None or left.least() is not None or end is not None:
        waiting = [x for x in (queue.least(), left.least()) if x is not None]
        c = max(waiting) if waiting else int(text[-1])
        if end is not None and c <= int(text[-1]):
            c = int(text[-1])
        descending: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = True
        while queue.least() == c:
            for part in queue.take(c):
                position, prefix = part[0], part[1].copy()
                if c == 0:  # symbol 0 ends a string: it shares nothing
                    prefix[:] = 0
                if fresh:
                    prefix[0], fresh = 0, False
                descending.append((position, prefix))
                step(position, prefix, queue, (position > 0) & (text[position - 1] <= text[position]))
        if end is not None and c == int(text[-1]):
            descending.append((end, np.zeros(1, np.int64)))
            end, fresh = None, False
        lower = [p for p in left.take(c)] if left.least() == c else []
        edge = 0
        if lower:
            position = np.concatenate([p[0] for p in lower])
            prefix = np.concatenate([p[1] for p in lower])
            if not fresh:
                edge = min(_run_length(text, int(position[-1]), cap), _run_length(text, int(descending[-1][0][-1]), cap))
            step(position[::-1], np.append(edge, prefix[:0:-1]), queue, ((position > 0) & (text[position - 1] < text[position]))[::-1])
        upper = np.concatenate([p for p, _ in descending]) if descending else np.zeros(0, np.int64)
        upper_prefix = np.concatenate([x for _, x in descending]) if descending else np.zeros(0, np.int64)
        ascending = np.append(upper_prefix[1:], edge)[::-1] if len(upper) else upper_prefix
        if lower:
            yield c, np.concatenate([position, upper[::-1]]), np.concatenate([prefix, ascending])
        elif len(upper):
            yield c, upper[::-1], ascending


def _by_doubling(names: np.ndarray, symbols: int) -> np.ndarray:
    """The order of the suffixes of a string of names by their first `symbols` names at least."""
    rank, step = names.astype(np.int64), 1
    while True:
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:] if step < len(rank) else after[: max(len(rank) - step, 0)]
        key = (rank + 1) * (int(rank.max()) + 2) + after + 1
        order = np.argsort(key)  # equal ones stand together in any order
        rank = np.zeros(len(key), np.int64)
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        step *= 2
        if step >= symbols or step >= len(rank) or rank[order[-1]] == len(rank) - 1:
            return order


def _star_order(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, sigma: int, depth: int, folder: str, memory: int) -> np.ndarray:
    """S* suffixes sorted by `depth` symbols at least: induce their substrings, name these, and sort the string of names."""
    by_symbol = stars[np.argsort(text[stars], kind="stable")]
    member = np.zeros(len(text), bool)
    member[stars] = True
    found = [p[member[p]] for _, p, _ in _induce(text, is_s, by_symbol, np.zeros(len(stars), np.int64), sigma, 1, folder, memory)]
    order = np.concatenate(found[::-1])
    index = np.searchsorted(stars, order)
    stop = np.append(stars[1:] + 1, len(text))
    body = Runs(text).hash(stars, stop)
    name = np.zeros(len(stars), np.int64)
    name[index] = np.cumsum(np.append(0, body[index][1:] != body[index][:-1]))
    if name.max() == len(name) - 1:
        return order
    if len(name) <= memory:
        return stars[_by_doubling(name, depth // 2 + 2)]
    parts = [p for _, p, _ in sorted_suffixes(name, int(name.max()) + 1, 1, folder, memory, depth // 2 + 2)]
    return stars[np.concatenate(parts[::-1])]


def _common_prefix(text: np.ndarray, order: np.ndarray, cap: int, end: int) -> np.ndarray:
    """Common prefixes of neighbours, up to cap and not beyond the symbol `end`."""
    out = np.zeros(len(order), np.int64)
    padded = np.concatenate([text, np.full(cap + 16, end, text.dtype)])
    open_ = np.arange(1, len(order))
    depth, ahead = 0, np.arange(16)
    while len(open_) and depth < cap:
        keep = []
        for low in range(0, len(open_), 1 << 16):
            i = open_[low : low + (1 << 16)]
            a = padded[(order[i] + depth)[:, None] + ahead]
            same = (a == padded[(order[i - 1] + depth)[:, None] + ahead]) & (a != end)
            n = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            out[i] += n
            keep.append(i[n == 16])
        open_ = np.concatenate(keep)
        depth += 16
    return np.minimum(out, cap)


def sorted_suffixes(text: np.ndarray, sigma: int, cap: int, folder: str, memory: int = MEMORY_ITEMS, depth: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Suffixes of a sequence of symbols below sigma, bucket by bucket from the largest symbol down.

    A bucket is (symbol, positions in ascending order of suffixes, common prefix of each with the one before). Symbol 0
    ends a string: common prefixes stop there. Order and common prefixes are exact up to `cap` symbols (the order up to
    `depth`); suffixes that agree so far stand together. The sequence ends in 0, as its last string does. Queues spill to `folder` beyond `memory` tuples.
    """
    if not len(text) or text[-1] != 0 or (len(text) > 1 and text[-2] == 0):
        raise ValueError("the last string must not be empty, and symbol 0 must end it")
    depth = depth or cap
    is_s = _types(text)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(stars):  # symbols never rise: each suffix is larger than the next
        stars = np.array([len(text) - 1])
    elif stars[-1] != len(text) - 1:
        stars = np.append(stars, len(text) - 1)
    order = _star_order(text, is_s, stars, sigma, depth, folder, memory)
    yield from _induce(text, is_s, order, _common_prefix(text, order, cap, 0), sigma, cap, folder, memory)
