"""Vectorised work on batches of texts as UTF-8 bytes: words, hashes of words and of runs of units."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
_PRIME = np.uint64((1 << 31) - 1)
#: Two independent streams of a hash, for each of two hashes: bases drawn once at random below the prime (fixed values).
_BASES = ((1_284_865_837, 603_472_391), (1_937_042_159, 1_106_289_641))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(pattern: bytes) -> np.ndarray:
    """A table of 256 booleans: which bytes a regular expression for one byte matches."""
    return np.array([re.fullmatch(pattern, bytes([b])) is not None for b in range(256)])


#: Words of decontamination and of near-duplicates; the text is lower-cased first (A-Z alone).
WORD = byte_class(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Words of substring deduplication.
NOT_SPACE = byte_class(rb"[^\x20\x09-\x0D]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_kept: dict[str, object] = {}


def kept_by_worker(key: str, build: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one thing at a time, so that operators in turn don't add up in memory."""
    if key not in _kept:
        let_go()
        _kept[key] = build()
    return _kept[key]


def let_go() -> None:
    """Drop what an earlier operator has kept in this worker, and hand its memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform.startswith("linux"):
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)  # of glibc


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) of about SLICE_BYTES together: the number of the first, and the texts' bytes.

    Who works on slices keeps nothing between tasks; what an earlier operator has kept is let go."""
    let_go()
    found = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    first = size = 0
    for i, x in enumerate(found):
        if size and size + len(x) > SLICE_BYTES:
            yield first, found[first:i]
            first = i
            size = 0
        size += len(x)
    if first < len(found):
        yield first, found[first:]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo the prime for i below n or more."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size, out = max(n, SLICE_BYTES + 4096), []
        for b in (base, pow(base, -1, int(_PRIME))):
            p = np.ones(size, np.uint32)
            have = 1
            while have < size:
                step = min(have, size - have)
                p[have : have + step] = p[:step] * np.uint64(pow(b, have, int(_PRIME))) % _PRIME
                have += step
            out.append(p)
        known = _powers[base] = out[0], out[1]
    return known


class Runs:
    """Hashes of runs [start, end) of a sequence of numbers: equal runs have equal hashes wherever they start.

    A hash is two polynomials modulo the prime 2**31 - 1 in bases drawn at random, so no family of strings is prone to
    collide (as some are modulo a power of two): two runs of n units do with a probability of at most (n / 2**31)**2.
    Numbers of 64 bits must be hashes themselves; each polynomial takes a half of their bits. The hashes of `which` 0 and 1
    are independent of each other.
    """

    def __init__(self, units: np.ndarray, which: int = 0):
        n = len(units)
        halves = (units & _PRIME, units >> np.uint64(33)) if units.dtype == np.uint64 else (units, units)
        self.streams = []
        for base, unit in zip(_BASES[which], halves, strict=True):
            up, down = powers(base, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            term = unit.astype(np.uint64)
            term += np.uint64(1)
            term *= up[:n]
            term %= _PRIME
            np.cumsum(term, out=sums[1:])
            self.streams.append((sums, down))

    def _joined(self, differences: list[np.ndarray], size: np.ndarray | np.uint64) -> np.ndarray:
        high, low = differences
        return mix((high << np.uint64(31) | low) ^ (size << np.uint64(32)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined([(sums[end] - sums[start]) % _PRIME * down[start] % _PRIME for sums, down in self.streams], (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of k units."""
        n = max(0, len(self.streams[0][0]) - k)
        return self._joined([(sums[k : k + n] - sums[:n]) % _PRIME * down[:n] % _PRIME for sums, down in self.streams], np.uint64(k))


class Words:
    """The words of some texts: `data` (the bytes, a space after each text), `start` and `end` of each word in it, `hash` of
    each word, and `first`: the number of each text's first word (and after the last text the number of all words)."""

    def __init__(self, texts: list[bytes], of: np.ndarray, lower: bool):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        inside = of[self.data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edges[0::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.hash = Runs(self.data).hash(self.start, self.end)

    def text(self, start: int, end: int) -> bytes:
        """Words start to end - 1, joined by one space."""
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[start:end], self.end[start:end], strict=True)])
