"""Byte-level BPE as a lazily determinised finite-state transducer, with streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded_batches
from corvella.llm.textops import kept_by_worker

#: Pieces that a worker remembers at most; of determinised states it keeps 2 for 5 pieces, of valid pairs 4.
MAX_PIECES = 500_000
#: States are met anew after so many times that the pieces were forgotten.
RENEWAL = 8
#: Rows that a worker encodes before it hands them on.
ROWS = 512
_ROOT = 0
_NEVER = 1 << 60
_NONE: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: on each line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Transducer:
    """Compiles the merges that `ranks` imply to a transducer from bytes to token ids, determinising states when first met.

    Byte-pair encodings are local: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are
    the encoding of theirs. So the nondeterministic machine has states (token before, trie node of the token being read),
    it may end a token wherever the trie does and the pair is valid, and of all its runs one alone ends at each byte.
    A determinised state is the set of runs that are still open, each with the tokens it has ended but not yet given out.
    What all open runs share is given out at once: lookahead is no longer than runs disagree, which the longest token bounds.
    """

    def __init__(self, ranks: dict[bytes, int], pieces: int = MAX_PIECES):
        self.max_states, self.max_pairs = pieces * 2 // 5, pieces * 4 // 5
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]  # of leaves: the same empty one
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            node = _ROOT
            for byte in text:
                node = self.children[node].get(byte) or self._grow(node, byte)
            self.token[node] = rank
        self.valid: dict[int, bool] = {}
        self.right: dict[int, tuple[bytes, ...]] = {}
        self.left: dict[int, tuple[bytes, ...]] = {}
        self.forget()

    def _grow(self, node: int, byte: int) -> int:
        self.children.append(_NONE)
        self.token.append(-1)
        if self.children[node] is _NONE:
            self.children[node] = {}
        self.children[node][byte] = len(self.token) - 1
        return len(self.token) - 1

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state and byte
        self.start = self._state((((), -1, _ROOT),))

    def _state(self, runs: tuple) -> int:
        n = self.number.get(runs)
        if n is None:
            n = self.number[runs] = len(self.states)
            self.states.append(runs)
        return n

    def merge(self, text: bytes, down_to: int = 1) -> list[bytes]:
        """The encoding by its definition: again and again join the neighbours whose union has the least rank."""
        parts, ranks = [text[i : i + 1] for i in range(len(text))], self.ranks
        while len(parts) > down_to:
            best, at = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> tuple[bytes, ...]:
        """The parts that lie at one end (0 left, -1 right) while merges build the token, from its first or last byte to itself."""
        out = [token]
        while len(token) > 1:
            token = self.merge(token, 2)[side]
            out.append(self.bytes_of.get(self.ranks.get(token, -1), token))
        return tuple(reversed(out))

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens; before -1: whether the token's own is the token.

        It is not if some part at the right end of the first and some part at the left end of the second live at the same
        time and have a union that ranks before what either is merged into (of equal ranks the left merge goes first). A
        part lives from its own rank (a byte: from the beginning) to the rank of the next larger part.
        """
        if before < 0:
            text = self.bytes_of[token]
            ok = self.merge(text) == [text]
        elif not self.may_follow(-1, token):
            ok = False
        else:
            rank, ok = self.ranks.get, True
            rights = self.right.get(before) or self.right.setdefault(before, self._edge(self.bytes_of[before], -1))
            lefts = self.left.get(token) or self.left.setdefault(token, self._edge(self.bytes_of[token], 0))
            i = j = 0
            while True:
                x, y = rights[i], lefts[j]
                x_end = rank(rights[i + 1]) if i + 1 < len(rights) else _NEVER
                y_end = rank(lefts[j + 1]) if j + 1 < len(lefts) else _NEVER
                z = rank(x + y)
                if z is not None and z < x_end and z <= y_end:
                    ok = False
                    break
                if x_end == y_end == _NEVER:
                    break
                i += x_end <= y_end
                j += y_end <= x_end
        self.valid[(before + 1) << 20 | token] = ok
        return ok

    def may_follow(self, before: int, token: int) -> bool:
        ok = self.valid.get((before + 1) << 20 | token)
        return self._may_follow(before, token) if ok is None else ok

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """Determinise one step: the runs open after it and the tokens given out on the way."""
        children, tokens, valid = self.children, self.token, self.valid
        runs, ended, empty = [], None, False
        for owed, before, node in state:
            node = children[node].get(byte)
            if node is None:
                continue
            if ended is None:
                token = tokens[node]
                if token >= 0:
                    ok = valid.get((before + 1) << 20 | token)
                    if self._may_follow(before, token) if ok is None else ok:
                        ended = (*owed, token)
            if children[node]:
                runs.append((owed, before, node))
                empty = empty or not owed
        if ended is not None:
            runs.append((ended, ended[-1], _ROOT))
        if empty:
            return tuple(runs), ()
        first = runs[0][0]
        if len(runs) == 1:
            return (((), *runs[0][1:]),), first
        shared = min([len(r[0]) for r in runs])
        while any([r[0][:shared] != first[:shared] for r in runs]):
            shared -= 1
        return tuple([(o[shared:], b, n) for o, b, n in runs]), first[:shared]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece; one that is a token itself gives that token.

        Once max_states states have been met, steps to others are taken without keeping them.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.valid) > self.max_pairs:
            self.valid.clear()
        number, runs, arcs, out = self.start, None, self.arcs, []
        for byte in piece:
            if number is not None:
                arc = arcs.get(number << 8 | byte)
                if arc is not None:
                    number = arc[0]
                    if arc[1]:
                        out.extend(arc[1])
                    continue
                runs = self.states[number]
            after, given = self._step(runs, byte)
            if given:
                out.extend(given)
            to = self.number.get(after)
            if to is None and len(self.states) < self.max_states:
                to = self._state(after)
            if number is not None and to is not None:
                arcs[number << 8 | byte] = (to, given)
            number, runs = to, after
        out.extend((self.states[number] if number is not None else runs)[-1][0])  # the run that ends here is the last one
        return out


class Utf8Stream:
    """Bytes in pieces of any cut -> text: an incremental UTF-8 state machine.

    The state is the part of a character that the bytes so far have begun. Whole characters are given out at once.
    """

    #: Bytes of a character by the high bits of its first byte.
    _NEEDED = ((0x80, 0x00, 1), (0xE0, 0xC0, 2), (0xF0, 0xE0, 3), (0xF8, 0xF0, 4))

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        end = len(data)
        for back in range(1, min(4, end) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:  # a first byte: is its character whole?
                needed = next((n for mask, bits, n in self._NEEDED if byte & mask == bits), 1)
                end -= back if needed > back else 0
                break
        self.begun = data[end:]
        return data[:end].decode("utf-8")

    def close(self) -> None:
        if self.begun:
            raise ValueError(f"the bytes end within a character: {self.begun!r}")


class Codec:
    """Whole texts to ids and back, each match of `pattern` encoded by itself; remembers pieces it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = MAX_PIECES):
        self.transducer, self.max_pieces = Transducer(ranks, pieces), pieces
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.renewed = 0

    def _packed(self, piece: str) -> bytes:
        if len(self.known) > self.max_pieces:
            self.known.clear()
            self.renewed += 1
            if self.renewed % RENEWAL == 0:
                self.transducer.forget()
        ids = self.transducer.encode_piece(piece.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids, each as four bytes, little end first."""
        known = self.known
        return b"".join([known.get(p) or self._packed(p) for p in self.pieces(text)])

    def decode_stream(self, ids: bytes, block: int = 1 << 16) -> Iterator[str]:
        """The text of packed ids, a block of ids at a time."""
        stream, bytes_of = Utf8Stream(), self.transducer.bytes_of
        view = memoryview(ids).cast("I")
        for at in range(0, len(view), block):
            yield stream.feed(b"".join([bytes_of[i] for i in view[at : at + block]]))
        stream.close()


def digest_of(ranks: dict[bytes, int], pattern: str) -> str:
    """What tells vocabularies and patterns apart."""
    own = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        own.update(b"%d %d " % (rank, len(token)) + token)
    return own.hexdigest()


def _codec(shared, digest: str, pattern: str, pieces: int) -> Codec:
    """This worker's codec; one is compiled for each vocabulary."""
    return kept_by_worker(f"codec {digest} {pieces}", lambda: Codec(shared.value, pattern, pieces))


def bpe_encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, pieces: int = MAX_PIECES) -> DataFrame:
    """One row per row of `docs`: id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. Other columns are neither read nor returned.

    `vocabulary` is the path of a rank file, read once by the driver; executors get it as a broadcast of fixed size (its
    size does not depend on the data). A worker remembers `pieces` pieces at most, fewer where memory is short. No special tokens. The ids are decoded again and the digest of that is returned.

    * A null text counts as empty; it has no ids. Null or repeated ids are rows like any others.
    * Texts of any length are encoded whole: memory is that of one text and its ids. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = read_ranks(vocabulary)
    shared, digest = spark.sparkContext.broadcast(ranks), digest_of(ranks, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, digest, pattern, pieces)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # few rows at a time bound what texts and ids take
                yield part(codec, whole.slice(at, ROWS))

    def part(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, decoded, packed = [], [], [], []
        for text in batch["text"]:
            ids = codec.encode(text.as_py() or "")
            back = hashlib.sha256()
            for piece in codec.decode_stream(ids):
                back.update(piece.encode("utf-8"))
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            decoded.append(back.hexdigest())
            if with_ids:
                packed.append(ids)
        out = {"row": batch["row"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if with_ids:
            flat = pa.py_buffer(b"".join(packed))
            ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
            out["ids"] = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, flat]))
        return pa.RecordBatch.from_pydict(out)

    schema = "row long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("row", id_col)
