"""Toxicity after noisy-channel deobfuscation: Viterbi decoding of character lattices under a character language model."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import bounded_batches, materialize
from corvella.llm.textops import Runs, kept_by_worker, slices

# Symbols of the language model: 0 a word's end, 1-26 the letters, 27 any other letter, 28 any other character.
SYMBOLS = 29
_OTHER_LETTER, _OTHER = 27, 28
#: Which letters a character may stand for (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "*": "aeiou", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "ß": "b",
    "à": "a", "á": "a", "â": "a", "ä": "a", "å": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i",
    "ò": "o", "ó": "o", "ô": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
#: Letters that look like a plain one; a word of letters alone is read in both ways without decoding.
_PLAIN = {ord(c): x for c, x in LEET.items() if c.isalpha() and not c.isascii()}
#: Costs, as negative log probabilities, of what the channel does to a character.
SUBSTITUTED, DELETED, DOUBLED, REPEATED = 2.0, 2.5, 6.0, 0.5
#: A longer token is decoded like all others but not remembered: keys, addresses and encoded data seldom come again.
LONGEST_TOKEN = 48
#: Single characters, or symbols read as letters, with any separators between them; a * is a letter only between separators.
_SPACED = re.compile(r"(?<!\w)(?:\*[\s.\-_]+)?(?:[^\W_]|[@$!|+(<€£¡])(?:[\s.\-_*]+(?:[^\W_]|[@$!|+(<€£¡])){2,}(?:[\s.\-_]+\*)?(?!\w)")
_SEPARATORS = re.compile(r"(?<![\s.\-_])\*(?=.)|(?<=.)\*(?![\s.\-_]|$)|[\s.\-_]+")
_JOINED = re.compile(r"[\s._\-/,:;]+")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_ENDS = ".,;:?\"'()[]{}<>#%&*-_~`´’‘“”«»…"
#: Marks that no letter is written as; what else stands at a token's ends may be a mark or a letter.
_MARKS = "".join(c for c in _ENDS if c not in LEET)
_TABLE = np.full(256, _OTHER, np.uint8)
_TABLE[[9, 10, 11, 12, 13, 32]] = 0
_TABLE[97:123] = np.arange(1, 27)
_TABLE[65:91] = np.arange(1, 27)
_TABLE[128:192] = 255  # goes with the byte before
_TABLE[192:] = _OTHER_LETTER
#: Words a lexicon has at most, and rows of labels it is learned from at most.
MAX_LEXICON, MAX_LABELLED = 4096, 20_000
#: The share of a lexicon that may be there by chance, and the least logarithm of odds that a word must add.
FALSE_WORDS, LEAST_ODDS = 0.1, 1.5
#: Texts that are looked at together.
ROWS = 256
#: Letters outside ASCII that are written for consonants, and what of them a skeleton has (fixed values).
_CONSONANTS = {"ß": "b", "ç": "c", "ñ": "n", "р": "p", "с": "c", "х": "x", "у": "y"}
#: What a skeleton has of a byte: nothing of what may be a vowel, an l, or nothing; the same for what may be one letter or another.
_BONES = np.zeros(256, np.uint8)
for _i, _c in enumerate("bcdfhjkmnpqrstvwxyz", 1):
    _BONES[ord(_c)] = _i
for _c, _as in {"g": "b", "6": "b", "8": "b", "9": "b", "2": "z", "5": "s", "7": "t"}.items():
    _BONES[ord(_c)] = _BONES[ord(_as)]
#: Characters that may be a consonant or nothing: no skeleton tells, so tokens with them are always decoded.
_EITHER = np.isin(np.arange(256), list(b"$+(<"))
_BREAK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_BLANKS = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]
_JOINT = np.isin(np.arange(256), list(b"._-/,:;")) | _BREAK


def skeletons(data: bytes, joints: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, skeleton, unclear) of each token of lower-cased UTF-8 text: a hash of its consonants, runs of the same one counted once.

    Whatever a lattice makes of a token, its consonants are the token's own but for repetition, so a token can't say a word
    with another skeleton unless it is `unclear`. With joints=True what dots, underscores and the like join are tokens.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = ~(_JOINT if joints else _BREAK)[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, stop = edges[0::2], edges[1::2]
    bones = _BONES[raw]
    at = np.flatnonzero(bones)
    token = np.searchsorted(stop, at, side="right")
    kept = bones[at]
    new = np.ones(len(at), bool)
    new[1:] = (kept[1:] != kept[:-1]) | (token[1:] != token[:-1])
    kept, token = kept[new], token[new]
    first = np.searchsorted(token, np.arange(len(start) + 1))
    unclear = np.zeros(len(start), bool)
    unclear[np.searchsorted(stop, np.flatnonzero(_EITHER[raw]), side="right")] = True
    return start, stop, Runs(kept).hash(first[:-1], first[1:]), unclear


def _skeleton_text(text: str) -> bytes:
    """Lower-cased text in which letters outside ASCII that stand for consonants are these, and other blanks are spaces: it has the same tokens."""
    if not text.isascii():
        for c, x in _CONSONANTS.items():
            if c in text:
                text = text.replace(c, x)
        for c in _BLANKS:
            if c in text:
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of four symbols in the whole texts of a partition."""
    counts = np.zeros(SYMBOLS**4, np.int64)
    for batch in batches:
        for _, texts in slices(batch["text"]):
            s = _TABLE[np.frombuffer(b"   " + b"   ".join(texts) + b" ", np.uint8)]
            s = s[s != 255].astype(np.int32)
            code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
            counts += np.bincount(code, minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "n": pa.array(counts[some], pa.int64())})


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (negative logs of probabilities) of a symbol after three others, learned from all texts.

    The counts of all partitions are summed; there are at most SYMBOLS**4 of them however large the corpus. Orders 1 to 4
    are interpolated, each with more weight the more often its context was seen.
    """
    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**4)
    for row in summed.collect():
        counts[row["gram"]] = row["n"]
    counts = counts.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        c = counts.sum(axis=tuple(range(4 - order)))
        seen = c.sum(axis=-1, keepdims=True)
        p = (c + 20 * p) / (seen + 20)
    return -np.log(p).astype(np.float32)


class Restorer:
    """Decodes obfuscated words; remembers what it has decoded."""

    def __init__(self, costs: np.ndarray, memory: int = 50_000):
        self.costs, self.memory = costs.reshape(-1).tolist(), memory
        self.known: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def lattice(text: str) -> list[list[tuple[str, float]]]:
        """For each run of like characters what it may stand for, and at what cost: substitution, deletion, repetition."""
        out: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"(.)\1*", text, re.DOTALL):
            c, n = m[1], len(m[0])
            letters = c if "a" <= c <= "z" else ""
            if letters or c in LEET:
                edges = []
                for x in letters or LEET[c]:
                    base = 0.0 if letters else SUBSTITUTED
                    once = 0.0 if n == 1 else DOUBLED if n == 2 else REPEATED
                    edges += [(x, base + once)] + ([(x + x, base + (0.0 if n == 2 else REPEATED + 1.0))] if n > 1 else [])
                if not letters and not c.isalnum():
                    edges.append(("", DELETED))
                if not letters:
                    edges.append(("¿" if c.isalpha() else "#", 0.0))
            elif c == " ":
                edges = [(" ", 0.0), ("", 0.5)]
            elif c.isalpha():
                edges = [("¿", 0.0)]
            else:
                edges = [("", DELETED), ("#", 0.0)]
            out.append(edges)
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading of a lattice: Viterbi over the last three symbols, exact. ¿ and # are letters and characters left as they are."""
        number = {" ": 0, "¿": _OTHER_LETTER, "#": _OTHER}
        n2 = SYMBOLS**2
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # what is said is a chain (before, out), so that long texts take linear time
        for edges in [*self.lattice(text), [(" ", 0.0)]]:
            then: dict[int, tuple[float, tuple]] = {}
            for state, (cost, said) in best.items():
                for out, price in edges:
                    at, total = state, cost + price
                    for x in out:
                        s = number.get(x)
                        s = ord(x) - 96 if s is None else s
                        total += self.costs[at * SYMBOLS + s]
                        at = (at % n2) * SYMBOLS + s
                    if at not in then or total < then[at][0]:
                        then[at] = (total, (said, out))
            best = then
        said, outs = min(best.values(), key=lambda x: x[0])[1], []
        while said:
            said, out = said
            outs.append(out)
        return "".join(reversed(outs)).strip()

    def words(self, token: str) -> tuple[str, ...]:
        """What a lower-cased token says: itself without marks at its ends, and if it looks obfuscated its decoded words."""
        got = self.known.get(token)
        if got is None:
            bare = token.strip(_ENDS).rstrip("!")
            whole = token.strip(_MARKS)
            if bare.isalpha() and not _TRIPLE.search(bare):
                got = (bare,) if bare.isascii() else tuple(dict.fromkeys((bare, bare.translate(_PLAIN))))
                if _DOUBLE.search(bare):
                    got = tuple(dict.fromkeys((*got, *self.decode(bare).split())))
            elif not any(c.isalpha() or c in LEET for c in bare):
                got = (bare,)
            else:
                got = tuple(dict.fromkeys((bare, *self.decode(bare).split(), *self.parts(bare))))
            if whole != bare and any(c.isalpha() for c in whole):
                got = tuple(dict.fromkeys((*got, *self.decode(whole).split())))
            if len(token) <= LONGEST_TOKEN:
                if len(self.known) > self.memory:
                    self.known.clear()
                self.known[token] = got
        return got

    def parts(self, token: str) -> list[str]:
        """What the words of a token say that dots, underscores and the like join: as they stand, and decoded if they look obfuscated."""
        said = [x for x in _JOINED.split(token) if len(x) > 1]
        return [w for x in said if x != token for w in self.words(x)]

    def spaced(self, text: str) -> Iterator[str]:
        """Words of a lower-cased text that are spaced out letter by letter."""
        for m in _SPACED.finditer(text):
            yield from self.words(" ".join(_SEPARATORS.sub(" ", m[0]).split()))

    def restored(self, text: str) -> set[str]:
        """All words of a text after restoration, spaced-out words included."""
        text = text.lower()
        out: set[str] = set()
        known = self.known.get
        for token in set(text.split()):
            out.update(known(token) or self.words(token))
        out.update(self.spaced(text))
        return out


class Finder:
    """Finds the words of a lexicon in whole texts after restoration: what `Restorer.restored` has of it, but only tokens
    with the skeleton of a word of the lexicon are decoded."""

    def __init__(self, restorer: Restorer, lexicon: Iterable[str]):
        self.restorer, self.lexicon = restorer, set(lexicon)
        hashes = [skeletons(_skeleton_text(w), joints=False)[2] for w in self.lexicon]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))

    def found(self, texts: list[str | None]) -> list[list[str]]:
        """For each text the words of the lexicon that it says, sorted."""
        if not self.lexicon:
            return [[] for _ in texts]
        texts = [(t or "").lower() for t in texts]
        out = [set(self.restorer.spaced(t)) & self.lexicon for t in texts]
        plain = [_skeleton_text(t) for t in texts]
        data = b"\n".join(plain) + b"\n"
        start, stop, skeleton, unclear = skeletons(data, joints=False)
        wanted = unclear | np.isin(skeleton, self.known)
        part, _, skeleton, _ = skeletons(data, joints=True)
        wanted[np.searchsorted(start, part[np.isin(skeleton, self.known)], side="right") - 1] = True  # decoded with its parts
        first = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in plain)]))  # of each text's tokens
        at = np.flatnonzero(wanted)
        doc = np.searchsorted(first, at, side="right") - 1
        tokens: list[str] = []
        last = -1
        for d, i in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True):
            if d != last:
                tokens, last = texts[d].split(), d
            out[d].update(w for w in self.restorer.words(tokens[i]) if w in self.lexicon)
        return [sorted(x) for x in out]


def _restorer(shared, model: str) -> Restorer:
    """This worker's restorer; `model` tells character models apart."""
    return kept_by_worker(f"restorer {model}", lambda: Restorer(shared.value))


def _evidence(shared, model: str):
    """For each word of a labelled text: the word, a hash of the words around it, and the label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared, model)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                words, around, labels = [], [], []
                for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                    tokens = (text or "").lower().split()
                    seen: set[str] = set()
                    for i, token in enumerate(tokens):
                        if token in seen:
                            continue
                        seen.add(token)
                        said = restorer.words(token)
                        near = xxhash.xxh3_64_intdigest(" ".join(tokens[max(0, i - 2) : i + 3]).encode("utf-8", "replace")) >> 1
                        words += said
                        around += [near] * len(said)
                        labels += [label] * len(said)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "around": pa.array(around, pa.int64()), "label": pa.array(labels, pa.int64())})

    return run


def _presence(shared, model: str, lexicon: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, index = Finder(_restorer(shared, model), lexicon), {w: i for i, w in enumerate(lexicon)}
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                found = [sorted(index[w] for w in ws) for ws in finder.found(batch["text"].to_pylist())]
                yield pa.RecordBatch.from_pydict({"label": batch["label"], "found": pa.array(found, pa.list_(pa.int32()))})

    return run


def _tail(n: int, k: int, p: float) -> float:
    """The probability that of n draws k or more hit (k above the mean; else k or fewer); for many draws a bound of it."""
    up = k >= n * p
    if n > 300:
        share = k / n
        return math.exp(-n * sum(x * math.log(x / q) for x, q in ((share, p), (1 - share, 1 - p)) if x > 0))
    hits = range(k, n + 1) if up else range(k + 1)
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in hits))


def telling(counts: Iterable[tuple[int, int, int]], base: float) -> list[tuple[int, int, float]]:
    """Which (contexts n, of these with label 1 k) make a word of the lexicon, and how telling it is, from (n, k, words that have them).

    Words with about as many contexts are tested together (n = 2, 3, 4, 5 to 8, 9 to 16 and so on), so that rare words,
    which are many, don't hide what few labels can tell: as many are taken as keep the expected share of chance words
    below FALSE_WORDS (Benjamini and Hochberg). A word must also add LEAST_ODDS, shrunk as if seen once more at the base rate.
    """
    groups: dict[int, list[tuple[float, int, int, int]]] = defaultdict(list)
    for n, k, words in counts:
        groups[n if n <= 4 else (n - 1).bit_length() + 2].append((_tail(n, k, base), n, k, words))
    out = []
    for group in groups.values():
        group.sort()
        m, rank, last = sum(x[3] for x in group), 0, -1.0
        for p, _, _, words in group:
            rank += words
            if p * m <= FALSE_WORDS * rank:
                last = p
        for p, n, k, _ in group:
            odds = math.log((k + base) / (n - k + 1 - base)) - math.log(base / (1 - base))
            if p <= last and abs(odds) >= LEAST_ODDS:
                out.append((n, k, -math.log(max(p, 1e-300))))
    return out


def _fit(rows: list[tuple[int, list[int], int]], n: int) -> np.ndarray:
    """Ridge-penalised logistic regression on (label, words present, how many such rows), by Newton's method; the last weight is the bias."""
    x = np.zeros((len(rows), n + 1))
    x[:, n] = 1
    for i, (_, found, _) in enumerate(rows):
        x[i, found] = 1
    y, count, w = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float), np.zeros(n + 1)
    ridge = np.append(np.full(n, 1.0), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (count * (p - y)) + ridge * w
        hessian = (x.T * (count * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, costs, model: str, id_col: str, text_col: str, label_col: str, max_labelled: int, max_lexicon: int) -> tuple[list[str], np.ndarray]:
    """A lexicon and its weights from at most about `max_labelled` rows of labels (chosen by a hash of the id).

    A word's evidence counts once for each five-word context it stands in, so copies of a document count once, and once
    for a document. `telling` says which words make the lexicon; logistic regression weighs them.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).cast("long").alias("label"))
    known = known.where(F.crc32(F.col("_l").cast("string").cast("binary")) % 5 != 0)
    total = known.count()
    if total > max_labelled:
        known = known.where((F.pmod(F.xxhash64(F.lit("labelled"), "_l"), F.lit(1 << 30)) / (1 << 30)) < max_labelled / total)
    sample = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_d") == F.col("_l")).select("text", "label")
    base = sample.agg(F.avg("label").alias("p")).first()["p"] or 0.0
    lexicon: list[str] = []
    if 0 < base < 1:
        evidence = sample.mapInArrow(_evidence(costs, model), "word string, around long, label long")
        once = evidence.groupBy("word", "around").agg(F.max("label").alias("label"))
        words = once.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k")).where((F.col("n") > 1) & (F.length("word") > 1) & ~F.col("word").rlike("[¿#]"))
        words = materialize(words)
        counts = words.groupBy("n", "k").agg(F.count("*").alias("words")).collect()  # n and k are at most max_labelled
        told = telling([(r["n"], r["k"], r["words"]) for r in counts], base)
        if told:
            picked = words.join(F.broadcast(docs.sparkSession.createDataFrame(told, "n long, k long, weight double")), ["n", "k"])
            lexicon = [r["word"] for r in picked.orderBy(F.col("weight").desc(), "word").limit(max_lexicon).collect()]
    rows = sample.mapInArrow(_presence(costs, model, lexicon), "label long, found array<int>").groupBy("label", "found").count().collect() if lexicon else []
    if not rows:
        p = (base * total + 0.5) / (total + 10)
        return lexicon, np.append(np.zeros(len(lexicon)), np.log(p / (1 - p)))
    return lexicon, _fit([(r["label"], list(r["found"]), r["count"]) for r in rows], len(lexicon))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON, carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id_col, held_out, score, predicted, words (of the lexicon found, in its restored form). Other columns are neither read nor returned;
    with carry=True the whole row comes along instead, as the struct `doc`, and nothing has to be joined to filter documents.

    1. A character model is counted over all texts.
    2. Tokens that look obfuscated - letters mixed with other characters (at their ends too, where these may stand for
       letters), characters twice or more in a row, words spaced out letter by letter with any separators - become lattices, and Viterbi decoding under the model restores them.
    3. A lexicon (at most the `max_lexicon` most telling words) is learned from labelled rows (at most `max_labelled` of
       them) whose crc32(id as text) mod 5 is not 0, and every restored text is scored. Only texts enter a score.
       Where texts are scored, tokens that can't say a word of the lexicon aren't decoded: `skeletons`.

    * A null or empty text has no words: its score is that of a text with no word of the lexicon. Null ids are not held
      out and never labelled. Repeated rows are scored alike; of several labels for an id the largest holds.
    * Without labels of both kinds every score is the share of label 1, or a small one. An empty table gives an empty result.
    * Tokens and spaced-out words are decoded whole, however long they are.
    """
    bounded_batches(docs.sparkSession)
    learned = character_model(docs, text_col)
    costs, model = docs.sparkSession.sparkContext.broadcast(learned), hashlib.sha256(learned.tobytes()).hexdigest()
    lexicon, weights = train(docs, labels, costs, model, id_col, text_col, label_col, max_labelled, max_lexicon)
    weight, bias = {w: float(x) for w, x in zip(lexicon, weights, strict=False)}, float(weights[-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(_restorer(costs, model), weight)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                texts = batch["doc"].field(text_col) if carry else batch["text"]
                found = finder.found(texts.to_pylist())
                scores = [1 / (1 + np.exp(-(bias + sum(weight[w] for w in ws)))) for ws in found]
                yield pa.RecordBatch.from_pydict({"doc": batch["doc"], "held_out": batch["held_out"], "score": pa.array(scores, pa.float64()), "words": pa.array(found, pa.list_(pa.string()))})

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    doc = F.struct(*docs.columns) if carry else F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc"), held, *([] if carry else [F.col(text_col).alias("text")]))
    schema = rows.select("doc", "held_out", F.lit(0.0).alias("score"), F.lit(None).cast("array<string>").alias("words")).schema
    scored = rows.mapInArrow(run, schema)
    own = F.col("doc") if carry else F.col("doc").alias(id_col)
    return scored.select(own, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "words")
