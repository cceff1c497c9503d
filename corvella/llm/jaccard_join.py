"""Similarity join of documents on word n-grams by the chosen-path method."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import HOT_KEYS, bounded_batches, few, join_facts, materialize, safe_id
from corvella.llm.components import components
from corvella.llm.textops import WORD, Runs, Words, mix, slices

#: Sampled tokens of a set: coordinates of its sketch.
COORDINATES = 64
#: Sets that a bucket may have to be compared by brute force.
BUCKET = 512
#: Splits at a time.
STEPS = 2
#: Pivots that a larger bucket has on average, and the distance (in coordinates) within which sets go with a pivot.
PIVOTS, NEAR = 8, 10
#: Sets and shingles of one block when all sets of a class are compared.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles whose columns are multiplied at once.
COLUMNS = 4096
_MULTIPLIERS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's set of hashed n-word shingles, sorted; fewer than n words, but not none, are one shingle."""
    words = Words(texts, WORD, lower=True)
    runs = Runs(words.hash)
    grams, out = runs.grams(n), []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(runs.hash(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def _bits(sketches: np.ndarray, which: int) -> pa.Array:
    """One bit of each coordinate's token, as a number of 64 bits."""
    return pa.array(np.packbits(((sketches >> np.uint32(which)) & 1).astype(np.uint8), axis=1).view(">i8").ravel().astype(np.int64))


def _sketch(n: int):
    """(id, sid, other, size, sketch, low, high): the set's signature, its size, for each coordinate the token sampled by min-hash, and two bits of each token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch["text"]):
                sets = shingle_sets(texts, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                sketches = np.zeros((len(sets), COORDINATES), np.uint32)
                if len(some):
                    tokens = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum(sizes[some]) - sizes[some]
                    for j in range(COORDINATES):
                        sketches[some, j] = np.minimum.reduceat(tokens * _MULTIPLIERS[j], starts) >> np.uint64(32)
                signs = [_signature(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "id": batch["id"].slice(first, len(sets)), "text_hash": batch["text_hash"].slice(first, len(sets)), "sid": pa.array([s[0] for s in signs], pa.int64()), "other": pa.array([s[1] for s in signs], pa.int64()),
                    "size": pa.array(sizes), "sketch": pa.array([x.tobytes() for x in sketches], pa.binary()), "low": _bits(sketches, 0), "high": _bits(sketches, 1),
                })

    return run


def _distance(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """On how many coordinates the two bits differ: a metric on sketches."""
    return np.bitwise_count((low ^ other_low) | (high ^ other_high)).astype(np.int64)


def furthest(threshold: float) -> int:
    """The distance that sketches of sets at the threshold don't exceed but by four standard deviations."""
    same = threshold + (1 - threshold) / 4  # two bits also agree by chance
    return COORDINATES - math.ceil(COORDINATES * same - 4 * math.sqrt(COORDINATES * same * (1 - same)))


def _choose(rate: float, steps: int):
    """Paths `steps` steps longer: from each path a sample of coordinates, the same for all sets on it, and each set's token there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))
        limit = np.uint64(int(rate / COORDINATES * 2**64))
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                paths = batch["paths"]
                row = np.repeat(np.arange(batch.num_rows), np.diff(paths.offsets.to_numpy()))
                path = paths.flatten().to_numpy().view(np.uint64)
                sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
                for _ in range(steps):
                    draw = mix(path[:, None] ^ coordinates)
                    at, j = np.nonzero(draw < limit)
                    row = row[at]
                    path = mix(draw[at, j] ^ mix(sketch[row, j].astype(np.uint64) + np.uint64(1)))
                picked = pa.array(row)
                yield pa.RecordBatch.from_pydict({"path": pa.array(path.view(np.int64)), **{c: batch[c].take(picked) for c in ("sid", "size", "low", "high")}})

    return run


def _grouped(key: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that calls `work` on the rows of each key; rows are sorted by it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[k].to_numpy() for k in key]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = not held or any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in key)
            edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < batch.num_rows and new[a] and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _roots(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Components of a small graph, as the least member of each."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, js in pairs:
        for j in np.atleast_1d(js).tolist():
            a, b = find(int(i)), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


_MET = "a long, b long, path long"


def _met(a: np.ndarray, b: np.ndarray, sid: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    """Links (a, b), and sets that go on along a path (a, path)."""
    return pa.RecordBatch.from_pydict({
        "a": pa.array(np.concatenate([a, sid]), pa.int64()), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(sid), pa.int64())]),
        "path": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(path, pa.int64())]),
    })


def _small(t: pa.Table, threshold: float, far: int) -> Iterator[pa.RecordBatch]:
    """Brute force on the sketches of a small bucket: sets that may be similar, as links that span each component of them."""
    sid, size = t["sid"].to_numpy(), t["size"].to_numpy()
    low, high = t["low"].to_numpy().view(np.uint64), t["high"].to_numpy().view(np.uint64)

    def pairs() -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(sid) - 1):
            close = _distance(low[i + 1 :], high[i + 1 :], low[i], high[i]) <= far
            close &= np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i]) - 1e-9
            yield i, np.flatnonzero(close) + i + 1

    root = _roots(len(sid), pairs())
    other = np.flatnonzero(sid[root] != sid)
    if len(other):
        yield _met(sid[other], sid[root[other]], sid[:0], sid[:0])


class Pivots:
    """Some sets of a large bucket, each with the least one that it is joined to by steps of `reach` or less."""

    def __init__(self, sid: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int):
        by = np.argsort(sid, kind="stable")
        self.low, self.high, self.reach = low[by], high[by], reach
        distance = _distance(self.low[:, None], self.high[:, None], self.low, self.high)
        self.root = _roots(len(sid), ((i, np.flatnonzero(distance[i] <= reach)) for i in range(len(sid))))
        self.name = sid[by][self.root]

    def settle(self, path: np.ndarray, sid: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        """Links of a bucket's sets to the roots of all pivots within reach; sets that are near no pivot go on."""
        distance = _distance(low[:, None], high[:, None], self.low, self.high)
        a, b = [sid[:0]], [sid[:0]]
        for r in np.unique(self.root):
            at = np.flatnonzero((distance[:, self.root == r] <= self.reach).any(axis=1) & (sid != self.name[r]))
            a.append(sid[at])
            b.append(np.full(len(at), self.name[r]))
        on = ~(distance <= NEAR).any(axis=1)
        return _met(np.concatenate(a), np.concatenate(b), sid[on], path[on])


def _columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return (*(t[c].to_numpy() for c in ("path", "sid")), *(t[c].to_numpy().view(np.uint64) for c in ("low", "high")))


def _buckets(threshold: float):
    """Buckets, sorted by path and sid: small ones are compared, the first sets of large ones are their pivots (sids are
    hashes, and the same sets are pivots of most buckets of a crowd). It holds no more than BUCKET rows and a batch."""
    far = furthest(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pivots: Pivots | None = None
        current, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch["path"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [batch.num_rows]])
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                if current != path[a]:
                    if count > 1 and pivots is None:
                        yield from _small(pa.Table.from_batches(held), threshold, far)
                    held, pivots, current, count = [], None, path[a], 0
                    if b - a == 1 and b < batch.num_rows:
                        continue  # a set alone on its path
                held.append(batch.slice(a, b - a))
                count += b - a
                if count > BUCKET:
                    t = pa.Table.from_batches(held)
                    if pivots is None:
                        _, sid, low, high = (x[:PIVOTS] for x in _columns(t))
                        pivots = Pivots(sid, low, high, NEAR + far)
                    yield pivots.settle(*_columns(t))
                    held = []
        if count > 1 and pivots is None:
            yield from _small(pa.Table.from_batches(held), threshold, far)

    return run


def _crowds(pivots: dict[int, Pivots]):
    """Rows of the largest buckets, whose pivots are known, wherever the rows are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, sid, low, high = _columns(batch)
            for p in np.unique(path).tolist():
                at = path == p
                yield pivots[p].settle(path[at], sid[at], low[at], high[at])

    return run


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """How many shingles each of the first `split` sets shares with each other one (split 0: each with each); exact."""
    size = np.array([len(s) for s in sets])
    _, tokens, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    useful = count[tokens] > 1
    row, tokens = row[useful], tokens[useful]
    _, tokens = np.unique(tokens, return_inverse=True)
    by = np.argsort(tokens, kind="stable")
    row, tokens = row[by], tokens[by]
    n = split or len(sets)
    shared = np.zeros((n, len(sets) - split), np.float32)
    edges = np.searchsorted(tokens, np.arange(0, (int(tokens[-1]) if len(tokens) else -1) + 1 + COLUMNS, COLUMNS))
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if b > a:
            x = np.zeros((len(sets), int(tokens[b - 1] - tokens[a]) + 1), np.float32)
            x[row[a:b], tokens[a:b] - tokens[a]] = 1
            shared += x[:n] @ x[split:].T
    return shared


def _compare(threshold: float):
    """All links inside one block or between two blocks of a class: how many documents each set is linked to (a, null, links), and links (a, b) that span their components."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        t = t.combine_chunks()
        across = t["i"][0].as_py() != t["j"][0].as_py()
        if across:
            t = t.sort_by("block")
        sid, weight, block = t["sid"].to_numpy(), t["docs"].to_numpy(), t["block"].to_numpy()
        split = int(np.count_nonzero(block == block[0])) if across else 0
        if split == t.num_rows:
            return
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        shared = _overlaps(sets, split)
        left, right = np.arange(split or len(sid)), np.arange(split, len(sid))
        linked = shared >= threshold * (size[left][:, None] + size[right] - shared) - 1e-9
        if not across:
            np.fill_diagonal(linked, False)
        degree = np.zeros(len(sid), np.int64)
        degree[left] += linked @ weight[right]
        if across:
            degree[right] += weight[left] @ linked
        at = np.flatnonzero(degree)
        if len(at):
            root = _roots(len(sid), ((i, np.flatnonzero(linked[i]) + split) for i in range(len(left)) if degree[i]))
            tied = np.flatnonzero(root != np.arange(len(sid)))
            a, b = np.concatenate([sid[at], sid[tied]]), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(sid[root[tied]])])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": b, "links": pa.array(np.concatenate([degree[at], np.zeros(len(tied), np.int64)]))})

    return work


def _in_blocks(members: DataFrame) -> DataFrame:
    """Each member of a class once for every pair of blocks (i <= j) that its block is part of; n_blocks says how many the class has."""
    b = F.pmod(F.xxhash64("sid"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")), lambda x: F.struct(F.least(x, b).alias("i"), F.greatest(x, b).alias("j"), b.alias("block")))
    return members.withColumn("_p", F.explode(pairs)).select("class", "_p.*", "sid", "docs", "shingles")


def _walk(walkers: DataFrame, sets: DataFrame, rate: float, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Splits the buckets of `walkers` (sets with `paths`) until all are small: links (a, b) of sets that may be similar, and how many
    splits deep sets had to go (sid, depth) if more than STEPS.

    Buckets that hold more than 1/HOT_KEYS of the rows are fewer than HOT_KEYS: these and their pivots are known to
    all, and their rows stay where they are. The rows of other buckets meet by path.
    """
    spark = sets.sparkSession
    links: DataFrame | None = None
    deeper: DataFrame | None = None
    depth, level = STEPS, walkers
    while True:
        paths = materialize(level.mapInArrow(_choose(rate, STEPS), "path long, sid long, size long, low long, high long"))
        most = max(BUCKET, paths.count() // HOT_KEYS)
        hot = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("sid").alias("least")).where(F.col("n") > most).collect()
        rest = paths
        if hot:
            crowds = F.broadcast(spark.createDataFrame(hot, "path long, n long, least long"))
            crowded, rest = paths.join(crowds, "path"), paths.join(crowds, "path", "left_anti")
            least = F.col("least").cast("double")  # sids are hashes: PIVOTS of them on average lie so near the least one
            first = crowded.where(F.col("sid").cast("double") <= least + (F.lit(2.0**63) - least) * PIVOTS / F.col("n"))
            of: dict[int, list] = {}
            for r in first.select("path", "sid", "low", "high").collect():
                of.setdefault(r["path"], []).append(r[1:])
            pivots = {p: Pivots(*(np.array(x, np.int64).view(t) for x, t in zip(zip(*rows, strict=True), (np.int64, np.uint64, np.uint64), strict=True)), NEAR + furthest(threshold)) for p, rows in of.items()}
        met = rest.repartition("path").sortWithinPartitions("path", "sid").mapInArrow(_buckets(threshold), _MET)
        if hot:
            met = met.union(crowded.select(*paths.columns).mapInArrow(_crowds(pivots), _MET))
        met = materialize(met)
        found = met.where("b is not null").select("a", "b")
        links = found if links is None else links.union(found)
        on = met.where("path is not null").select(F.col("a").alias("sid"), "path")
        n = on.count()
        if not n:
            break
        depth += STEPS
        gone_on = materialize(few(on.groupBy("sid").agg(F.collect_list("path").alias("paths")), n))  # a set is on few paths
        went_on = gone_on.select("sid", F.lit(depth).alias("depth"))
        deeper = went_on if deeper is None else deeper.union(went_on)
        level = gone_on.join(sets.select("sid", "size", "low", "high", "sketch"), "sid")
    return links, deeper


def runs_for(recall: float, threshold: float, rate: float, depth: int) -> int:
    """Runs until a pair at the threshold has met in a small bucket with probability `recall`, if buckets are `depth` splits deep.

    A pair stays on a Poisson number of a path's continuations: a branching process, whose mean is rate times the share of
    coordinates on which the pair's sketches agree. Sketches are the same in all runs, so recall is averaged over that share.
    """
    share = np.arange(COORDINATES + 1) / COORDINATES
    weight = np.array([math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) for k in range(COORDINATES + 1)])
    alive = np.ones(COORDINATES + 1)
    for _ in range(depth):
        alive = 1 - np.exp(-share * rate * alive)
    runs = 1
    while weight @ (1 - alive) ** runs > 1 - recall:
        runs += 1
    return runs


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """One row per row of `docs`: id_col, class_id, n_links, n_shingles, text_hash (xxhash64), kept. Other columns are neither read nor returned.

    Documents are linked if the Jaccard similarity of their sets of n-word shingles is `threshold` or more (words as in
    decontamination). A class is a connected component; class_id is its smallest id. n_links counts all other documents
    linked to the row's, those with the same set included. kept: the row is the first of its class by id and text_hash.

    1. Documents with equal sets become one set with a weight. Each set gets a sketch of COORDINATES min-hashed tokens.
    2. Chosen path: a path samples coordinates, the same for all its sets, and splits them by their tokens there, on
       average into rate = 1 / threshold longer paths for each set. In buckets of BUCKET sets or fewer all pairs of
       sketches (two bits a coordinate) are compared by brute force: `furthest` allows for four standard deviations.
       Larger buckets are split again, however often it takes, less the sets that are near one of PIVOTS of them: the
       distance of sketches is a metric, so whatever may be similar to a set within NEAR of a pivot is itself within
       NEAR + furthest of it. These are linked to the pivot, and the set is done. So crowds of near copies,
       which no split takes apart, take linear time. `runs_for` tells how many runs the target recall takes at a depth.
       They go side by side, and sets that had to go deeper walk the further runs that their depth takes.
    3. The links so far (candidates) have components, which hold every class whole. In each all pairs of whole sets
       are compared exactly, block by block; each pair of blocks gives counts of links and a tree of links for each
       component. The components of these are the classes. So links that no path found are also counted if the
       component holds both ends. The work is quadratic in a component, as counting its links is; no task gets more than two blocks.

    * A null or empty text, or one without words, has no shingles: it is a class of its own without links, and kept.
    * Null ids rank below all others; class_id is then null. Repeated rows are documents with equal sets; rows alike in id and text are kept or not together.
    * An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(safe_id(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sketched = rows.mapInArrow(_sketch(n), "id long, text_hash long, sid long, other long, size long, sketch binary, low long, high long")
    sketched = materialize(sketched)
    sets = sketched.where("size > 0").groupBy("sid").agg(F.min(F.struct("id", "text_hash")).alias("least"), F.count("*").alias("docs"), *(F.first(c).alias(c) for c in ("other", "size", "sketch", "low", "high")))
    sets = materialize(sets)

    rate = 1 / threshold
    walked = {STEPS: runs_for(recall, threshold, rate, STEPS)}  # runs by depth
    path = lambda r: F.xxhash64(F.lit(seed), r)
    links, deeper = _walk(sets.withColumn("paths", F.array(*(path(F.lit(r)) for r in range(walked[STEPS])))), sets, rate, threshold)
    done: DataFrame | None = None  # how deep sets have gone, and walked the runs for it
    while deeper is not None:
        reached = deeper.groupBy("sid").agg(F.max("depth").alias("depth"))
        if done is not None:
            reached = reached.join(done.withColumnRenamed("depth", "had"), "sid", "left").where(F.col("depth") > F.coalesce("had", F.lit(STEPS)))
        else:
            reached = reached.withColumn("had", F.lit(STEPS))
        reached = materialize(few(reached.select("sid", "depth", F.coalesce("had", F.lit(STEPS)).alias("had")), deeper.count()))
        deepest = reached.agg(F.max("depth")).first()[0]
        if deepest is None:
            break
        for depth in range(STEPS, deepest + 1, STEPS):
            walked.setdefault(depth, runs_for(recall, threshold, rate, depth))
        runs_of = F.create_map(*(F.lit(x) for item in walked.items() for x in item))
        further = F.sequence(runs_of[F.col("had")], runs_of[F.col("depth")] - 1)
        walkers = reached.withColumn("paths", F.transform(further, path)).join(sets, "sid")
        found, deeper = _walk(walkers, sets, rate, threshold)
        links = links.union(found)
        seen = reached.select("sid", "depth")
        done = seen if done is None else materialize(few(done.union(seen).groupBy("sid").agg(F.max("depth").alias("depth")), done.count() + seen.count()))

    member = components(links).select(F.col("node").alias("sid"), F.col("root").alias("class"))
    member = materialize(few(member.join(sets.select("sid", "size", "docs", "least"), "sid"), sets.count()))
    n_member = member.count()
    n_blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n_blocks")
    blocks = materialize(few(member.groupBy("class").agg(F.count("*").alias("n"), n_blocks), n_member))
    wanted = materialize(few(join_facts(member, blocks, "class", "n").select("least.id", "least.text_hash", "sid", "docs", "class", "n_blocks"), n_member))
    fetched = rows.join(wanted.hint("merge"), ["id", "text_hash"]).mapInArrow(_bodies(n), "sid long, docs long, class long, n_blocks long, shingles binary")
    key = ["class", "i", "j"]
    compared = _in_blocks(fetched.dropDuplicates(["sid"])).repartition(*key).sortWithinPartitions(*key, "sid").mapInArrow(_grouped(key, _compare(threshold)), "a long, b long, links long")
    compared = materialize(compared)
    degree = compared.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    classed = components(compared.where("b is not null").select("a", "b")).select(F.col("node").alias("sid"), F.col("root").alias("class"))
    classed = materialize(few(classed.join(member.select("sid", "least"), "sid").join(degree, "sid"), n_member))
    firsts = materialize(few(classed.groupBy("class").agg(F.min("least").alias("first"), F.count("*").alias("n")), n_member))
    linked = join_facts(classed, firsts, "class", "n").select("sid", "first", "links")
    facts = sets.select("sid", "other", "least", "docs").join(linked, "sid", "left")
    facts = facts.select("sid", F.col("other").alias("own"), F.coalesce("first", "least").alias("first"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "docs")
    facts = materialize(facts.where("links > 0"))
    out = join_facts(sketched.select("id", "text_hash", "sid", "other", "size"), facts, "sid", "docs")
    in_class = (F.col("size") > 0) & F.col("links").isNotNull() & (F.col("own") == F.col("other"))
    first = F.when(in_class, F.col("first")).otherwise(F.struct("id", "text_hash"))
    null_id = safe_id(F.lit(None))
    return out.select(
        F.when(F.col("id") != null_id, F.col("id")).alias(id_col), F.when(first["id"] != null_id, first["id"]).alias("class_id"),
        F.when(in_class, F.col("links")).otherwise(0).cast("long").alias("n_links"), F.col("size").alias("n_shingles"), "text_hash", (F.struct("id", "text_hash") == first).alias("kept"),
    )


def _bodies(n: int):
    """The whole shingle sets of documents that stand for a set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch["text"]):
                sets = shingle_sets(texts, n)
                own = {c: batch[c].slice(first, len(sets)) for c in ("sid", "docs", "class", "n_blocks")}
                yield pa.RecordBatch.from_pydict({**own, "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run
