"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix. Native."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.llm.common import materialize

#: Rows that one bucket of a shard holds on average while its slots are dealt out.
BUCKET_ROWS = 200_000
#: numpy draws hypergeometric numbers exactly for populations below this.
_NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls, taken without putting any back from good + bad, are good; for populations of any size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    if good + bad < _NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, drawn))
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    part = good / (good + bad)
    reach = int(14 * (drawn * part * (1 - part)) ** 0.5) + 40  # what lies beyond has a probability below the rounding of doubles
    ks = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratios = np.log(good - ks[:-1]) + np.log(drawn - ks[:-1]) - np.log(ks[1:]) - np.log(bad - drawn + ks[1:])
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(ks[np.searchsorted(weights, rng.random() * weights[-1])])


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """counts[p, s]: how many rows partition p sends to shard s, distributed as under a uniform random permutation.

    Row sums are `sizes`, column sums `shard_sizes`, both exactly. Its rows are drawn one after the other from what the
    shards still lack: each count is hypergeometric given those before it.
    """
    rng, lacking = np.random.default_rng(seed), list(shard_sizes)
    counts = np.zeros((len(sizes), len(shard_sizes)), dtype=np.int64)
    for p, size in enumerate(sizes):
        rest, pool = size, sum(lacking)
        if pool < _NUMPY_POPULATION:
            counts[p] = rng.multivariate_hypergeometric(lacking, size, method="marginals")
            lacking = [lack - int(c) for lack, c in zip(lacking, counts[p], strict=True)]
            continue
        for s, lack in enumerate(lacking):
            pool -= lack
            counts[p, s] = hypergeometric(rng, lack, pool, rest) if rest else 0
            rest -= counts[p, s]
        lacking = [lack - int(c) for lack, c in zip(lacking, counts[p], strict=True)]
    return counts


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, size, text_crc32, law, shard, slot, grown_shard. Other columns are neither read nor returned.

    The law is `rows`: the shards' row counts differ by one at most (the first ones are the larger), and which rows a
    shard holds and in which order is a uniform random permutation of all rows. size: UTF-8 bytes of the text plus 8.

    1. Count the rows of each partition. From these counts alone draw the matrix that says how many rows go from each
       partition to each shard (one number a partition and shard, whatever the number of rows).
    2. Permute each partition by a keyed hash and cut it by its row of the matrix.
    3. Exchange, and permute each shard again. To give slots without collecting a shard in one task, a shard's rows go by
       the leading bits of their second hash to buckets of about BUCKET_ROWS; running sums of bucket sizes then number them.

    * A null text has no bytes: size 8, crc 0. Null or repeated ids are rows like any others, and equal rows are told
      apart by where they lie. An empty table gives an empty result; with fewer rows than shards some stay empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    light = materialize(light)  # the counts and what is cut by them must see the same partitions
    counted = light.groupBy("_part").count().orderBy("_part").collect()  # one row for each partition
    sizes = [r["count"] for r in counted]
    total = sum(sizes)
    matrix = communication_matrix(sizes, [total // n_shards + (s < total % n_shards) for s in range(n_shards)], seed)
    cuts = docs.sparkSession.createDataFrame([(r["_part"], [int(x) for x in row.cumsum()]) for r, row in zip(counted, matrix, strict=True)], "_part int, _cuts array<long>")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_at"), "_at")) - 1
    dealt = light.withColumn("_rank", rank).join(cuts, "_part").withColumn("_shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
    n_buckets = max(1, total // n_shards // BUCKET_ROWS)
    again = F.xxhash64(F.lit(seed), F.lit("shard"), "_at")
    dealt = dealt.select("_id", "_size", "_crc", "_at", "_shard", again.alias("_again"), F.floor((again / 2.0**64 + 0.5) * n_buckets).cast("int").alias("_bucket"))
    dealt = materialize(dealt)
    within = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_again", "_at")) - 1
    before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")).select("_shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = dealt.withColumn("_within", within).join(starts, ["_shard", "_bucket"])
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
