"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.llm.common import join_facts, materialize, safe_id
from corvella.llm.textops import let_go

_RUN = "slot int, digest binary, n_bytes long, witness long, best long, n long"


def _collapse(smallest: bool):
    """A mapInArrow function: rows sorted by (slot, digest, n_bytes, witness) -> one row for each, with the best id and the count.

    It streams: what it holds is one batch and the group that the batch's end may have cut.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["slot", "digest", "n_bytes", "witness"]
        picked = "best_min" if smallest else "best_max"
        carried: pa.Table | None = None
        let_go()
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if carried is not None:
                t = pa.concat_tables([carried, t])
            g = t.group_by(keys, use_threads=False).aggregate([("best", "min" if smallest else "max"), ("n", "sum")])
            g = g.select([*keys, picked, "n_sum"]).rename_columns([*keys, "best", "n"]).cast(batch.schema)
            carried = g.slice(g.num_rows - 1)  # groups come in order of first appearance, so only the last may go on
            yield from g.slice(0, g.num_rows - 1).to_batches()
        if carried is not None:
            yield from carried.to_batches()

    return merge


def digest_groups(rows: DataFrame, smallest: bool, fan_in: int) -> DataFrame:
    """Merge runs over `rows` (digest, n_bytes, witness, id) to one row per distinct text: digest, n_bytes, witness, best, n.

    Every input partition makes a sorted run of its digests. The runs are exchanged in rounds, as in a binomial tree with
    `fan_in` children: in round r a run is cut by digit r of its digests, and the partitions whose numbers differ in digit
    r alone swap those parts, so that each has 1/fan_in of its digests afterwards and merges fan_in sorted parts of them.
    After log(partitions) rounds each digest is in one place. Equal texts collapse at every level, the best id is retained
    if the digest, the byte length and an independent 64-bit hash all agree, and no task ever sees more than fan_in rows of
    a text for each partition it hears from, however many copies there are.
    """
    keys = ["slot", "digest", "n_bytes", "witness"]
    partitions = max(rows.rdd.getNumPartitions(), 2)
    rounds = max(1, math.ceil(math.log(partitions, fan_in) - 1e-9))
    slots = fan_in**rounds
    at = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % slots  # the digest's last place
    runs = rows.select((F.spark_partition_id() % slots).alias("slot"), "digest", "n_bytes", "witness", F.col("id").alias("best"), F.lit(1).cast("long").alias("n"))
    runs = runs.sortWithinPartitions(*keys).mapInArrow(_collapse(smallest), _RUN)
    for r in range(rounds):
        unit = fan_in**r
        digit = lambda c: F.floor(c / unit) % fan_in
        slot = (F.col("slot") + (digit(at) - digit(F.col("slot"))) * unit).cast("int")
        runs = runs.withColumn("slot", slot).repartition(min(slots, max(partitions, 2)), "slot").sortWithinPartitions(*keys).mapInArrow(_collapse(smallest), _RUN)
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256. Other columns are neither read nor returned.

    Texts are equal when identical; of equal texts the row with the smallest (or, with keep="largest", largest) id stays.

    * A null text counts as the empty text. A null id ranks below all others, so with keep="smallest" it stays; keep_id is
      then null.
    * Rows that repeat both id and text are one row told twice: each counts in group_size, and all of them are kept or none.
    * An empty table gives an empty result. Texts of any length are hashed in the JVM and never leave it.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_own_id"), safe_id(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("witness"),
    )
    groups = materialize(digest_groups(rows, keep == "smallest", fan_in).where("n > 1"))
    key = F.concat_ws("/", F.hex("digest"), "n_bytes", "witness")
    marked = join_facts(rows.withColumn("text_key", key), groups.select(key.alias("text_key"), "best", "n"), "text_key", "n")
    keep_id = F.coalesce("best", "id")
    return marked.select(
        F.col("_own_id").alias(id_col),
        F.when(keep_id != safe_id(F.lit(None)), keep_id).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (keep_id == F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
