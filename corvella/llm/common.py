"""What the operators share: reading tables, cutting lineage and joining per-key facts back to rows without skew."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold more than 1/HOT_KEYS of all rows, so a table of them is always small.
HOT_KEYS = 1024
#: Bytes of rows that a Python worker gets at once: documents may be long, and several batches are in memory at a time.
BATCH_BYTES = 4 << 20
#: Stands for a null id where rows are ordered or joined by id; it sorts before every other.
NULL_ID = -(2**63)


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python workers in batches of at most BATCH_BYTES, unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be of any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a temporary one in local mode (tests), else an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvella-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    This cuts the lineage: what follows never recomputes what came before, and a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are over: it does when their plans have been collected as garbage, here
    and then in the JVM, where the first collection only finds what the second one frees."""
    gc.collect()
    for _ in range(2):
        time.sleep(0.3)  # references are dropped in the background
        spark.sparkContext._jvm.java.lang.System.gc()


def clean_up(spark: SparkSession) -> int:
    """Remove the tables that operators have written to the shared folder; results that still read them must be saved before. Returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def few(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """The rows in as many partitions as `rows`, their number, asks for, where that is fewer than a shuffle makes.

    Iterations over small tables are then not all task starts, also where adaptive execution is off.
    """
    parts = max(1, -(-rows // per_task))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def safe_id(column: str | Column) -> Column:
    """An id as long; null becomes NULL_ID."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Left-join one fact row per key to many rows, whatever share of the rows one key has.

    `facts` must be materialised and have columns `key` and `count` (how many of `rows` have the key). Keys with more than
    1/HOT_KEYS of the counted rows number fewer than HOT_KEYS, so they are broadcast, and their rows never meet in one
    task; all other keys go through an ordinary shuffled join, in which the rows that have been served already are
    scattered by a key of their own. Rows without a fact get nulls.
    """
    others = [c for c in facts.columns if c != key]
    total = facts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(count) * HOT_KEYS > F.lit(total)
    hot = facts.where(is_hot).select(F.col(key).alias("_hk"), F.struct(*others).alias("_hot"))
    cold = facts.where(~is_hot).select(F.col(key).alias("_ck"), F.lit(0).cast("long").alias("_cs"), F.struct(*others).alias("_cold"))
    served = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    served = served.withColumn("_rs", F.when(F.col("_hot").isNotNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    joined = served.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_rs") == F.col("_cs")), "left").drop("_ck", "_cs", "_rs")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *(found[c].alias(c) for c in others))
