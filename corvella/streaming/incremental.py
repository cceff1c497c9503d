"""Streams: tailing logs, windowed usage, incremental rules, resumable batches. An addition to what the reference computes in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of JSON lines as they come."""
    return spark.readStream.schema(schema).json(path)


def hourly_usage(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls and tokens an hour and stage; rows later than `late` are dropped with their state."""
    w = F.window("ts", "1 hour")
    return calls.withWatermark("ts", late).groupBy(w.alias("w"), "stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens")).select(F.col("w.start").alias("hour"), "stage", "calls", "tokens")


def once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take all that is there into parquet files, exactly once over restarts."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch to `work`; it must be idempotent for a batch's number."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(changes: DataFrame, store: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch worker that keeps the latest row of each key in a folder of generations."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{store}/{number - 1}")
        except Exception:  # the first generation
            old = spark.createDataFrame([], batch.schema)
        both = old.unionByName(batch)
        both.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{store}/{number}")

    return work


def pending(cells: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do: cells of a plan without a result."""
    return cells.join(done.select(*key).distinct(), key, "left_anti")


def next_phase(handles: DataFrame) -> DataFrame:
    """The phase each paper is in: level 1, 2, 3 or done, by the least level whose chunks aren't all decided."""
    open_ = F.min(F.when(~F.col("decided"), F.col("level")))
    return handles.groupBy("pmcid").agg(F.coalesce(F.concat(F.lit("L"), open_.cast("string")), F.lit("done")).alias("phase"))


def stage_cache(spark: SparkSession, root: str, stage: str, digest: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage's rows by the digest of its input; built when they aren't there."""
    path = f"{root}/{stage}/{digest}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
