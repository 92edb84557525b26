"""Structured Streaming jobs on files of battles, messages and results.

State is kept in Spark aggregations, which combine before the shuffle: a battle
or agent that sends a third of all rows does not overload one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_path


def file_stream(spark: SparkSession, root: str, schema: StructType, glob: str = "*.parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below ``root``; the query's checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(root)


def run_append(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process everything available into a Parquet table and return the table."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_update(stream: DataFrame, key: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Process everything available of an aggregating stream; each batch adds its changed rows to a table and
    the newest row per key is returned."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.parquet(path).drop("part")
    values = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*key, "_v.*")


def live_snapshots(messages: DataFrame, battle: Sequence[str], order: Sequence[str], facts: dict[str, Column]) -> DataFrame:
    """Current snapshot per battle: the latest known value of each fact and the messages seen."""
    at = F.struct(*order)
    latest = [F.max_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in facts.items()]
    return messages.groupBy(*battle).agg(*latest, F.count("*").alias("messages"))


def hourly_throughput(results: DataFrame, ts: str, agent: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Results per agent and hour; rows later than the watermark are left out."""
    w = F.window(ts, width)
    return results.withWatermark(ts, late).groupBy(w.alias("w"), agent).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("hour"), agent, "n")


def first_results(results: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Results without repeats of an id within the watermark."""
    return results.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def live_posteriors(outcomes: DataFrame, key: str, result: Column) -> DataFrame:
    """Beta posterior per key, kept up to date."""
    n = lambda v: F.sum(F.when(result == v, 1).otherwise(0))
    return outcomes.groupBy(key).agg(
        (1.0 + n("WIN") + 0.5 * n("DRAW")).alias("alpha"), (1.0 + n("LOSS") + 0.5 * n("DRAW")).alias("beta"),
        n("WIN").alias("wins"), n("LOSS").alias("losses"))


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """Fresh output and checkpoint paths in shared storage."""
    base = shared_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"


def each_available(stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None]) -> None:
    """Run ``action`` on each micro-batch of what is available."""
    stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
