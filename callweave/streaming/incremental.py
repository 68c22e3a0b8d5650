"""Merging call batches as they arrive: each micro-batch adds to mergeable states kept as parquet versions.

A state is (support_calls, mean, variance) per key; states of a batch are merged with the last version and written as
a new one, named by the batch, so a batch that is replayed after a failure overwrites its own version and counts once.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callweave.operators.aggregate import recombined


def batch_states(calls: DataFrame, keys: list[str]) -> DataFrame:
    """States of a batch of calls: support-weighted mean and variance of the start."""
    rows = calls.select(*keys, "support_calls", F.col("start_mean").alias("mean"), F.col("start_variance").alias("variance"))
    return recombined(rows, keys)


def latest_version(folder: str, before: int | None = None) -> str | None:
    found = sorted((int(p.name[1:]) for p in Path(folder).glob("v*") if (p / "_SUCCESS").exists()), reverse=True)
    found = [v for v in found if before is None or v < before]
    return f"{folder}/v{found[0]}" if found else None


def add_batch(spark: SparkSession, calls: DataFrame, batch: int, folder: str, keys: list[str]) -> None:
    fresh = batch_states(calls, keys)
    last = latest_version(folder, batch)
    merged = fresh if last is None else recombined(spark.read.parquet(last).unionByName(fresh), keys)
    merged.write.mode("overwrite").parquet(f"{folder}/v{batch}")


def start(stream: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Merge a stream of calls; runs what is there and stops."""
    run = lambda df, batch: add_batch(df.sparkSession, df, batch, folder, keys)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
