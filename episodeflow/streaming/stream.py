"""Incremental jobs with Structured Streaming (ST1-ST3).

Sources are file streams (each finished episode lands as a file); state
lives in the checkpoint under the shared ``spark.checkpoint.dir``; sinks
are written by the executors through ``foreachBatch`` (exactly-once per
micro-batch id), never collected to the driver.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.session import scratch_path
from episodeflow.streaming.landed import fold_batches, read_current, run_landed

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """File source; with a checkpoint each file is processed exactly once (ST2 resume)."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream of a whole driver table, one file or a folder of part files.

    The path is a pattern that only the table matches: for a plain path the
    source takes it as the base folder, which a single file is not.
    """
    return file_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parque[t]", schema)


def run_to_sink(agg: DataFrame, name: str, keys: Sequence[str], checkpoint: str | None = None, fold_every: int = 50) -> DataFrame:
    """Run an aggregate stream over everything available and return its current result.

    Update mode: a micro-batch lands only the keys that changed, as
    ``batch=<id>`` of a sink that belongs to the checkpoint (a repeated batch
    overwrites itself). The result is the row of the latest batch for each
    key, so a resumed run without new data returns what is there. Every
    ``fold_every`` batches the committed ones are folded into one, so a read
    does not grow with the number of batches.
    """
    spark = agg.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    sink = f"{ckpt.rstrip('/')}-results"
    schema = agg.schema

    def land(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % fold_every == 0:
            fold_batches(batch.sparkSession, sink, schema, keys, batch_id)
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    run_landed(agg, ckpt, land, mode="update")
    return read_current(spark, sink, schema, keys)


def summary_stream(events: DataFrame) -> DataFrame:
    """ST1 (+S12): running episode summary (steps so far, score of the latest step)."""
    from episodeflow.plans.bind import seq_key
    return events.groupBy(F.col("user_id").alias("episode_id")).agg(
        F.count(F.lit(1)).alias("num_actions"),
        F.max_by("value", seq_key(F.col("ts"), F.col("event_id"))).alias("score"))


def counter_stream(events: DataFrame) -> DataFrame:
    """ST3: running action counters across episodes."""
    return events.groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))
