"""Micro-batches landed by id, folded and carried (ST1, ST2, W3, A14).

A stream lands each micro-batch as ``batch=<id>`` of a folder that belongs to its checkpoint. A batch
that is run again (the stream ended after its rows were landed and before Spark committed the batch)
overwrites itself, so every input row is in the folder exactly once whenever a run has ended. Runs over the
same checkpoint take only files that no committed batch had.
"""

from __future__ import annotations

import re
from typing import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.operators.metering import UNIT
from episodeflow.plans.rank import in_group
from episodeflow.sources.named_files import file_system

#: Ends a run that has landed as many batches as it may.
_ENOUGH = "the run has landed its batches"


def batches(folder: str, kind: str = "batch") -> list[int]:
    """Ids of the batches (or of the folds, with ``kind`` 'folded') that lie whole in ``folder``, ascending."""
    fs, plain = file_system(folder)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(plain, allow_not_found=True)):
        m = re.fullmatch(rf"{kind}=(\d+)", info.base_name)
        if m and fs.get_file_info(f"{info.path}/_SUCCESS").type == pafs.FileType.File:
            out.append(int(m.group(1)))
    return sorted(out)


def read_landed(spark: SparkSession, folder: str, schema: T.StructType, ids: Sequence[int] | None = None) -> DataFrame:
    """Rows of the landed batches (of ``ids`` only, if given) with their ``batch``."""
    ids = batches(folder) if ids is None else list(ids)
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    if not ids:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", folder).parquet(*[f"{folder}/batch={i}" for i in ids])


def run_landed(rows: DataFrame, checkpoint: str, land: Callable[[DataFrame, int], None], max_batches: int | None = None, mode: str = "append") -> bool:
    """Run a stream over everything available, or over ``max_batches`` micro-batches of it.

    ``land(batch, id)`` writes a batch; it must give the same when it is called again with the same id.
    A bounded run ends after ``land`` and before Spark commits that batch, as a lost driver would;
    the next run lands it again. Returns whether everything available was read.
    """
    done = 0

    def once(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        land(batch, batch_id)
        done += 1
        if max_batches is not None and done >= max_batches:
            raise RuntimeError(_ENOUGH)

    q = rows.writeStream.outputMode(mode).foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except StreamingQueryException as e:
        if _ENOUGH not in str(e):
            raise
        return False
    return True


def append_batches(rows: DataFrame, checkpoint: str, folder: str, max_batches: int | None = None) -> bool:
    """ST2: every row of a stream in ``folder`` exactly once, over any number of runs."""
    return run_landed(rows, checkpoint, lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/batch={i}"), max_batches)


def fold_batches(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], before: int) -> None:
    """Compaction of update batches: of all below ``before`` (all committed by Spark) the latest row of a key stays.

    They become ``folded=<id of the last>``; what it replaces is removed only after it lies whole, and a
    reader passes over what a fold that ended half-way has left.
    """
    old = [i for i in batches(folder) if i < before]
    if not old:
        return
    bases = batches(folder, "folded")
    if not bases or bases[-1] < old[-1]:
        rows = read_current(spark, folder, schema, keys, before)
        rows.write.mode("overwrite").parquet(f"{folder}/folded={old[-1]}")
    fs, plain = file_system(folder)
    for name in [f"batch={i}" for i in old] + [f"folded={i}" for i in bases if i < old[-1]]:
        fs.delete_dir(f"{plain}/{name}")


def read_current(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """The latest row of each key: the newest fold and the batches after it (only those below ``before``)."""
    bases = batches(folder, "folded")
    newer = [i for i in batches(folder) if (not bases or i > bases[-1]) and (before is None or i < before)]
    rows = read_landed(spark, folder, schema, newer)
    if bases:
        base = spark.read.schema(schema).parquet(f"{folder}/folded={bases[-1]}")
        rows = rows.unionByName(base.withColumn("batch", F.lit(bases[-1]).cast("long")))
    return latest_rows(rows, schema, keys)


def latest_rows(rows: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The row of the latest batch for each key."""
    values = F.struct(*[c for c in schema.names if c not in keys])
    g = rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v"))
    return g.select(*[F.col(c) if c in keys else F.col(f"v.`{c}`").alias(c) for c in schema.names])


def stream_cost(priced: DataFrame, checkpoint: str, folder: str, run: str, order: list[str], max_batches: int | None = None) -> bool:
    """W3 on a stream: every priced call with the running cost and position of its run (``total_units``, ``position``).

    Calls count in the order of their micro-batches, inside one by ``order``. A run's rows of a
    batch are summed by the distributed rank (``in_group``), not in one task, and moved on by the totals of all
    batches before, one row a run. These totals are landed by batch id as well (``<folder>-totals``, A14), so
    a batch that is run again starts from the same totals; those of the last two batches are kept.
    """
    schema = priced.schema
    run_type = schema[run].dataType
    totals = f"{folder}-totals"
    carry_schema = T.StructType([T.StructField(run, run_type), T.StructField("units", T.LongType()), T.StructField("calls", T.LongType())])

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [i for i in batches(totals) if i < batch_id]
        carry = read_landed(spark, totals, carry_schema, before[-1:]).drop("batch")
        x = batch.withColumn("_u", F.coalesce(F.col("cost_units"), F.lit(0)).cast("long"))
        ranked = in_group(x, run, order, position="_pos", sums={"_cum": "_u"})
        c = carry.withColumnRenamed(run, "_run")
        j = ranked.join(c, F.col(run).eqNullSafe(F.col("_run")), "left")
        out = j.select(*schema.names, (F.col("_cum") + F.coalesce("units", F.lit(0))).cast("long").alias("total_units"),
                       (F.col("_pos") + F.coalesce("calls", F.lit(0))).cast("long").alias("position"))
        out.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        here = x.groupBy(run).agg(F.sum("_u").alias("units"), F.count(F.lit(1)).alias("calls"))
        both = carry.unionByName(here.select(run, "units", "calls"))
        both.groupBy(run).agg(F.sum("units").alias("units"), F.sum("calls").alias("calls")).write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")
        fs, plain = file_system(totals)
        for i in before[:-1]:
            fs.delete_dir(f"{plain}/batch={i}")

    return run_landed(priced, checkpoint, land, max_batches)


def read_cost(spark: SparkSession, folder: str, schema: T.StructType, run: str) -> DataFrame:
    """What ``stream_cost`` has landed: running cost, running mean and the projection with the calls so far."""
    full = T.StructType(schema.fields + [T.StructField("total_units", T.LongType()), T.StructField("position", T.LongType())])
    done = batches(f"{folder}-totals")
    carry = T.StructType([schema[run], T.StructField("calls", T.LongType())])
    n = read_landed(spark, f"{folder}-totals", carry, done[-1:]).select(F.col(run).alias("_run"), "calls")
    rows = read_landed(spark, folder, full, [i for i in batches(folder) if done and i <= done[-1]])
    cost = F.col("total_units").cast("double") * F.lit(float(UNIT))
    return (rows.join(n, F.col(run).eqNullSafe(F.col("_run")))
                .withColumn("running_cost", cost).withColumn("running_mean", cost / F.col("position"))
                .withColumn("projected_cost", cost / F.col("position") * F.col("calls")).drop("_run", "calls", "batch"))
