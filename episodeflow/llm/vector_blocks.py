"""A stated query set against all vectors, in blocks: each task holds one block of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodeflow.llm.common import land
from episodeflow.llm.near_dedup import task_groups

K = 10
#: A query is a row whose id is divisible by this.
EVERY = 100


def finite(vectors: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """``id, v`` (doubles) of the rows with an id and only finite components (and, if asked, a non-zero one)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return v if allow_zero else v.filter(F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, answer: Callable, block: int, query_block: int, k: int = K, every: int = EVERY, score_type: str = "double",
           ascending: bool = True, state: Callable | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best k of all blocks for each query.

    ``answer(state(ids, matrix), ids, query id, query)`` gives candidate positions and scores of one
    block; only vectors of equal length meet. Blocks hold about ``block`` vectors and
    ``query_block`` queries, so a task's memory does not grow with the input.
    """
    rows = land(rows.withColumn("dim", F.size("v")), "vectors")
    n, q = rows.agg(F.count("*"), F.count(F.when(F.pmod("id", F.lit(every)) == 0, 1))).first()
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))
    task = F.format_string("%d|%d|%d", "dim", "vb", "qb").alias("task")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = (rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("qb", spread(n_query_blocks))
            .select(task, F.lit(False).alias("asks"), "id", "v"))
    right = (rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_query_blocks)).cast("int"))
             .withColumn("vb", spread(n_blocks)).select(task, F.lit(True).alias("asks"), "id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in task_groups(batches):
            asks = t["asks"].to_numpy()
            ids = t["id"].to_numpy()
            flat = t["v"].combine_chunks().flatten().to_numpy()
            matrix = flat.reshape(len(ids), len(flat) // len(ids))  # of equal length; it may be 0
            own = np.flatnonzero(~asks)
            own = own[np.argsort(ids[own], kind="stable")]
            if not len(own) or not asks.any():
                continue
            held = state(ids[own], matrix[own])
            out = [], [], []
            for i in np.flatnonzero(asks):
                at, score = answer(held, ids[own], int(ids[i]), matrix[i])
                out[0].extend([int(ids[i])] * len(at))
                out[1].extend(ids[own][at].tolist())
                out[2].extend(score)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                                  pa.array(out[2], pa.float64() if score_type == "double" else pa.int64())], ["query_id", "vec_id", "score"])

    found = left.unionByName(right).repartition("task").sortWithinPartitions("task").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").asc() if ascending else F.col("score").desc_nulls_last(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
