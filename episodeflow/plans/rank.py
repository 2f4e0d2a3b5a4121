"""Distributed exact rank and prefix sum.

A global ``row_number()`` or running ``sum`` without ``partitionBy`` moves
every row into one task. These helpers keep the work spread out instead:

1. range-partition on the order key (``repartitionByRange``: sampled
   bounds, any number of partitions; a hot value of a leading column is
   still split because the order is total), sort inside each partition,
   and tag every row with its partition id and local position,
2. ``checkpoint()`` that tagged data into the shared
   ``spark.checkpoint.dir``,
3. count (or sum) per partition -- one row per partition, so broadcasting
   the resulting offsets is safe -- and add them to the local positions.

Why the checkpoint: the range bounds are drawn from a sample whose seed
depends on the RDD id, so two evaluations of the same plan (the counting
branch and the ranking branch) may partition differently. Reading both
branches from one materialized copy makes ranks exact and consistent; it
also cuts the lineage, so a lost executor re-reads the copy instead of
re-sampling. The order must be total (end it with a unique column).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.session import ensure_checkpoint_dir, ship_package

_LOCAL_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row index in the low 33 bits


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted copy with ``_pid`` and 0-based ``_local`` position, checkpointed."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = _num_partitions(df, num_partitions)
    parts = (df.repartitionByRange(n, *cols)
               .sortWithinPartitions(*cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))))
    ensure_checkpoint_dir(df.sparkSession)
    ship_package(df.sparkSession)
    return parts.checkpoint(eager=True)


def _offsets(per_part: DataFrame, cols: dict[str, str]) -> DataFrame:
    # One row per partition: unpartitioned windows here touch at most n rows.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [F.col("_pid")]
    for src, name in cols.items():
        out.append(F.coalesce(F.sum(src).over(before), F.lit(0)).alias(name))
    out.append(F.sum(list(cols)[0]).over(everything).alias("_total"))
    return F.broadcast(per_part.select(*out))


def global_rank(df: DataFrame, order: Sequence[str | Column], rank_col: str = "rank",
                num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """Add a 1-based exact rank of each row under ``order`` (must be total).

    ``total_col`` also adds the row count of the whole input, taken from the
    same per-partition counts.
    """
    parts = ranged(df, order, num_partitions)
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    out = (parts.join(_offsets(counts, {"_n": "_off"}), "_pid")
                .withColumn(rank_col, (F.col("_off") + F.col("_local") + 1).cast("long")))
    if total_col:
        out = out.withColumn(total_col, F.col("_total").cast("long"))
    return out.drop("_pid", "_local", "_off", "_total")


def _new_group(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first: does its group differ from the row before (null equals null)."""
    out = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differs = pc.not_equal(c[1:], c[:-1])
        same_null = pc.equal(pc.is_null(c[1:]), pc.is_null(c[:-1]))
        out |= pc.fill_null(differs, False).to_numpy(zero_copy_only=False) | ~same_null.to_numpy(zero_copy_only=False)
    return out


class _Walk:
    """State of one pass over sorted rows: position, sums, previous values and flags inside the group."""

    def __init__(self, groups, sums, lags, flags):
        self.groups, self.sums, self.lags, self.flags = groups, sums, lags, flags
        self.tail = None  # last row seen: group values and running values

    def batch(self, b: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        n = b.num_rows
        keys = [cols[g] for g in self.groups]
        cut = _new_group(keys)
        same = self.tail is not None and all(k[0].as_py() == t for k, t in zip(keys, self.tail["key"]))
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        pos = np.arange(n) - first + 1
        head = int(sizes[0]) if same else 0  # rows that go on with the group of the batch before
        pos[:head] += self.tail["pos"] if same else 0
        out = {"_pos": pa.array(pos)}
        opening = np.zeros(n, bool)  # rows of the partition's first group
        if self.tail is None or (same and self.tail["opens"]):
            opening[: int(sizes[0])] = True
        out["_opens"] = pa.array(opening)
        tail = {"key": [k[n - 1].as_py() for k in keys], "pos": int(pos[-1]), "opens": bool(opening[-1])}
        for name, col in self.sums.items():
            v = pc.fill_null(cols[col].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(v)
            before = np.concatenate([[0], total])[first]
            run = total - before
            run[:head] += self.tail[name] if same else 0
            out[name], tail[name] = pa.array(run), int(run[-1])
        for name, col in self.lags.items():
            at = np.arange(n) - 1
            lag = cols[col].take(pa.array(at, mask=pos - np.where(np.arange(n) < head, self.tail["pos"] if same else 0, 0) == 1))
            if head:
                lag = pa.concat_arrays([pa.array([self.tail[name]], lag.type), lag[1:]])
            out[name], tail[name] = lag, cols[col][n - 1].as_py()
        for name, col in self.flags.items():
            v = pc.fill_null(cols[col], False).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v)
            seen = (total - v) - np.concatenate([[0], total])[first] > 0
            if same and self.tail[name]:
                seen[:head] = True
            out[name], tail[name] = pa.array(seen), bool(seen[-1] or v[-1])
        self.tail = tail
        return pa.RecordBatch.from_arrays(list(b.columns) + list(out.values()), list(b.schema.names) + list(out))


def in_group(df: DataFrame, group: str | Sequence[str], order: Sequence[str], position: str | None = None,
             sums: dict[str, str] | None = None, lags: dict[str, str] | None = None, flags: dict[str, str] | None = None,
             num_partitions: int | None = None) -> DataFrame:
    """Values along the order of each group, without a window or a join on the group.

    ``position``: name of the 1-based position. ``sums``: name -> long column,
    its running sum. ``lags``: name -> column, its value in the row before.
    ``flags``: name -> boolean column, was it true in an earlier row.

    The rows are range-partitioned and sorted once (``ranged``). One Arrow
    pass over a partition computes everything inside it; only the group that
    an earlier partition began needs a carry, one row per partition. So a
    group may hold any share of the rows. Carried columns pass unchanged.
    """
    groups = [group] if isinstance(group, str) else list(group)
    sums, lags, flags = sums or {}, lags or {}, flags or {}
    parts = ranged(df, [*groups, *order], num_partitions)
    added = [T.StructField("_pos", T.LongType()), T.StructField("_opens", T.BooleanType()),
             *[T.StructField(k, T.LongType()) for k in sums], *[T.StructField(k, df.schema[c].dataType) for k, c in lags.items()],
             *[T.StructField(k, T.BooleanType()) for k in flags]]

    def walk(batches):
        state = _Walk(groups, sums, lags, flags)
        for b in batches:
            if b.num_rows:
                yield state.batch(b)

    local = parts.mapInArrow(walk, T.StructType(parts.schema.fields + added))
    # One row per partition: its first and last group and the values of its last row.
    ends = local.groupBy("_pid").agg(
        F.min_by(F.struct(*groups), "_local").alias("head"), F.max_by(F.struct(*groups), "_local").alias("tail"),
        F.max_by(F.struct("_pos", "_opens", *sums, *flags, *[F.col(c).alias(f"_v_{k}") for k, c in lags.items()],
                          *[F.col(c).alias(f"_f_{k}") for k, c in flags.items()]), "_local").alias("last")).orderBy("_pid").collect()
    carry, state = [], None
    for e in ends:
        goes_on = state is not None and state["key"] == e.head
        if goes_on:
            carry.append((e["_pid"], state["pos"], *[state[k] for k in (*sums, *lags, *flags)]))
        add = state if goes_on and e.last["_opens"] else None
        state = {"key": e.tail, "pos": e.last["_pos"] + (add["pos"] if add else 0)}
        state |= {k: e.last[k] + (add[k] if add else 0) for k in sums}
        state |= {k: e.last[f"_v_{k}"] for k in lags}
        state |= {k: bool(e.last[k] or e.last[f"_f_{k}"] or (add and add[k])) for k in flags}
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_c_pos", T.LongType()),
                           *[T.StructField(f"_c_{k}", next(f.dataType for f in added if f.name == k)) for k in (*sums, *lags, *flags)]])
    carried = df.sparkSession.createDataFrame(carry, schema)
    out = local.join(F.broadcast(carried), "_pid", "left")
    mine = F.col("_opens") & F.col("_c_pos").isNotNull()
    cols = [F.col(c) for c in df.columns]
    if position:
        cols.append((F.col("_pos") + F.when(mine, F.col("_c_pos")).otherwise(0)).alias(position))
    cols += [(F.col(k) + F.when(mine, F.col(f"_c_{k}")).otherwise(0)).alias(k) for k in sums]
    cols += [F.when(mine & (F.col("_pos") == 1), F.col(f"_c_{k}")).otherwise(F.col(k)).alias(k) for k in lags]
    cols += [(F.col(k) | F.coalesce(mine & F.col(f"_c_{k}"), F.lit(False))).alias(k) for k in flags]
    return out.select(*cols)


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, out_col: str = "cum",
               num_partitions: int | None = None, rank_col: str | None = None) -> DataFrame:
    """Running sum of ``value`` over all rows up to and including each row.

    The sum inside a partition is an Arrow-batched ``cumsum`` over the
    checkpointed, sorted partition (narrow, no shuffle); the other columns pass
    as they are, and integral values are summed exactly in int64. ``rank_col`` also adds the exact position.
    """
    parts = ranged(df, order, num_partitions)
    integral = isinstance(df.schema[value].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    vtype = T.LongType() if integral else T.DoubleType()
    np_type = "int64" if integral else "float64"
    schema = T.StructType(parts.schema.fields + [T.StructField("_lsum", vtype)])

    def local_cumsum(batches):
        carry = 0
        for b in batches:
            v = b.column(b.schema.names.index(value))
            x = pc.fill_null(v.cast(pa.int64() if integral else pa.float64()), 0).to_numpy(zero_copy_only=False)
            run = np.cumsum(x) + carry
            if len(run):
                carry = run[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run)], [*b.schema.names, "_lsum"])

    local = parts.mapInArrow(local_cumsum, schema)
    zero = F.lit(0) if integral else F.lit(0.0)
    per = parts.groupBy("_pid").agg(F.sum(F.coalesce(F.col(value).cast(vtype), zero)).alias("_t"),
                                    F.count(F.lit(1)).alias("_c"))
    out = (local.join(_offsets(per, {"_t": "_off", "_c": "_coff"}), "_pid")
                .withColumn(out_col, F.col("_off") + F.col("_lsum")))
    if rank_col:
        out = out.withColumn(rank_col, (F.col("_coff") + F.col("_local") + 1).cast("long"))
    return out.drop("_pid", "_local", "_lsum", "_off", "_coff", "_total")
