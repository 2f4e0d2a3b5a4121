"""Exact selection of the first rows of an order, without sorting the rows: radix selection.

The order's first column gives digits of 16 bits. A level counts the rows of each digit (a grouped
aggregate, at most 65,536 cells a group) and finds the one cell in which the cut falls; the next level
looks at that cell only. What is left is one key, the threshold, and every row is judged by comparing
it with the threshold: a filter, with no exchange of the rows, no window over them and no checkpoint.

Rows with equal keys are told apart by a hash of all their columns, level by level as well, and fully
equal rows are counted, not ranked, so a key with a third of all rows stays spread out. Such ties have
a defined result: the smaller row hash goes first.

Only columns of the key are read to find the cut. Thresholds (one row a group) reach the driver for at
most ``FEW_GROUPS`` groups; ``first_rows`` refuses more, and callers have another way for them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW_GROUPS = 10_000
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def hex_digits(h: Column, levels: int = 2) -> list[Column]:
    """Digits of a hexadecimal text, four characters each; a null is before all."""
    return [F.coalesce(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int"), F.lit(-1)) for i in range(levels)]


def long_digits(v: Column) -> list[Column]:
    """Digits of a signed integer, 16 bits each, in its order; a null is before all."""
    v = v.cast("long")
    low = [F.coalesce(F.shiftright(v, s).bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1)) for s in (32, 16, 0)]
    return [F.coalesce(F.shiftright(v, 48).cast("int"), F.lit(-(1 << 16))), *low]


def _same(group: Sequence[str], left: str, right: str) -> Column:
    """Join condition on the group columns (null equals null); always true without any."""
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}"))
    return cond


def _with_cut(rows: DataFrame, cut: DataFrame, group: Sequence[str], names: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the columns ``names`` of their group's row of ``cut`` (a few rows, counted before)."""
    if not group:
        first = cut.first()
        if first is None:
            none = rows.select("*", *[F.lit(None).cast(cut.schema[n].dataType).alias(n) for n in names])
            return none.where(F.lit(False)) if how == "inner" else none
        return rows.select("*", *[F.lit(first[n]).cast(cut.schema[n].dataType).alias(n) for n in names])
    return rows.alias("l").join(F.broadcast(cut).alias("r"), _same(group, "l", "r"), how).select("l.*", *[F.col(f"r.{n}").alias(n) for n in names])


def _few(spark, rows: list, schema: T.StructType) -> DataFrame:
    if len(rows) > FEW_GROUPS:
        raise ValueError(f"more than {FEW_GROUPS} groups")
    return spark.createDataFrame(rows, schema)


def _descend(rows: DataFrame, group: Sequence[str], digits: Sequence[Column], keys: Sequence[str], need: Column | None = None) -> DataFrame:
    """``group, keys as _t0.., _take, _copies``: the threshold key of each group that has a cut, and how many of its copies go in.

    Without ``need`` the rows carry the wanted number of their group as ``_need``.
    """
    spark = rows.sparkSession
    own = [] if need is not None else ["_need"]
    by = Window.partitionBy(*group)

    def cut(cells: DataFrame, order: Sequence[str], wanted: Column) -> DataFrame:
        """The cell in which each group's cut falls."""
        upto = F.sum("_c").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("_upto", upto).withColumn("_total", F.sum("_c").over(by)).withColumn("_need", wanted.cast("long"))
        cells = cells.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_c") < F.col("_need")))
        return cells.withColumn("_need", F.col("_need") - (F.col("_upto") - F.col("_c"))).drop("_upto", "_total")

    left = rows.select(*group, *keys, *own, *[d.alias(f"_d{i}") for i, d in enumerate(digits)])
    wanted = need if need is not None else F.col("_need")
    for i in range(len(digits)):
        cells = left.groupBy(*group, f"_d{i}", *own).agg(F.count(F.lit(1)).alias("_c"))
        found = cut(cells, [f"_d{i}"], wanted).select(*group, F.col(f"_d{i}").alias("_cell"), "_need")
        found = _few(spark, found.limit(FEW_GROUPS + 1).collect(), found.schema)
        left = _with_cut(left.drop("_need"), found, group, ["_cell", "_need"], "inner").where(F.col(f"_d{i}") == F.col("_cell")).drop("_cell")
        wanted, own = F.col("_need"), ["_need"]
    cells = left.groupBy(*group, *keys, *own).agg(F.count(F.lit(1)).alias("_c"))
    found = cut(cells, list(keys), wanted).select(*group, *[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_need").alias("_take"), F.col("_c").alias("_copies"))
    return _few(spark, found.limit(FEW_GROUPS + 1).collect(), found.schema)


def _struct(cols: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def first_rows(rows: DataFrame, n: int | Column, keys: Sequence[str], digits: Sequence[Column], group: Sequence[str] = (), flag: str = "_first") -> DataFrame:
    """``rows`` with a boolean ``flag``: is the row among the first ``n`` of its group in the order of ``keys``?

    ``n`` is a number, or a column of ``_total``, the rows of the group (no more than it). ``digits`` must
    rise with ``keys[0]``. Fully equal rows may change places; their number does not change.
    """
    all_if_short = F.lit(n > 0) if isinstance(n, int) else F.lit(False)
    columns = rows.columns
    limits = _descend(rows, group, digits, keys, F.lit(n) if isinstance(n, int) else n)
    t = [f"_t{i}" for i in range(len(keys))]
    out = _with_cut(rows, limits, group, [*t, "_take", "_copies"])
    mine, limit = _struct([F.col(k) for k in keys]), _struct([F.col(x) for x in t])
    short, at, some = F.col("_take").isNull(), mine == limit, F.col("_take") < F.col("_copies")
    plain = F.when(short, all_if_short).otherwise(mine <= limit)
    if not limits.where(some).take(1):
        return out.select(*columns, plain.alias(flag))

    # Copies of a key over the cut: the row hash decides, then the number of equal rows.
    h = "_h_all"
    hashed = out.withColumn(h, F.xxhash64(*columns))
    tied = ~short & at & some
    ties = _descend(hashed.where(tied).select(*group, h, F.col("_take").alias("_need")), group, long_digits(F.col(h)), [h])
    hashed = _with_cut(hashed, ties.select(*group, F.col("_t0").alias("_th"), F.col("_take").alias("_htake"), F.col("_copies").alias("_hcopies")), group, ["_th", "_htake", "_hcopies"])
    split = tied & (F.col(h) == F.col("_th")) & (F.col("_htake") < F.col("_hcopies"))
    whole = hashed.where(~F.coalesce(split, F.lit(False))).select(*columns, F.when(tied, F.col(h) <= F.col("_th")).otherwise(plain).alias(flag))
    equal = hashed.where(split).groupBy(*columns, "_htake").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(1), *columns)).rowsBetween(Window.unboundedPreceding, -1))
    copies = equal.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    return whole.unionByName(copies.select(*columns, (F.col("_before") + F.col("_i") <= F.col("_htake")).alias(flag)))
