"""Cost metering.

Costs are computed in exact integer units (1e-10 USD) so that totals do
not depend on the order in which partial sums are combined; the price
table is a fixed, tiny literal table, so broadcasting it is always safe.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeflow.plans.rank import in_group

# USD per input token and per output token, by model.
PRICES_USD = [
    ("gpt-4o", "5/1e6", "15/1e6"),
    ("gpt-4o-mini", "0.15/1e6", "0.6/1e6"),
    ("gpt-4-1106-preview", "0.01/1000", "0.03/1000"),
    ("gpt-4", "0.03/1000", "0.06/1000"),
    ("gpt-4-32k", "0.06/1000", "0.12/1000"),
    ("gpt-3.5-turbo", "0.001/1000", "0.002/1000"),
    ("gpt-3.5-turbo-instruct", "0.0015/1000", "0.002/1000"),
    ("gpt-3.5-turbo-16k", "0.003/1000", "0.004/1000"),
    ("babbage-002", "0.0016/1000", "0.0016/1000"),
    ("davinci-002", "0.012/1000", "0.012/1000"),
    ("ada-v2", "0.0001/1000", "0.0001/1000"),
]
UNIT = Decimal("1e-10")  # one cost unit in USD


def _units(expr: str) -> int:
    num, den = expr.split("/")
    return int(Decimal(num) / Decimal(den) / UNIT)


def price_table(spark: SparkSession) -> DataFrame:
    """(model, in_units, out_units): price per token in 1e-10 USD."""
    rows = [(m, _units(i), _units(o)) for m, i, o in PRICES_USD]
    return spark.createDataFrame(rows, "model string, in_units long, out_units long")


#: The provider whose models have a price per token; calls of others cost nothing.
PRICED_PROVIDER = "openai"


def usage_cost(usage: DataFrame) -> DataFrame:
    """J10 + R16: cost per call.

    A call of another provider (column ``provider``, if there is one) costs 0
    and has status ``free``; an unknown model of the priced provider gets
    status ``unpriced`` and no cost.
    """
    prices = F.broadcast(price_table(usage.sparkSession))  # 11 rows by construction
    j = usage.join(prices, "model", "left")
    units = F.col("prompt_tokens") * F.col("in_units") + F.col("completion_tokens") * F.col("out_units")
    free = F.col("provider") != F.lit(PRICED_PROVIDER) if "provider" in usage.columns else F.lit(False)
    return (j.withColumn("cost_units", F.when(free, F.lit(0).cast("long")).otherwise(units))
             .withColumn("cost", F.col("cost_units").cast("double") * F.lit(float(UNIT)))
             .withColumn("status", F.when(free, F.lit("free")).when(F.col("in_units").isNull(), F.lit("unpriced")).otherwise(F.lit("ok")))
             .drop("in_units", "out_units"))


def cost_totals(priced: DataFrame, run: str) -> DataFrame:
    """Total, mean per call, count and projected total per run (unpriced calls count as 0)."""
    units = F.coalesce(F.col("cost_units"), F.lit(0))
    g = priced.groupBy(run).agg(F.sum(units).alias("_u"), F.count(F.lit(1)).alias("n_calls"))
    total = F.col("_u").cast("double") * F.lit(float(UNIT))
    return g.select(run, total.alias("total_cost"), (total / F.col("n_calls")).alias("mean_cost"),
                    "n_calls", (total / F.col("n_calls") * F.col("n_calls")).alias("projected_cost"))


def running_cost(priced: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Running cost, running mean (divided by the position, failed calls included) and projection.

    A run can be a very large group, so no window partitioned by the run:
    one range-partitioned pass with a carry between partitions gives the sum
    and the position. Only the number of calls of a run is joined in, an
    aggregate of one row per run.
    """
    x = priced.withColumn("_u", F.coalesce(F.col("cost_units"), F.lit(0)).cast("long"))
    ranked = in_group(x, run, order, position="_pos_in_run", sums={"_cum": "_u"})
    j = ranked.join(priced.groupBy(run).agg(F.count(F.lit(1)).alias("_n")), run)
    running = F.col("_cum").cast("double") * F.lit(float(UNIT))
    pos = F.col("_pos_in_run")
    return (j.withColumn("running_cost", running)
             .withColumn("position", pos)
             .withColumn("running_mean", running / pos)
             .withColumn("projected_cost", running / pos * F.col("_n"))
             .drop("_u", "_cum", "_pos_in_run", "_n"))
