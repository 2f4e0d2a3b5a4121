"""Connected components by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeflow.llm.common import land, parts


#: Links that one file of a landed round holds, about.
EACH = 100_000


def _seal(edges: DataFrame, most: int) -> tuple[DataFrame, tuple]:
    """Land the distinct links (about ``most``); their number and a checksum tell whether a round changed them."""
    out = land(edges.distinct(), "links", parts(most, EACH))
    return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """``id, component``: the smallest id reachable from each linked id (itself included).

    ``most`` is about how many links there are, counted if not given.

    A round joins each id with the minimum of its neighbours, a grouped aggregate with partial
    sums, so the links of a hot id never meet in one task. Rounds end when nothing changes.
    """
    edges, state = _seal(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), links.count() if most is None else most)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, new = _seal(small.unionByName(low.select("u", F.col("m").alias("v"))), state[0])
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
