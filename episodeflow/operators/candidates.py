"""Candidate lists and demo unpacking (P13, P14, J9 map use).

Arrays here are per step or per episode and bounded by the page / episode;
every transformation is a native higher-order function (``transform``,
``filter``), so it stays inside codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_build(clickables: Column, titles: Column, on_search_page: Column) -> Column:
    """The search action alone on a search page; otherwise ``click[...]`` per clickable without
    the search button, items shown as ``item - <title>``; ``finish`` if nothing is left.

    ``titles`` is an array aligned with ``clickables`` holding an item's title
    or null (built with a join to the title dictionary).
    """
    pairs = F.arrays_zip(clickables.alias("c"), titles.alias("t"))
    kept = F.filter(pairs, lambda p: p["c"] != F.lit("search"))
    clicks = F.transform(kept, lambda p: F.concat(
        F.lit("click["), F.when(p["t"].isNotNull(), F.concat(F.lit("item - "), p["t"])).otherwise(p["c"]), F.lit("]")))
    return (F.when(on_search_page, F.array(F.lit("search[<search query>]")))
             .when(F.size(clicks) == 0, F.array(F.lit("finish"))).otherwise(clicks))


def zip_demo(demos: DataFrame, key: str | Sequence[str] = "episode_id",
             placeholder: str = "search[search query]") -> tuple[DataFrame, DataFrame]:
    """Parallel arrays (states, available_actions, actions, action_idxs) -> steps + rejects.

    The step count is that of ``states``. An empty candidate list becomes one
    placeholder entry; a negative index takes the free-text action; an index
    outside the list is a reject (``get`` returns null instead of raising).
    """
    keys = [key] if isinstance(key, str) else list(key)
    ex = demos.select(*keys, "available_actions", "actions", "action_idxs",
                      F.posexplode("states").alias("step", "observation"))
    cands = F.get(F.col("available_actions"), F.col("step"))
    cands = F.when(F.coalesce(F.size(cands), F.lit(0)) <= 0, F.array(F.lit(placeholder))).otherwise(cands)
    idx = F.get(F.col("action_idxs"), F.col("step"))
    action = F.when(idx < 0, F.get(F.col("actions"), F.col("step"))).otherwise(F.get(cands, idx))
    steps = ex.select(*keys, F.col("step").cast("int").alias("step"), "observation",
                      cands.alias("candidate_actions"), action.alias("action"), idx.alias("action_idx"))
    ok = steps.where(F.col("action").isNotNull()).drop("action_idx")
    rejects = steps.where(F.col("action").isNull()).withColumn("reject_reason", F.lit("action index out of range"))
    return ok, rejects
