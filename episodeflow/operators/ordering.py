"""Sort, limit, sampling, shuffling and mixing of data sets.

Seeded "random" order is md5('<seed>:<key>') so that it is reproducible on
any cluster and in any engine. Taking the first rows of such an order needs
no sort: ``radix.first_rows`` finds the threshold key from counts, and the
rows are filtered by it. Only an explicit position (O2) sorts, with the
distributed ``global_rank``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeflow.plans.radix import FEW_GROUPS, first_rows, hex_digits
from episodeflow.plans.rank import global_rank, in_group


def seeded_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def natural_sort_limit(files: DataFrame, name: str, n: int) -> tuple[DataFrame, DataFrame]:
    """O1 (+X15): first ``n`` files by integer stem; non-numeric stems go to a reject table."""
    stem = F.regexp_extract(F.col(name), "^(\\d+)\\.", 1).try_cast("long")
    keyed = files.withColumn("_stem", stem)
    good = keyed.where(F.col("_stem").isNotNull()).orderBy("_stem", name).limit(int(n)).drop("_stem")
    rejects = keyed.where(F.col("_stem").isNull()).drop("_stem").withColumn("reject_reason", F.lit("non-numeric stem"))
    return good, rejects


def seeded_shuffle(rows: DataFrame, key: str, seed: int = 42, position: str | None = "pos") -> DataFrame:
    """O2: a ``shuffle_key`` column (and, optionally, the exact position in that order)."""
    out = rows.withColumn("shuffle_key", seeded_key(F.col(key), seed))
    if position:
        out = global_rank(out, ["shuffle_key", key], position)
    return out


def reshuffled(rows: DataFrame, keys: Sequence[str], seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """The seeded order of a merged set, a key over its columns ``keys``; a writer sorts by it, files by files."""
    return rows.withColumn(out, seeded_key(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), seed))


def first_seeded(rows: DataFrame, n: int, key: str, seed: int, group: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows (of each group) of the seeded order, found by counts (``plans.radix``)."""
    keyed = rows.withColumn("_h", seeded_key(F.col(key), seed))
    return first_rows(keyed, n, ["_h", key], hex_digits(F.col("_h")), group, "_in").where("_in").select(*rows.columns)


def prior_mix(cur: DataFrame, prior: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """O3 (+O5): at most ``len(cur)`` shuffled prior rows appended to the current rows. ``reshuffled`` orders the whole."""
    taken = first_seeded(prior, cur.count(), key, seed)
    return cur.withColumn("origin", F.lit("current")).unionByName(taken.withColumn("origin", F.lit("prior")))


def rank_in_group(rows: DataFrame, group: str | Sequence[str], order: Sequence[str],
                  out: str = "rank_in_group") -> DataFrame:
    """Exact 1-based rank inside each group without a window or a join on the group."""
    return in_group(rows, group, list(order), position=out)


def balanced_mix(rows: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """From every group take min-group-size rows after a seeded shuffle. ``reshuffled`` orders the whole."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    n, groups = sizes.agg(F.coalesce(F.min("_n"), F.lit(0)), F.count(F.lit(1))).first()
    if groups <= FEW_GROUPS:
        return first_seeded(rows, n, key, seed, [group])
    # More groups than thresholds are kept for on the driver: ranks in a range-partitioned order.
    ranked = rank_in_group(rows.withColumn("_h", seeded_key(F.col(key), seed)), group, ["_h", key], "_r")
    return ranked.where(F.col("_r") <= n).drop("_h", "_r")


def training_mix(rows: DataFrame, splits: Sequence[str], folder: str, key: str, split: str = "split", seed: int = 42) -> DataFrame:
    """O4 whole: the data sets of several folders, balanced and shuffled for each split by itself (train and eval apart)."""
    parts = [balanced_mix(rows.where(F.col(split) == s), folder, key, seed) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reshuffled(out, [split, folder, key], seed)


def candidate_cap(cands: Column, keep_first: int = 6, sample: int = 10, limit: int = 20,
                  seed: int = 42) -> Column:
    """More than ``limit`` candidates -> first ``keep_first`` plus ``sample`` seeded picks of the rest.

    Single deterministic pass (the reference re-applies it while listing).
    """
    rest = F.slice(cands, keep_first + 1, F.greatest(F.size(cands) - keep_first, F.lit(0)))
    by_hash = F.array_sort(F.transform(rest, lambda x: F.struct(seeded_key(x, seed).alias("h"), x.alias("v"))))
    picked = F.slice(F.transform(by_hash, lambda s: s["v"]), 1, sample)
    return F.when(F.size(cands) > limit, F.concat(F.slice(cands, 1, keep_first), picked)).otherwise(cands)


def random_goal(goals: DataFrame, key: str, k: int = 1, seed: int = 42) -> DataFrame:
    """``k`` seeded goals (TakeOrderedAndProject, no full sort)."""
    return goals.orderBy(seeded_key(F.col(key), seed), F.col(key)).limit(int(k))


def split_sizes(rows: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
