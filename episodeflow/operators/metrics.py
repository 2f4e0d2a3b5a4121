"""Evaluation aggregates and reports.

All aggregates are hash aggregates with a partial (map-side) step; pivots
use an explicit value list so no extra job is needed to find the values.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(c: Column) -> Column:
    """NaN counts as missing (pandas mean skips it; Spark avg would return NaN)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def category_means(sm: DataFrame, category: str, cols: Iterable[str]) -> DataFrame:
    """A2: mean of each column per category; null category dropped."""
    return (sm.where(F.col(category).isNotNull()).groupBy(category)
              .agg(*[F.avg(_clean(F.col(c))).alias(f"mean_{c}") for c in cols]))


def means_with_overall(sm: DataFrame, category: str, cols: Iterable[str],
                       overall: str = "overall") -> DataFrame:
    """A3: per-category means plus an ``overall`` row over all rows (also null categories).

    One aggregate with GROUPING SETS ((category), ()); the null-category
    group is dropped after grouping so the overall row still counts it.
    """
    cols = list(cols)
    g = sm.groupingSets([[F.col(category)], []], F.col(category)).agg(
        F.grouping_id().alias("_gid"), *[F.avg(_clean(F.col(c))).alias(f"mean_{c}") for c in cols])
    return (g.where((F.col("_gid") == 1) | F.col(category).isNotNull())
             .select(F.when(F.col("_gid") == 1, F.lit(overall)).otherwise(F.col(category)).alias(category),
                     *[f"mean_{c}" for c in cols]))


#: Models that one report may compare (columns of a pivot).
MAX_MODELS = 500


def models_of(sm: DataFrame, model: str) -> list[str]:
    """The models that occur, in order; more than ``MAX_MODELS`` are an error (they become columns)."""
    found = [r[0] for r in sm.select(model).where(F.col(model).isNotNull()).distinct().orderBy(model).limit(MAX_MODELS + 1).collect()]
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} values of {model}")
    return found


def model_pivot(sm: DataFrame, key: str, model: str, models: Sequence[str] | None = None,
                values: Sequence[str] = ("score", "num_actions")) -> DataFrame:
    """One row per key with ``<value>_<model>`` columns (full-outer semantics).

    Without ``models`` every model that occurs gets its columns. A duplicate
    (key, model) and a row of a model outside a given list fail the job. The
    guards are part of the same aggregation (counts and ``raise_error``), so
    they cost no extra pass over the data.
    """
    models = models_of(sm, model) if models is None else list(models)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, m in enumerate(models):
        mine = F.col(model) == m
        aggs.append(F.count(F.when(mine, 1)).alias(f"_n{i}"))
        aggs += [F.max(F.when(mine, F.col(v))).alias(f"{v}_{m}") for v in values]
    p = sm.groupBy(key).agg(*aggs)
    counts = [F.col(f"_n{i}") for i in range(len(models))]
    listed = sum(counts, F.lit(0))
    name = F.col(key).cast("string")
    fault = (F.when(F.greatest(F.lit(0), F.lit(0), *counts) > 1, F.concat(F.lit(f"duplicate ({key}, {model}) for {key}="), name))
              .when(F.col("_rows") != listed, F.concat(F.lit(f"a {model} outside the list for {key}="), name)))
    p = p.where(F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(True)))
    return p.select(key, *[F.col(f"`{v}_{m}`") for m in models for v in values])


def outer_merge(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """J5 direct form: N-way full outer join on ``key`` (columns must not clash)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "full")
    return out


def failure_fix(sm: DataFrame, cap: int = 20, reported: int = 30) -> DataFrame:
    """A failed episode that used the whole action cap is reported with ``reported`` steps."""
    n = F.col("num_actions")
    fixed = F.when((F.col("score") == 0) & (n == cap), F.lit(reported)).otherwise(n)
    return sm.withColumn("num_actions", fixed.cast(sm.schema["num_actions"].dataType))


def dup_models(sm: DataFrame, model: str = "model_id", run: str = "run") -> DataFrame:
    """Models that occur in more than one run."""
    return (sm.groupBy(model).agg(F.count_distinct(run).alias("n_runs"))
              .where(F.col("n_runs") > 1))


def attribute_outcomes(goals: DataFrame, bought: str = "purchased_attrs") -> DataFrame:
    """Per goal attribute, how often it was (not) among the purchased item's attributes."""
    e = goals.select(F.explode("attributes").alias("attribute"), bought)
    hit = F.coalesce(F.array_contains(F.col(bought), F.col("attribute")), F.lit(False)).cast("long")
    return e.groupBy("attribute").agg(F.sum(hit).alias("n_ok"), F.sum(1 - hit).alias("n_fail"))


def click_rank(visible: Column, item: Column) -> Column:
    """A10: 1-based position of the clicked item in the visible list, -1 if absent."""
    return F.coalesce(F.nullif(F.array_position(visible, item), F.lit(0)), F.lit(-1)).cast("long")


def episode_metrics(reward: Column, steps: Column, bought_goal: Column) -> dict[str, Column]:
    """Harsh (reward == 1), exact (harsh and the goal item bought), norm (reward / steps)."""
    harsh = reward == F.lit(1.0)
    return {"harsh": harsh, "exact": harsh & bought_goal,
            "norm": F.try_divide(reward, steps.cast("double"))}


def match_score(attrs: Column, opts: Column, texts: Sequence[Column], cands: Column) -> dict[str, Column]:
    """attribute/option match estimate.

    ``texts`` are the description, the features and the page; an attribute
    counts if any of them holds it in lower case.
    """
    lowered = F.array(*[F.lower(F.coalesce(t, F.lit(""))) for t in texts])

    def held(ts: Column) -> Column:
        return F.size(F.filter(attrs, lambda a: F.exists(ts, lambda t: F.contains(t, a))))

    # The lowered texts are bound as one element, so they are lowered once a row and not once an attribute.
    n_att = F.element_at(F.transform(F.array(lowered), held), 1)
    n_opt = F.size(F.filter(opts, lambda o: F.exists(cands, lambda c: F.contains(c, o))))
    la, lo = F.size(attrs), F.size(opts)
    return {
        "r_att": F.try_divide(n_att.cast("double"), la.cast("double")),
        "r_opt": F.try_divide(n_opt.cast("double"), lo.cast("double")),
        "r": (n_att + n_opt + 1).cast("double") / (la + lo + 1).cast("double"),
    }


MEANS = ("r_att", "r_option", "r_type", "r_price", "score", "num_actions")


def model_means(sm: DataFrame, model: str = "model_id") -> DataFrame:
    """A5: means of the six metrics per model: shares times 100, score times 10, rounded to one decimal.

    NaN and null are left out of a mean.
    """
    g = sm.groupBy(model).agg(*[F.avg(_clean(F.col(c))).alias(c) for c in MEANS], F.count(F.lit(1)).alias("n"))
    scale = {"score": 10, "num_actions": 1}
    return g.select(model, *[round1(F.col(c) * scale.get(c, 100)).alias(c) for c in MEANS], "n")


def detail_enrich(sm: DataFrame, detail: DataFrame, keys: Sequence[str] = ("run_dir", "model_id", "env_idx"),
                  values: Sequence[str] = ("r_type", "r_att", "r_price", "r_option")) -> DataFrame:
    """Summary rows with their detail scores; a missing file or key counts 0."""
    got = detail.select(*keys, *values)
    return sm.join(got, list(keys), "left").na.fill(0, list(values))


def success_rate(score: Column) -> Column:
    """Share of scores equal to 1.0."""
    return F.avg((score == F.lit(1.0)).cast("double"))


def category_map(key: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """First prefix (in list order) that the key starts with -> its category, else null."""
    out = F.lit(None).cast("string")
    for prefix, cat in reversed(list(prefixes)):
        out = F.when(key.startswith(prefix), F.lit(cat)).otherwise(out)
    return out


# Game-family task prefixes and their categories, in match order.
GAME_PREFIXES = [
    ("pick_and_place", "pick"),
    ("pick_clean_then_place", "clean"),
    ("pick_heat_then_place", "heat"),
    ("pick_cool_then_place", "cool"),
    ("look_at_obj", "look"),
    ("pick_two_obj", "picktwo"),
]
# Row order of the game report.
GAME_REPORT_ORDER = ["pick", "clean", "heat", "cool", "look", "picktwo", "overall"]


def ordered_report(report: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows in a fixed order, missing rows shown as nulls (left join from a literal table)."""
    spark = report.sparkSession
    lit_order = spark.createDataFrame([(i, k) for i, k in enumerate(order)], f"pos int, {key} string")
    return lit_order.join(report, key, "left").orderBy("pos")


def one_decimal_text(x: Column) -> Column:
    """Python ``f"{x:.1f}"``."""
    return F.call_function("format_number", x, F.lit("0.0"))


def round1(x: Column) -> Column:
    """NumPy/pandas ``round(1)`` (half to even)."""
    return F.bround(x, 1)
