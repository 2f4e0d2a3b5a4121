"""Episode/step selection (F*) and step windows (W*).

Canonical shape is *long*: ``steps(episode_id, step, ...)``. Every window
here is partitioned by the episode key, so a job with several windows
shuffles once; episode-level results are aggregates that combine map-side.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeflow.plans.radix import INTEGRAL, first_rows, hex_digits, long_digits
from episodeflow.plans.rank import global_rank, in_group


def _ep_window(key: str = "episode_id", order: Iterable[str] = ("step",)) -> Window:
    return Window.partitionBy(key).orderBy(*order)


# --- episode-level derived columns ------------------------------------------

def episodes(steps: DataFrame, key: str = "episode_id", started: DataFrame | None = None) -> DataFrame:
    """A1 shape: n_steps and last_score per episode (partial + final aggregate).

    With ``started`` (the episodes there are), one without steps has 0 steps and score 0.
    """
    found = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("score", "step").alias("last_score"),
    )
    return found if started is None else with_empty(started, found, key)


def with_empty(started: DataFrame, found: DataFrame, key: str = "episode_id") -> DataFrame:
    """A1 for episodes without steps: 0 steps and score 0."""
    return (started.select(key).distinct().join(found, key, "left")
            .select(key, F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
                    F.when(F.col("n_steps").isNull(), 0.0).otherwise(F.col("last_score")).alias("last_score")))


# --- F1..F14 ------------------------------------------------------------------

def score_filter(eps: DataFrame, threshold: float | None) -> DataFrame:
    """F1: keep episodes whose last step score >= threshold; off when None."""
    if threshold is None:
        return eps
    return eps.where(F.col("last_score") >= F.lit(float(threshold)))


def length_filter(eps: DataFrame, max_len: int | None) -> DataFrame:
    """keep episodes with at most ``max_len`` steps; off when None."""
    if max_len is None:
        return eps
    return eps.where(F.col("n_steps") <= F.lit(int(max_len)))


def skip_missing(eps: DataFrame, col: str = "trajectory") -> tuple[DataFrame, DataFrame]:
    """episodes without a trajectory go to a reject table."""
    ok = eps.where(F.col(col).isNotNull())
    rejects = eps.where(F.col(col).isNull()).withColumn("reject_reason", F.lit("no trajectory"))
    return ok, rejects


def uncorrected_skip(steps: DataFrame, flag: str = "is_corrected") -> DataFrame:
    """drop steps whose flag is present and false (null/absent keeps the step).

    Apply after ``step_history`` so skipped steps still appear in later histories.
    """
    return steps.where(~F.col(flag).eqNullSafe(F.lit(False)))


def failed_select(summ: DataFrame, threshold: float = 0.0) -> DataFrame:
    """failed episodes have score <= threshold."""
    return summ.where(F.col("score") <= F.lit(float(threshold)))


def start_index(rows: DataFrame, start: int | None, key: str = "env_idx",
                inclusive: bool = True) -> DataFrame:
    """resume position; inclusive (evaluation) or strict (self-correction). 0/None = off."""
    return rows.where(after_start(F.col(key), start, inclusive)) if start else rows


def after_start(c: Column, start: int, inclusive: bool = True) -> Column:
    return c >= start if inclusive else c > start


def id_subset(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """explicit id subset as a semi join (AQE turns it into a broadcast when the id side is small)."""
    return rows.join(ids, key, "left_semi")


def goal_ranges(goals: DataFrame, idx: str = "idx", capped: bool = False) -> DataFrame:
    """F8: test 0-499, eval 500-1499, train 1500+; with a product cap every goal is in every split."""
    if capped:
        return goals.withColumn("split", F.lit("all"))
    c = F.col(idx)
    return goals.withColumn(
        "split", F.when(c < 500, "test").when(c < 1500, "eval").otherwise("train"))


def field_remap(steps: DataFrame, mapping: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """config-driven rename ``target <- source``."""
    return steps.select(*keep, *[F.col(src).alias(dst) for dst, src in mapping.items()])


def optional_default(c: Column, default: str = "") -> Column:
    """optional field default, applied at render time."""
    return F.coalesce(c, F.lit(default))


def teacher_payload(steps: DataFrame) -> DataFrame:
    """the per-step fields the teacher sees, in this order."""
    return steps.select(
        "episode_id", "step",
        F.struct(F.col("step").alias("timestep"), "observation", "candidate_actions",
                 "reason", "action").alias("payload"))


def step_cap(steps: DataFrame, k: int) -> DataFrame:
    """keep the first ``k`` steps of every episode."""
    return steps.where(F.col("step") < F.lit(int(k)))


def first_steps(rows: DataFrame, k: int, order: Iterable[str], key: str = "episode_id", out: str = "step") -> DataFrame:
    """F12 over rows that are not numbered yet: the first ``k`` steps of every episode, numbered from 0.

    A row-number filter: every task keeps at most ``k`` rows of an episode
    before the shuffle, so a long episode is neither moved nor sorted whole.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(_ep_window(key, order))).where(F.col("_rn") <= F.lit(int(k)))
    return ranked.withColumn(out, (F.col("_rn") - 1).cast("int")).drop("_rn")


def episode_cap(eps: DataFrame, n: int | None, key: str = "episode_id") -> DataFrame:
    """first ``n`` episodes by index (TakeOrderedAndProject); None/0 = all."""
    if not n:
        return eps
    return eps.orderBy(key).limit(int(n))


def conditional_ban(cands: Column, selected: Column, total: Column,
                    banned: str = "click[buy now]") -> Column:
    """drop the buy action until every option has been chosen."""
    return F.filter(cands, lambda x: (x != F.lit(banned)) | (selected == total))


# --- W1..W8 ---------------------------------------------------------------

def step_history(steps: DataFrame, obs: str = "observation", act: str = "action",
                 key: str = "episode_id", max_len: int | None = None,
                 out: str = "history") -> DataFrame:
    """Earlier (observation, action) pairs of the episode, oldest first, without the current one.

    ``max_len`` bounds the frame to the last K steps for very long episodes.
    """
    lo = Window.unboundedPreceding if max_len is None else -int(max_len)
    w = _ep_window(key).rowsBetween(lo, -1)
    pair = F.struct(F.col(obs).alias("observation"), F.col(act).alias("action"))
    return steps.withColumn(out, F.collect_list(pair).over(w))


def step_history_text(steps: DataFrame, obs: str = "observation", act: str = "action",
                      key: str = "episode_id", max_len: int | None = None,
                      out: str = "history_text", count_out: str | None = "n_history") -> DataFrame:
    """W1 rendered: the Python text form of the history list, built from per-step items.

    Each step's ``{'observation': ..., 'action': ...}`` text is rendered once
    and the window collects those strings, so escaping work is linear in the
    episode length (only the concatenation is inherently quadratic).
    """
    from episodeflow.functions.pytext import py_dict_of

    lo = Window.unboundedPreceding if max_len is None else -int(max_len)
    w = _ep_window(key).rowsBetween(lo, -1)
    item = py_dict_of([("observation", obs), ("action", act)])
    out_df = steps.withColumn(
        out, F.concat(F.lit("["), F.array_join(F.collect_list(item).over(w), ", "), F.lit("]")))
    if count_out:
        out_df = out_df.withColumn(count_out, F.count(F.lit(1)).over(w))
    return out_df


#: Steps of one episode that share a row while their histories are built.
CHUNK = 256


def shared_history(steps: DataFrame, obs: str = "observation", act: str = "action", key: str = "episode_id",
                   out: str = "history_text", count_out: str | None = "n_history", chunk: int = CHUNK) -> DataFrame:
    """W1 rendered, for episodes of any length: the text of ``step_history_text`` from shared prefixes.

    Steps are numbered from 0. ``chunk`` of them are one row with their rendered
    items, so grouping, state and shuffle are linear in the steps. An episode of
    more chunks is joined to one text as well; each chunk gets the part of it that
    lies before, and a step's history is that prefix and the chunk's items before
    the step. Chunks are dealt by (episode, chunk), so a long episode is written
    by many tasks; only the output is quadratic, as histories are. Rows of a null
    episode are one episode; further columns pass unchanged.
    """
    from episodeflow.functions.pytext import py_dict_of

    rows = steps.withColumn("_item", py_dict_of([("observation", obs), ("action", act)])).withColumn("_chunk", F.expr(f"step div {int(chunk)}"))
    rest = [c for c in steps.columns if c != key]
    by_step = lambda a, b: F.when(a["_s"] < b["_s"], -1).when(a["_s"] > b["_s"], 1).otherwise(0)
    packed = (rows.groupBy(key, "_chunk").agg(F.collect_list(F.struct(F.col("step").alias("_s"), "_item", F.struct(*rest).alias("_row"))).alias("_l"))
              .select(key, "_chunk", F.array_sort("_l", by_step).alias("_l")))
    parts = packed.select(key, "_chunk", F.size("_l").alias("_n"), F.array_join(F.transform("_l", lambda x: x["_item"]), ", ").alias("_text"))
    same = lambda a, b: F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    several = packed.where("_chunk > 0").select(key).distinct()
    whole = (parts.alias("p").join(several.alias("s"), same("p", "s"), "left_semi").groupBy(key)
             .agg(F.array_sort(F.collect_list(F.struct("_chunk", "_n", "_text"))).alias("_parts")))
    before = whole.select(key, "_parts", F.posexplode_outer(F.transform("_parts", lambda x: x["_chunk"])).alias("_p", "_chunk")).select(
        key, "_chunk", F.aggregate(F.slice("_parts", 1, F.col("_p")), F.lit(0), lambda acc, x: acc + x["_n"]).alias("_before"),
        F.array_join(F.transform(F.slice("_parts", 1, F.col("_p")), lambda x: x["_text"]), ", ").alias("_prefix"))
    heads = packed.where("_chunk <= 0").select(key, "_l", F.lit(0).alias("_before"), F.lit("").alias("_prefix"))
    later = (packed.where("_chunk > 0").alias("l").join(before.alias("r"), same("l", "r") & (F.col("l._chunk") == F.col("r._chunk")))
             .select(F.col(f"l.{key}").alias(key), "l._l", "r._before", "r._prefix", "l._chunk"))
    # A stated number of partitions: sizes before the histories are written say nothing about the work.
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = heads.unionByName(later.repartition(n, key, "_chunk").drop("_chunk")).withColumn("_items", F.transform("_l", lambda x: x["_item"]))
    each = joined.select(key, "_before", "_prefix", "_items", F.posexplode_outer("_l").alias("_i", "_x"))
    own = F.array_join(F.slice("_items", 1, F.col("_i")), ", ")
    text = F.concat(F.lit("["), "_prefix", F.when((F.col("_before") > 0) & (F.col("_i") > 0), ", ").otherwise(""), own, F.lit("]"))
    cols = [F.col(key) if c == key else F.col(f"_x._row.{c}").alias(c) for c in steps.columns]
    if count_out:
        return each.select(*cols, text.alias(out), (F.col("_before") + F.col("_i")).cast("long").alias(count_out))
    return each.select(*cols, text.alias(out))


def step_number(rows: DataFrame, key: str | list[str], order: Iterable[str], out: str = "step",
                skew_safe: bool = True) -> DataFrame:
    """0-based step number within the episode.

    ``skew_safe`` numbers steps with a distributed rank over (key, order)
    rebased per episode, so an episode holding a large share of all rows is
    range-split over many tasks; otherwise a window per episode is used.
    """
    if not skew_safe:
        keys = [key] if isinstance(key, str) else key
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    from episodeflow.operators.ordering import rank_in_group
    return (rank_in_group(rows, key, list(order), "_rig")
            .withColumn(out, (F.col("_rig") - 1).cast("int")).drop("_rig"))


def episode_split(eps: DataFrame, key: str = "episode_id", frac: float = 0.85,
                  seed: int = 42) -> DataFrame:
    """Seeded episode-level shuffle, first floor(n*frac) are train.

    The order is md5('seed:id'); its threshold is found from counts
    (``radix.first_rows``), so the rows are only compared with it.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    cut = F.floor(F.col("_total") * F.lit(float(frac)))
    return _labelled(first_rows(eps.withColumn("_h", h), cut, ["_h", key], hex_digits(F.col("_h"))).drop("_h"))


def prefix_split(items: DataFrame, idx: str, frac: float = 0.7) -> DataFrame:
    """First floor(n*frac) indices (unshuffled) are train.

    Whole-number indices are cut by their digits; other types need the
    distributed rank.
    """
    if isinstance(items.schema[idx].dataType, INTEGRAL):
        return _labelled(first_rows(items, F.floor(F.col("_total") * F.lit(float(frac))), [idx], long_digits(F.col(idx))))
    ranked = global_rank(items, [idx], "_rank", total_col="_n")
    return _labelled(ranked.withColumn("_first", F.col("_rank") <= F.floor(F.col("_n") * F.lit(float(frac)))).drop("_n", "_rank"))


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def first_valid_attempt(att: DataFrame, retries: int,
                        key: Iterable[str] = ("request_id",)) -> DataFrame:
    """The earliest valid attempt within the retry budget, per request.

    A grouped ``min_by`` (partial aggregation map-side), not a window: a
    request with many attempts never has to sit in one sorted buffer.
    Requests without a valid attempt in budget are absent (failed).
    """
    keys = [key] if isinstance(key, str) else list(key)
    ok = att.where(F.col("valid") & (F.col("attempt") <= F.lit(int(retries))))
    others = [c for c in att.columns if c not in (*keys, "attempt", "valid")]
    # Attempt numbers are unique per request, so per-column min_by picks one row; with
    # fixed-width columns this stays a hash aggregate.
    return ok.groupBy(*keys).agg(F.min("attempt").alias("attempt"),
                                 *[F.min_by(c, "attempt").alias(c) for c in others])


def _numbered(rows: DataFrame, number: str | None) -> DataFrame:
    return rows.withColumn(number, (F.col(number) - 1).cast("int")) if number else rows


def prev_observation(steps: DataFrame, obs: str = "observation", key: str = "episode_id",
                     out: str = "prev_observation", skew_safe: bool = True, order: Iterable[str] = ("step",),
                     number: str | None = None) -> DataFrame:
    """Previous observation within the episode (null at start).

    ``skew_safe``: one range-partitioned pass with a carry between partitions
    (``rank.in_group``) instead of ``lag`` over a window that holds the whole
    episode in one task. It can also number the steps (``number``), so rows
    that are not numbered yet are sorted once.
    """
    if not skew_safe:
        return steps.withColumn(out, F.lag(obs, 1).over(_ep_window(key, order)))
    return _numbered(in_group(steps, key, list(order), position=number, lags={out: obs}), number)


def episode_truncate(steps: DataFrame, done: Column, limit: int = 100,
                     key: str = "episode_id", skew_safe: bool = True, order: Iterable[str] = ("step",),
                     number: str | None = None) -> DataFrame:
    """Keep steps up to the first ``done`` step and below the step limit.

    ``skew_safe``: one range-partitioned pass that carries "was done before"
    between partitions; ``number`` numbers the steps in the same pass.
    """
    if skew_safe:
        flagged = in_group(steps.withColumn("_done", F.coalesce(done, F.lit(False))), key, list(order), position=number,
                           flags={"_ended": "_done"})
        rows = _numbered(flagged, number)
        return rows.where(~F.col("_ended") & (F.col(number or "step") < F.lit(int(limit)))).drop("_done", "_ended")
    before = _ep_window(key, order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = steps.withColumn("_done_before", F.coalesce(F.max(done.cast("int")).over(before), F.lit(0)))
    return (flagged.where((F.col("_done_before") == 0) & (F.col("step") < F.lit(int(limit))))
                   .drop("_done_before"))
