"""Joins and guards of the correction / annotation jobs."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingKeysError(ValueError):
    """Raised by a strict lookup when ids have no match."""


def state_lookup(eps: DataFrame, state: DataFrame, id_col: str, strict: bool = False,
                 sample: int = 20) -> DataFrame:
    """Episode -> privileged state on the stringified id.

    The state table grows with the data, so no broadcast hint: AQE turns
    the join into a broadcast at run time only when the measured side is
    small. ``strict`` reproduces the abort on a missing id, naming a few
    of them (an anti join; only ``sample`` ids reach the driver).
    """
    keyed = eps.withColumn("_sid", F.col(id_col).cast("string"))
    if strict:
        missing = keyed.join(state, keyed["_sid"] == state["id"], "left_anti")
        ids = [r[0] for r in missing.select("_sid").limit(sample).collect()]
        if ids:
            raise MissingKeysError(f"no state for ids {ids}")
    out = keyed.join(state, keyed["_sid"] == state["id"], "left")
    return out.drop("_sid", "id")


def query_expand(goals: DataFrame, expansions: DataFrame) -> DataFrame:
    """Search texts of each goal: its expansions, then the lower-cased instruction.

    ``expansions`` has ``k`` (cleaned instruction, perhaps with dots around
    it) and ``texts``; the lookup key is the instruction before its price.
    """
    cleaned = F.substring_index("instruction", ", and price lower than", 1)
    keyed = expansions.select(F.btrim("k", F.lit(".")).alias("_k"), "texts")
    found = F.coalesce("texts", F.array().cast("array<string>"))
    return (goals.join(keyed, cleaned == F.col("_k"), "left")
                 .withColumn("texts", F.concat(found, F.array(F.lower("instruction")))).drop("_k"))


def reason_merge(steps: DataFrame, answers: DataFrame, key: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """Put generated reasons onto steps by position when both lists have equal length.

    Returns (annotated steps, one reject row per episode without an answer or
    with one of another length).
    """
    n_steps = steps.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n_ans = answers.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    why = F.when(F.col("_m").isNull(), F.lit("no answer")).when(F.col("_n") != F.col("_m"), F.lit("length mismatch"))
    judged = n_steps.join(n_ans, key, "left").select(key, why.alias("reject_reason"))
    ok = judged.where(F.col("reject_reason").isNull()).select(key)
    base = steps.drop("reason") if "reason" in steps.columns else steps
    good = (base.join(ok, key, "left_semi")
                .join(answers.select(key, "step", "reason"), [key, "step"]))
    return good, judged.where(F.col("reject_reason").isNotNull())


def validate_answers(answers: DataFrame, steps: DataFrame, key: str = "episode_id",
                     required: Iterable[str] = ("corrected_reason", "corrected_action")
                     ) -> tuple[DataFrame, DataFrame]:
    """Episode guards. Length must equal the rollout's; required keys present on every step.

    Returns (answers of good episodes, one reject row per bad episode; an
    episode without any answer counts as a length mismatch).
    Key presence is carried as ``has_<key>`` boolean columns.
    """
    req = list(required)
    agg_ans = answers.groupBy(key).agg(
        F.count(F.lit(1)).alias("_m"),
        *[F.min(F.col(f"has_{k}").cast("int")).alias(f"_all_{k}") for k in req])
    agg_st = steps.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    j = agg_st.join(agg_ans, key, "left")
    reason = F.when(F.col("_n") != F.coalesce("_m", F.lit(0)), F.lit("length mismatch"))
    for k in req:
        reason = reason.when(F.col(f"_all_{k}") == 0, F.lit(f"missing {k}"))
    judged = j.select(key, reason.alias("reject_reason"))
    good = judged.where(F.col("reject_reason").isNull()).select(key)
    rejects = judged.where(F.col("reject_reason").isNotNull())
    return answers.join(good, key, "left_semi"), rejects


def _take(ans_has: str, ans_val: str, orig: str) -> Column:
    """Backfill only where the answer lacks the key; a present null stays null."""
    return F.when(F.col(ans_has), F.col(ans_val)).otherwise(F.col(orig))


def correction_merge(steps: DataFrame, answers: DataFrame, key: str = "episode_id", carried: Iterable[str] = ()) -> DataFrame:
    """J3 (+R13): merge validated answers with the rollout steps.

    ``answers`` has (key, step, corrected_reason, corrected_action,
    has_original_* / original_*, has_candidate_actions / candidate_actions,
    has_is_corrected / is_corrected); its columns ``carried`` go along.
    """
    a = answers.select(
        key, "step", "corrected_reason", "corrected_action", *carried,
        *[F.col(c).alias(f"a_{c}") for c in
          ("has_original_observation", "original_observation", "has_original_reason", "original_reason",
           "has_original_action", "original_action", "has_candidate_actions", "candidate_actions",
           "has_is_corrected", "is_corrected")])
    s = steps.select(key, "step", "observation", "reason", "action",
                     F.col("candidate_actions").alias("s_candidate_actions"))
    j = s.join(a, [key, "step"])
    cands = F.when(F.col("s_candidate_actions").isNull(), F.col("a_candidate_actions")) \
             .otherwise(_take("a_has_candidate_actions", "a_candidate_actions", "s_candidate_actions"))
    merged = j.select(
        key, "step",
        _take("a_has_original_observation", "a_original_observation", "observation").alias("original_observation"),
        _take("a_has_original_reason", "a_original_reason", "reason").alias("original_reason"),
        _take("a_has_original_action", "a_original_action", "action").alias("original_action"),
        "corrected_reason", "corrected_action",
        cands.alias("candidate_actions"),
        F.col("s_candidate_actions").isNotNull().alias("_rollout_has_cands"),
        F.col("a_has_is_corrected").alias("has_is_corrected"),
        F.col("a_is_corrected").alias("is_corrected"), *carried,
    )
    return teacher_flag(merged).drop("_rollout_has_cands")


def _last_value(m: Column, key: str) -> Column:
    """Value of a key of a parsed object; of a repeated key the last, as in Python."""
    hits = F.filter(F.map_entries(m), lambda e: e["key"] == F.lit(key))
    return F.get(hits, F.size(hits) - 1)["value"]


def parse_corrections(responses: DataFrame, text: str = "response") -> DataFrame:
    """R6 -> R7 -> R8 -> X21: adds ``fault`` (null if usable), ``summary`` and ``answer`` (array of text maps)."""
    from episodeflow.functions import parsers as R
    from episodeflow.operators.responses import json_valid

    one = F.concat(F.lit("["), R.strip(F.col("_fixed")), F.lit("]"))
    top = F.get(F.from_json(one, "array<map<string,string>>"), 0)
    rows = (responses.withColumn("_block", R.json_block(F.col(text)))
                     .withColumn("_fixed", R.json_repair(F.col("_block")))
                     .withColumn("_ok", json_valid(F.col("_fixed")))
                     .withColumn("_top", F.when(F.col("_ok"), top))
                     .withColumn("answer", F.from_json(_last_value(F.col("_top"), "trajectory"), "array<map<string,string>>")))
    has = lambda k: F.coalesce(F.map_contains_key("_top", k), F.lit(False))
    fault = (F.when(F.col("_block").isNull(), F.lit("no_block")).when(~F.col("_ok"), F.lit("invalid_json"))
              .when(~has("summary"), F.lit("missing summary"))
              .when(F.col("answer").isNull() | F.exists("answer", lambda m: m.isNull()), F.lit("missing trajectory")))
    return (rows.withColumn("fault", fault).withColumn("summary", _last_value(F.col("_top"), "summary"))
                .drop("_block", "_fixed", "_ok", "_top"))


#: Keys that an answer may carry for a step.
ANSWER_KEYS = ("corrected_reason", "corrected_action", "original_observation", "original_reason", "original_action",
               "candidate_actions", "is_corrected")


def correct_job(responses: DataFrame, steps: DataFrame, retries: int = 3, key: str = "episode_id",
                required: Iterable[str] = ("corrected_reason", "corrected_action")) -> tuple[DataFrame, DataFrame]:
    """The correction job: answers (key, attempt, response) and rollout steps -> corrections and rejects.

    Parse (R6-R8), guard (X21, R12), first usable attempt within the retry
    budget (W6), merge with the rollout (J3, R13). A reject names the fault of
    the last attempt; an episode without an answer, one whose answers all lie
    beyond the budget and answers of an episode that has no steps are rejects too.

    The first usable answer is taken by the same grouping that finds the last
    fault, and its attempt and summary travel with its steps.
    """
    within = F.coalesce(F.col("attempt") <= F.lit(int(retries)), F.lit(False))
    asked = responses.select(key, "attempt", within.alias("_within"), F.when(within, F.col("response")).alias("response"))
    lengths = steps.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.size("answer") != F.col("_n"), F.lit("length mismatch"))
    for k in required:
        fault = fault.when(F.exists("answer", lambda m: ~F.map_contains_key(m, k)), F.lit(f"missing {k}"))
    judged = parse_corrections(asked).join(lengths, key, "left").withColumn("fault", F.when(F.col("_n").isNotNull(), fault))
    usable = F.when(F.col("_within") & F.col("_n").isNotNull() & F.col("fault").isNull(), F.col("attempt"))
    tries = judged.groupBy(key).agg(
        F.min_by(F.struct("attempt", "summary", "answer"), usable).alias("_first"),
        F.max_by("fault", F.when(F.col("_within"), F.col("attempt"))).alias("fault"),
        F.max("_within").alias("_asked"), F.max("_n").alias("_n"))
    rows = tries.where(F.col("_first").isNotNull()).select(key, "_first.attempt", "_first.summary", F.posexplode("_first.answer").alias("step", "m"))
    answers = rows.select(key, F.col("step").cast("int").alias("step"), "attempt", "summary",
                          *[F.map_contains_key("m", k).alias(f"has_{k}") for k in ANSWER_KEYS],
                          *[_last_value(F.col("m"), k).alias(k) for k in ANSWER_KEYS[:5]],
                          F.from_json(_last_value(F.col("m"), "candidate_actions"), "array<string>").alias("candidate_actions"),
                          _last_value(F.col("m"), "is_corrected").try_cast("boolean").alias("is_corrected"))
    merged = correction_merge(steps, answers, key, carried=("attempt", "summary"))
    reason = (F.when(F.col("_asked").isNull(), F.lit("no answer")).when(F.col("_n").isNull(), F.lit("unknown episode"))
               .when(~F.col("_asked"), F.lit("attempts beyond the budget")).otherwise(F.col("fault")))
    failed = lengths.drop("_n").join(tries, key, "full").where(F.col("_first").isNull())
    return merged, failed.select(key, reason.alias("reject_reason"))


def teacher_flag(df: DataFrame) -> DataFrame:
    """Answer has is_corrected and its action is not a candidate -> false; else unchanged."""
    not_cand = ~F.coalesce(F.array_contains(F.col("candidate_actions"), F.col("corrected_action")), F.lit(False))
    cond = F.col("_rollout_has_cands") & F.col("has_is_corrected") & not_cand \
        if "_rollout_has_cands" in df.columns else F.col("has_is_corrected") & not_cand
    return df.withColumn("is_corrected", F.when(cond, F.lit(False)).otherwise(F.col("is_corrected")))


def self_flag(old: Column, new: Column, cands: Column) -> Column:
    """Unchanged -> false; not a candidate and no 'search' in it -> false; else true."""
    in_c = F.coalesce(F.array_contains(cands, new), F.lit(False))
    return (F.when(new == old, F.lit(False))
             .when(~in_c & ~F.contains(new, F.lit("search")), F.lit(False))
             .otherwise(F.lit(True)))


def candidate_check(action: Column, cands: Column) -> Column:
    """Is the action one of the step's own candidates (null list -> false)."""
    return F.coalesce(F.array_contains(cands, action.cast("string")), F.lit(False))


def resume_anti(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs not yet in the output."""
    return inputs.join(outputs.select(key), key, "left_anti")
