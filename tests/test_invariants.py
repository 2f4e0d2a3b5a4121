"""Invariants of splits, ranks, history, merges and rounding."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodeflow.operators import correct as C
from episodeflow.operators import metrics as MT
from episodeflow.operators import ordering as O
from episodeflow.operators import steps as S
from episodeflow.plans import bind
from episodeflow.plans.rank import global_rank, prefix_sum

from data_paths import SF001


@pytest.mark.parametrize("n", [0, 1, 7, 20, 100])
@pytest.mark.parametrize("frac", [0.85, 0.7])
def test_split_sizes(spark, n, frac):
    eps = spark.range(n).withColumnRenamed("id", "episode_id")
    sp = S.episode_split(eps, "episode_id", frac, 42)
    got = {r.split: r.n for r in O.split_sizes(sp).collect()}
    assert got.get("train", 0) == math.floor(n * frac)
    assert got.get("test", 0) == n - math.floor(n * frac)


def test_global_rank_matches_row_number_and_is_deterministic(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), F.col("id"))
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k", "id")))
    a = global_rank(df, ["k", "id"], "r", num_partitions=7)
    b = global_rank(df, ["k", "id"], "r", num_partitions=3)
    assert a.exceptAll(ref).count() == 0 and b.exceptAll(ref).count() == 0


def test_prefix_sum_exact(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("g"), F.col("id"), (F.col("id") * 3).alias("v"))
    ps = prefix_sum(df, ["g", "id"], "v", "cum", num_partitions=6, rank_col="rk")
    ref = df.select("g", "id", F.sum("v").over(Window.orderBy("g", "id").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                    F.row_number().over(Window.orderBy("g", "id")).alias("rk"))
    assert ps.select("g", "id", "cum", "rk").exceptAll(ref).count() == 0


def test_history_keeps_skipped_steps(spark):
    st = spark.createDataFrame(
        [(1, 0, "o0", "a0", None), (1, 1, "o1", "a1", False), (1, 2, "o2", "a2", True)],
        "episode_id long, step int, observation string, action string, is_corrected boolean")
    out = S.uncorrected_skip(S.step_history(st)).orderBy("step").collect()
    assert [r.step for r in out] == [0, 2]
    assert [h.action for h in out[1].history] == ["a0", "a1"]
    assert out[0].history == []


def test_text_steps_history_length_equals_step(spark):
    t = bind.Tables(spark, SF001)
    h = S.step_history(bind.text_steps(t.conversations))
    assert h.where(F.size("history") != F.col("step")).count() == 0


def test_correction_merge_rows_in_equal_rows_out_plus_rejects(spark):
    t = bind.Tables(spark, SF001)
    st = bind.text_steps(t.conversations)
    ans = bind.answers(st)
    good, rejects = C.validate_answers(ans, st)
    n_eps = st.select("episode_id").distinct().count()
    assert good.select("episode_id").distinct().count() + rejects.count() == n_eps
    reasons = {r.reject_reason for r in rejects.collect()}
    assert reasons == {"length mismatch", "missing corrected_action"}
    merged = C.correction_merge(st, good)
    assert merged.count() == good.count()


def test_correction_merge_present_null_stays_null(spark):
    st = spark.createDataFrame([(1, 0, "o", "r", "a", ["a", "b"])],
                               "episode_id long, step int, observation string, reason string, action string, "
                               "candidate_actions array<string>")
    ans = spark.createDataFrame(
        [(1, 0, "cr", "zzz", False, None, True, None, False, None, False, None, True, True)],
        "episode_id long, step int, corrected_reason string, corrected_action string, "
        "has_original_observation boolean, original_observation string, has_original_reason boolean, "
        "original_reason string, has_original_action boolean, original_action string, "
        "has_candidate_actions boolean, candidate_actions array<string>, has_is_corrected boolean, is_corrected boolean")
    r = C.correction_merge(st, ans).first()
    assert r.original_reason is None and r.original_observation == "o" and r.original_action == "a"
    assert r.candidate_actions == ["a", "b"] and r.is_corrected is False


def test_self_flag(spark):
    df = spark.createDataFrame([("go", "go"), ("go", "x"), ("go", "search[y]"), ("go", "b")], "old string, new string")
    got = [r[0] for r in df.select(C.self_flag(F.col("old"), F.col("new"), F.array(F.lit("a"), F.lit("b")))).collect()]
    assert got == [False, False, True, True]


def test_means_overall_counts_null_category_and_nan(spark):
    sm = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 3.0), ("b", 2.0)], "cat string, score double")
    m = {r.cat: r.mean_score for r in MT.means_with_overall(sm, "cat", ["score"]).collect()}
    assert m == {"a": 1.0, "b": 2.0, "overall": 2.0}


def test_rounding_fixed_values(spark):
    df = spark.createDataFrame([(x,) for x in [0.25, 0.35, 2.675, 1234.56]], "x double")
    got = df.select(MT.one_decimal_text(F.col("x")), MT.round1(F.col("x"))).collect()
    assert [g[0] for g in got] == [f"{x:.1f}" for x in [0.25, 0.35, 2.675, 1234.56]]
    import numpy as np  # pandas .round(1) is numpy rounding
    assert [g[1] for g in got] == [float(np.round(x, 1)) for x in [0.25, 0.35, 2.675, 1234.56]]


def test_model_pivot_rejects_duplicates(spark):
    sm = spark.createDataFrame([(1, "m", 1.0, 3), (1, "m", 0.0, 4)], "env_idx long, model_id string, score double, num_actions int")
    with pytest.raises(Exception, match="duplicate"):
        MT.model_pivot(sm, "env_idx", "model_id", ["m"]).collect()
    two = spark.createDataFrame([(1, "m", 1.0, 3), (2, "q", 0.0, 4)], "env_idx long, model_id string, score double, num_actions int")
    with pytest.raises(Exception, match="outside the list"):
        MT.model_pivot(two, "env_idx", "model_id", ["m"]).collect()
    assert MT.model_pivot(two, "env_idx", "model_id").columns == ["env_idx", "score_m", "num_actions_m", "score_q", "num_actions_q"]
    ok = spark.createDataFrame([(1, "m", 1.0, 3), (1, "n", 0.0, 4)], "env_idx long, model_id string, score double, num_actions int")
    assert MT.model_pivot(ok, "env_idx", "model_id", ["m", "n"]).first() == (1, 1.0, 3, 0.0, 4)


def test_state_lookup_strict(spark):
    eps = spark.createDataFrame([(1,), (2,)], "episode_id long")
    state = spark.createDataFrame([("1", "s")], "id string, state string")
    with pytest.raises(C.MissingKeysError):
        C.state_lookup(eps, state, "episode_id", strict=True)


def test_candidate_cap(spark):
    df = spark.createDataFrame([([f"c{i}" for i in range(25)],), ([f"c{i}" for i in range(5)],)], "c array<string>")
    out = [r[0] for r in df.select(O.candidate_cap(F.col("c"))).collect()]
    assert out[0][:6] == [f"c{i}" for i in range(6)] and len(out[0]) == 16 and len(set(out[0])) == 16
    assert out[1] == [f"c{i}" for i in range(5)]


def test_plans_have_no_python_udf_except_generation(spark):
    import __spark_entry__ as E
    qs = E.queries()
    for k in ["sft_rows", "parse_game", "correction_merge", "teacher_request", "episode_split"]:
        plan = qs[k](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, k


def test_text_steps_window_and_join_forms_agree(spark):
    for sf in ("/root/testdata/sf0.001", SF001):
        conv = bind.Tables(spark, sf).conversations
        a = bind.text_steps(conv)
        b = bind.text_steps(conv, skew_safe=True).select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_seq_key_orders_like_the_pair(spark):
    import datetime
    import random
    rnd = random.Random(7)
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(microseconds=rnd.choice([0, 1, 5, 10**6, 10**12])),
             rnd.choice([-(2**63), -5, 0, 3, 2**63 - 1, rnd.randint(-10**18, 10**18)])) for _ in range(300)]
    rows += [(datetime.datetime(1, 1, 1), 2**63 - 1), (datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), -(2**63))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long").withColumn("k", bind.seq_key(F.col("ts"), F.col("id")))
    got = [(r.ts, r.id) for r in df.orderBy("k").collect()]
    assert got == sorted(rows)
