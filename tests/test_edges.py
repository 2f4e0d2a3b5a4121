"""Edge fixtures of FIXTURES.md section 4 that are not covered elsewhere."""

import json
import os

from pyspark.sql import functions as F

from episodeflow.operators import responses as RS
from episodeflow.operators import steps as S
from episodeflow.operators.candidates import candidate_build
from episodeflow.sources import files


def _status(spark, texts, fn, schema=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    out = fn(df, schema) if schema else fn(df)
    return [(r.status, r[out.columns[-2]]) for r in out.orderBy("i").collect()]


def test_json_answer_statuses(spark):
    fence = "```json\n{}\n```"
    texts = [
        fence.format('{"a": "x", "b": [1, 2, ],}'),             # trailing commas: repaired
        fence.format('{"a": NaN}'),                             # accepted, as in Python
        fence.format('{"a": "1", "a": "2"}'),                   # repeated key: the last one
        fence.format('{"a": "1"} trailing'),                    # trailing text
        fence.format('{"a": "one"}') + "\n" + fence.format('{"a": "two"}'),  # first block wins
        '```json\n{"a": "x"}',                                  # no closing fence
        "no block at all",
        fence.format('{"a": "say \\"hi\\" C:\\\\x"}'),           # escaped quote and backslash
    ]
    got = _status(spark, texts, RS.json_answers, "a string")
    assert [g[0] for g in got] == ["ok", "ok", "ok", "invalid_json", "ok",
                                   "no_block", "no_block", "ok"]
    assert got[0][1]["a"] == "x" and got[4][1]["a"] == "one"
    assert got[7][1]["a"] == "say 'hi' C:\\\\x"


def test_trajectory_only_variant(spark):
    fence = "```json\n{}\n```"
    texts = [fence.format('{"trajectory": [{"corrected_action": "go"}, {"corrected_reason": "r"}]}'),
             fence.format('{"trajectory": ["a", "b"]}'),
             fence.format('{"other": []}'),
             fence.format('{"trajectory": []}')]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    rows = RS.trajectory_answers(df).orderBy("i").collect()
    assert [r.status for r in rows] == ["ok", "not_a_list_of_objects", "not_a_list_of_objects", "ok"]
    assert rows[0].trajectory[0]["corrected_action"] == "go"


def test_trajectory_with_repeated_keys_and_nan(spark):
    fence = "```json\n{}\n```"
    texts = [fence.format('{"trajectory": [{"score": NaN, "a": "one", "b": "x", "a": "two"}]}'),
             fence.format('{"trajectory": 1, "trajectory": [{"a": "x"}]}'),
             fence.format('{"trajectory": [{"a": "x"}], "trajectory": "no"}'),
             fence.format('{"trajectory": [null]}'), fence.format('[{"a": 1}]'), fence.format('{"trajectory": null}'), None, "no block"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    rows = RS.trajectory_answers(df).selectExpr("i", "status", "trajectory[0]['a'] AS a", "trajectory[0]['score'] AS score").orderBy("i").collect()
    no = "not_a_list_of_objects"
    assert [r.status for r in rows] == ["ok", "ok", no, no, no, no, "no_block", "no_block"]
    assert [r.a for r in rows] == ["two", "x"] + [None] * 6 and rows[0].score == "NaN"


def test_correction_job_names_unknown_episodes_and_spent_budgets(spark):
    from episodeflow.operators import correct as C
    answer = '```json\n{"summary": "s%d", "trajectory": [{"corrected_reason": "r", "corrected_action": "%s"}]}\n```'
    responses = spark.createDataFrame(
        [(1, 1, "nothing"), (1, 2, answer % (2, "b")), (1, 3, answer % (3, "a")), (2, 4, answer % (4, "a")), (3, 1, "nothing"), (3, 2, "```json\n{]\n```"),
         (3, 9, answer % (9, "a")), (7, 1, answer % (1, "a")), (None, 1, answer % (1, "a"))], "episode_id long, attempt int, response string")
    steps = spark.createDataFrame([(e, 0, "o", "r0", "a", ["a", "b"]) for e in (1, 2, 3, 4)],
                                  "episode_id long, step int, observation string, reason string, action string, candidate_actions array<string>")
    good, rejects = C.correct_job(responses, steps, 3)
    assert [(r.episode_id, r.step, r.attempt, r.summary, r.corrected_action) for r in good.collect()] == [(1, 0, 2, "s2", "b")]
    assert sorted(((r.episode_id, r.reject_reason) for r in rejects.collect()), key=str) == [
        (2, "attempts beyond the budget"), (3, "invalid_json"), (4, "no answer"), (7, "unknown episode"), (None, "unknown episode")]


def test_polymorphic_fields_and_boolean_score(spark, tmp_path):
    d = str(tmp_path / "logs")
    os.makedirs(d)
    steps = [
        {"observation": "o0", "action": "a", "candidate_actions": ["a", "b"], "score": 1.0},
        {"observation": "o1", "action": "a", "candidate_actions": "", "score": True},
        {"observation": "o2", "action": "a", "candidate_actions": None},
        {"observation": "o3", "action": "a"},
    ]
    with open(f"{d}/5.json", "w") as f:
        json.dump({"trajectory": steps}, f)
    with open(f"{d}/6.json", "w") as f:
        json.dump({"trajectory": []}, f)
    eps, rej = files.scan_episode_dir(spark, d)
    assert rej.count() == 0
    st = files.episode_steps(eps).orderBy("step").collect()
    assert [r.observation for r in st] == ["o0", "o1", "o2", "o3"]
    assert st[0].candidate_actions == ["a", "b"]
    assert all(r.candidate_actions is None for r in st[1:])
    assert [r.score for r in st] == [1.0, 1.0, None, None]


def test_observations_of_any_json_type_print_as_python_text(spark, tmp_path):
    shown = [[["Ann", 3], ["Bob", None]], "plain 'text'", [], True, 3, {"a": [1.5, False]}, [["it's"], [[["deep"]]]]]
    with open(tmp_path / "sql.json", "w") as f:
        json.dump({"trajectory": [{"observation": o} for o in shown] + [{"action": "x"}]}, f)
    eps, _ = files.scan_episode_dir(spark, str(tmp_path))
    got = [r.observation for r in files.episode_steps(eps).orderBy("step").collect()]
    assert got == [str(o) for o in shown] + [None]


def test_first_valid_attempt_budget(spark):
    att = spark.createDataFrame([(1, 1, False, "a"), (1, 2, True, "b"), (1, 3, True, "c"),
                                 (2, 1, False, "x"), (2, 2, False, "y"), (2, 3, True, "z"),
                                 (3, 4, True, "late")], "request_id long, attempt int, valid boolean, text string")
    got = {r.request_id: (r.attempt, r.text) for r in S.first_valid_attempt(att, 2).collect()}
    assert got == {1: (2, "b")}            # request 2 needs a third attempt, request 3 a fourth
    got3 = {r.request_id: r.text for r in S.first_valid_attempt(att, 3).collect()}
    assert got3 == {1: "b", 2: "z"}


def test_episode_truncate_first_done_and_limit(spark):
    st = spark.createDataFrame([(1, i, "buy" if i == 2 else "x") for i in range(5)] +
                               [(2, i, "x") for i in range(5)], "episode_id long, step int, action string")
    for safe in (True, False):
        out = S.episode_truncate(st, F.col("action") == "buy", limit=4, skew_safe=safe)
        got = sorted((r.episode_id, r.step) for r in out.collect())
        assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_prev_observation_both_ways(spark):
    st = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "episode_id long, step int, observation string")
    for safe in (True, False):
        got = sorted((r.episode_id, r.step, r.prev_observation) for r in S.prev_observation(st, skew_safe=safe).collect())
        assert got == [(1, 0, None), (1, 1, "a"), (2, 0, None)]


def test_conditional_ban_and_candidate_build(spark):
    df = spark.createDataFrame([(["click[a]", "click[buy now]"], 1, 2), (["click[buy now]"], 2, 2)],
                               "c array<string>, sel int, tot int")
    got = [r[0] for r in df.select(S.conditional_ban(F.col("c"), F.col("sel"), F.col("tot"))).collect()]
    assert got == [["click[a]"], ["click[buy now]"]]
    df2 = spark.createDataFrame([(["search", "b07x", "back"], [None, "Lamp", None], True),
                                 (["search", "b07x", "back"], [None, "Lamp", None], False),
                                 (["search"], [None], False)], "c array<string>, l array<string>, s boolean")
    out = [r[0] for r in df2.select(candidate_build(F.col("c"), F.col("l"), F.col("s"))).collect()]
    assert out == [["search[<search query>]"], ["click[item - Lamp]", "click[back]"], ["finish"]]


def test_left_truncate_tokens_exact(spark):
    import re

    from episodeflow.operators.prompts import left_truncate
    texts = ["a b  c\td\n", "  lead", "x " * 300 + "end", ("w" * 50 + " ") * 40, "", "one", "p q r s t u"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(left_truncate(F.col("s"), 3, "tokens", window_per_token=4)).collect()]
    want = [" ".join(re.split(r"[ \t\n\r\f]+", t)[-3:]) for t in texts]
    assert got == want


def test_small_operators(spark):
    from episodeflow.operators import metrics as MT
    from episodeflow.operators.prompts import pack_blocks
    st = spark.createDataFrame([(1, 0, "o", ["a"], "r", "a")],
                               "episode_id long, step int, observation string, candidate_actions array<string>, "
                               "reason string, action string")
    p = S.teacher_payload(st).first().payload
    assert (p.timestep, p.observation, p.candidate_actions, p.reason, p.action) == (0, "o", ["a"], "r", "a")
    a = spark.createDataFrame([(1, 0.5), (2, 1.0)], "k long, x double")
    b = spark.createDataFrame([(2, 3), (3, 4)], "k long, y int")
    got = sorted(tuple(r) for r in MT.outer_merge([a, b], "k").collect())
    assert got == [(1, 0.5, None), (2, 1.0, 3), (3, None, 4)]
    rows = spark.createDataFrame([("s", i, 40) for i in range(6)] + [("t", i, 60) for i in range(3)],
                                 "shard string, id int, n int")
    blocks = {(r.shard, r.id): r.block for r in pack_blocks(rows, F.col("n"), 100, "id", "id", shard="shard").collect()}
    assert [blocks[("s", i)] for i in range(6)] == [0, 0, 0, 1, 1, 2]
    assert [blocks[("t", i)] for i in range(3)] == [0, 0, 1]
    eps = spark.createDataFrame([(i,) for i in [5, 1, 9, 3]], "env_idx long")
    assert [r.env_idx for r in S.episode_cap(eps, 2, "env_idx").collect()] == [1, 3]
    assert sorted(r.env_idx for r in S.start_index(eps, 3, inclusive=False).collect()) == [5, 9]
    assert sorted(r.env_idx for r in S.start_index(eps, 3).collect()) == [3, 5, 9]
    g = spark.createDataFrame([(1,), (700,), (2000,)], "idx long")
    assert {r.split for r in S.goal_ranges(g, capped=True).collect()} == {"all"}
    assert [r.split for r in S.goal_ranges(g).orderBy("idx").collect()] == ["test", "eval", "train"]
