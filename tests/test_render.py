"""Rendered prompts and teacher requests equal a plain-Python rendering of the same steps."""

from pyspark.sql import functions as F

from episodeflow.operators import prompts as P
from episodeflow.operators import steps as S
from episodeflow.plans import bind

from data_paths import SMOKE


def _python_prompt(tpl, task, history, observation, candidates):
    hist = [{"observation": o, "action": a} for o, a in history]
    return tpl.input.format(task=task or "", history=repr(hist), observation=str(observation),
                            candidates="" if candidates is None else repr(list(candidates)))


def test_prompt_and_response_match_python(spark):
    tpl = P.Template()
    st = S.step_history(bind.text_steps(bind.Tables(spark, SMOKE).conversations))
    rows = P.prompt_build(st, tpl).withColumn(
        "response", P.response_text(F.col("reason"), F.col("action"), tpl)).collect()
    assert rows
    for r in rows:
        hist = [(h.observation, h.action) for h in r.history]
        assert r.prompt == _python_prompt(tpl, r.task, hist, r.observation, r.candidate_actions)
        assert r.response == tpl.output.format(reason=r.reason, action=r.action)


def test_teacher_request_matches_python(spark):
    st = bind.text_steps(bind.Tables(spark, SMOKE).conversations)
    req = {r.episode_id: r.messages for r in P.teacher_request(st, state=F.col("task")).collect()}
    by_ep = {}
    for r in st.collect():
        by_ep.setdefault(r.episode_id, []).append(r)
    for ep, steps in by_ep.items():
        steps.sort(key=lambda r: r.step)
        traj = [{"timestep": r.step, "observation": r.observation, "candidate_actions": list(r.candidate_actions),
                 "reason": r.reason, "action": r.action} for r in steps]
        want = f"Trajectory:\n{traj!r}\n\nPrivileged state:\n{steps[0].task}"
        assert req[ep][1].content == want
        assert req[ep][0].role == "system" and req[ep][1].role == "user"


def test_chat_render_and_span(spark):
    rows = spark.createDataFrame(
        [([("user", "hi")], [("assistant", "ok")])],
        "prompt array<struct<role:string,content:string>>, response array<struct<role:string,content:string>>")
    out = P.chat_render(rows).select("text", *P.completion_span(F.col("text"))).first()
    assert out[0] == "<|user|>\nhi\n<|end|>\n<|assistant|>\n<|response|> ok\n<|end|>\n"
    start = out[0].index(P.RESPONSE_MARKER) + len(P.RESPONSE_MARKER) + 1
    assert out[1] == start and out[0][start - 1:] == out[0][start - 1:start - 1 + out[2]]


def test_extraction_request_is_json_dumps(spark):
    import json

    import __spark_entry__ as E
    out = {r.episode_id: r.user_content for r in E.queries()["extraction_request"](spark, SMOKE).collect()}
    st = bind.text_steps(bind.Tables(spark, SMOKE).conversations).collect()
    by_ep = {}
    for r in st:
        by_ep.setdefault(r.episode_id, []).append(r)
    for ep, steps in by_ep.items():
        steps.sort(key=lambda r: r.step)
        traj = [{"observation": r.observation, "candidate_actions": list(r.candidate_actions),
                 "reason": r.reason, "action": r.action, "is_corrected": r.is_corrected,
                 "corrected_reason": r.corrected_reason, "corrected_action": r.corrected_action} for r in steps]
        assert out[ep] == "Trajectory (JSON):\n" + json.dumps(traj)
