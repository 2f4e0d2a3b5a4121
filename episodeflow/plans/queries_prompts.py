"""Registered prompt / training-row queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.operators import prompts as P
from episodeflow.operators import steps as S
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.registry import register

TPL = P.Template()


def history_steps(spark, sf_dir):
    """Text steps with the rendered W1 history (computed before any step filter)."""
    t = bind.Tables(spark, sf_dir)
    return S.step_history_text(bind.text_steps(t.conversations))


HIST_CTE = """
hsteps AS (
  SELECT *, list({'observation': observation, 'action': action}) OVER (
             PARTITION BY episode_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history
  FROM tsteps)"""

PROMPT_SQL = Q.render(TPL.input, {
    "task": "coalesce(task, '')",
    "history": Q.history_text("history"),
    "observation": Q.shown("observation"),
    "candidates": f"CASE WHEN candidate_actions IS NULL THEN '' ELSE {Q.py_list('candidate_actions')} END",
})
RESPONSE_SQL = Q.render(TPL.output, {"reason": Q.shown("reason"), "action": Q.shown("action")})


@register("step_history", ids=("W1",), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, CAST(coalesce(len(history), 0) AS BIGINT) AS n_history,
       {Q.history_text('history')} AS history_text
FROM hsteps""")
def q_step_history(spark, sf_dir):
    h = history_steps(spark, sf_dir)
    return h.select("episode_id", "step", F.col("n_history").cast("long").alias("n_history"), "history_text")


@register("prompt_build", ids=("P1", "F10"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, {PROMPT_SQL} AS prompt FROM hsteps""")
def q_prompt_build(spark, sf_dir):
    return P.prompt_build(history_steps(spark, sf_dir), TPL).select("episode_id", "step", "prompt")


PRIVILEGED = P.Template(input=P.PRIVILEGED_INPUT)
PRIVILEGED_SQL = Q.render(PRIVILEGED.input, {
    "task": "coalesce(task, '')",
    "history": Q.history_text("history"),
    "observation": Q.shown("observation"),
    "candidates": f"CASE WHEN candidate_actions IS NULL THEN '' ELSE {Q.py_list('candidate_actions')} END",
    "privileged_state": "coalesce(state, '')",
})


@register("privileged_prompt", ids=("P1", "J1"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE, Q.STATE) + f"""
SELECT episode_id, step, {PRIVILEGED_SQL} AS prompt
FROM (SELECT h.*, s.state FROM hsteps h LEFT JOIN state s ON s.id = CAST(h.episode_id AS VARCHAR))""")
def q_privileged_prompt(spark, sf_dir):
    from episodeflow.operators.correct import state_lookup
    st = state_lookup(history_steps(spark, sf_dir), bind.state_table(bind.Tables(spark, sf_dir).supplier), "episode_id")
    return P.prompt_build(st, PRIVILEGED).select("episode_id", "step", "prompt")


@register("response_build", ids=("P2",), sql=Q.with_(Q.TEXT_STEPS) + f"""
SELECT episode_id, step, {RESPONSE_SQL} AS response FROM tsteps""")
def q_response_build(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    st = bind.text_steps(t.conversations)
    return st.select("episode_id", "step", P.response_text(F.col("reason"), F.col("action"), TPL).alias("response"))


def sft_frame(spark, sf_dir):
    """Flagship: training rows with full history; F4 drops steps flagged false after W1."""
    return flat_messages(P.sft_rows(S.uncorrected_skip(history_steps(spark, sf_dir)), TPL))


def flat_messages(rows):
    return rows.select("episode_id", "step",
                       F.col("prompt")[0]["role"].alias("prompt_role"),
                       F.col("prompt")[0]["content"].alias("prompt"),
                       F.col("response")[0]["role"].alias("response_role"),
                       F.col("response")[0]["content"].alias("response"))


@register("sft_rows", ids=("P3", "M0"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, 'user' AS prompt_role, {PROMPT_SQL} AS prompt,
       'assistant' AS response_role, {RESPONSE_SQL} AS response
FROM hsteps WHERE is_corrected IS DISTINCT FROM false""")
def q_sft_rows(spark, sf_dir):
    return sft_frame(spark, sf_dir)


@register("sft_rows_shared", ids=("W1", "P1", "P3"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, 'user' AS prompt_role, {PROMPT_SQL} AS prompt,
       'assistant' AS response_role, {RESPONSE_SQL} AS response
FROM hsteps WHERE is_corrected IS DISTINCT FROM false""")
def q_sft_rows_shared(spark, sf_dir):
    """``sft_rows`` for conversations of any length: steps from distributed ranks, histories from shared prefixes."""
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations, skew_safe=True)
    return flat_messages(P.sft_rows(S.uncorrected_skip(S.shared_history(st)), TPL))


@register("event_history", ids=("W1", "W2"), sql=Q.with_(Q.SCORED_STEPS, HIST_CTE.replace("tsteps", "ssteps")) + f"""
SELECT episode_id, step, CAST(coalesce(len(history), 0) AS BIGINT) AS n_history,
       CAST(length({Q.history_text('history')}) AS BIGINT) AS history_chars, md5({Q.history_text('history')}) AS history_md5
FROM hsteps""")
def q_event_history(spark, sf_dir):
    """Histories of users of any number of events: size and digest of each step's history text."""
    h = S.shared_history(bind.scored_steps(bind.Tables(spark, sf_dir).events))
    return h.select("episode_id", "step", "n_history", F.char_length("history_text").cast("long").alias("history_chars"), F.md5("history_text").alias("history_md5"))


# --- P4..P14 -----------------------------------------------------------------

@register("pref_rows", ids=("P4", "M9"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT h.episode_id, h.step, {PROMPT_SQL} AS prompt,
       {Q.render(TPL.output, {"reason": Q.shown("corrected_reason"), "action": Q.shown("corrected_action")})} AS chosen,
       {RESPONSE_SQL} AS rejected, l.quality
FROM hsteps h LEFT JOIN labels l ON l.doc_id = h.episode_id
WHERE h.is_corrected IS DISTINCT FROM false""")
def q_pref_rows(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    rows = P.pref_rows(S.uncorrected_skip(history_steps(spark, sf_dir)), TPL)
    lab = t.labels.select(F.col("doc_id").alias("episode_id"), "quality")
    return rows.join(lab, "episode_id", "left").select(
        "episode_id", "step", F.col("prompt")[0]["content"].alias("prompt"),
        F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"), "quality")


_REQ_ITEM = Q.request_item()
SYSTEM_TEXT = "You correct the steps of a student agent."


@register("teacher_request", ids=("P5", "F11", "X2", "M7"), sql=Q.with_(Q.TEXT_STEPS) + f""",
r AS (SELECT episode_id, '[' || string_agg({_REQ_ITEM}, ', ' ORDER BY step) || ']' AS traj, max(task) AS task
      FROM tsteps GROUP BY episode_id)
SELECT episode_id, '{SYSTEM_TEXT}' AS system_content,
       'Trajectory:' || chr(10) || traj || chr(10) || chr(10) || 'Privileged state:' || chr(10) ||
       {Q.shown('task')} AS user_content
FROM r""")
def q_teacher_request(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    req = P.teacher_request(st, state=F.col("task"), system_text=SYSTEM_TEXT)
    return req.select("episode_id", F.col("messages")[0]["content"].alias("system_content"),
                      F.col("messages")[1]["content"].alias("user_content"))


ANNOTATE_TEXT = "You write the reason behind each action."
_ANN_ITEM = ("'{''timestep'': ' || CAST(step AS VARCHAR) || ', ''observation'': ' || " + Q.py_str("observation")
             + " || ', ''action'': ' || " + Q.py_str("action") + " || '}'")


@register("annotation_request", ids=("P5", "F11"), sql=Q.with_(Q.TEXT_STEPS) + f"""
SELECT episode_id, '{ANNOTATE_TEXT}' AS system_content,
       'Trajectory:' || chr(10) || '[' || string_agg({_ANN_ITEM}, ', ' ORDER BY step) || ']' AS user_content
FROM tsteps GROUP BY episode_id""")
def q_annotation_request(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    req = P.teacher_request(st, system_text=ANNOTATE_TEXT, user_template="Trajectory:\n{trajectory}", fields=("observation", "action"))
    return req.select("episode_id", F.col("messages")[0]["content"].alias("system_content"),
                      F.col("messages")[1]["content"].alias("user_content"))


@register("goal_state_text", ids=("P6", "U4", "M11"), sql=Q.with_(Q.GOALS) + f"""
SELECT idx, 'Instruction: ' || instruction || chr(10) || 'Attributes: ' || {Q.py_list('attributes')} || chr(10) ||
       'Price upper limit: ' || printf('%.2f', price_upper) || chr(10) || 'Options: []' || chr(10) ||
       'Example product: ' || instruction AS state
FROM goals""")
def q_goal_state_text(spark, sf_dir):
    """P6 as the state builder (U4) of a shop goal."""
    g = bind.goals(bind.Tables(spark, sf_dir).part)
    return P.goal_state_text(g)


@register("gold_state_text", ids=("P7", "U4"), sql="""
SELECT p_partkey AS id, 'Task: ' || p_name || chr(10) || 'Gold command: ' ||
       'SELECT * FROM part WHERE p_partkey = ' || CAST(p_partkey AS VARCHAR) || chr(10) ||
       'Gold output: ' || p_brand || ' ' || p_type AS state
FROM part""")
def q_gold_state_text(spark, sf_dir):
    p = bind.Tables(spark, sf_dir).part
    rec = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("task"),
                   F.concat(F.lit("SELECT * FROM part WHERE p_partkey = "), F.col("p_partkey").cast("string")).alias("gold"),
                   F.concat_ws(" ", "p_brand", "p_type").alias("gold_observation"))
    return P.gold_state_text(rec)


LAYOUT = P.ChatLayout()
_PRE, _POST = LAYOUT.header.split("{role}")
CHAT_SQL = (f"({Q.lit(_PRE)} || 'user' || {Q.lit(_POST)} || {PROMPT_SQL} || {Q.lit(LAYOUT.end)} || "
            f"{Q.lit(_PRE)} || 'assistant' || {Q.lit(_POST)} || {Q.lit(P.RESPONSE_MARKER)} || {RESPONSE_SQL} || "
            f"{Q.lit(LAYOUT.end)})")


def chat_frame(spark, sf_dir):
    rows = P.sft_rows(S.uncorrected_skip(history_steps(spark, sf_dir)), TPL)
    return P.chat_render(rows, LAYOUT)


@register("chat_render", ids=("P8",), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, {CHAT_SQL} AS text FROM hsteps WHERE is_corrected IS DISTINCT FROM false""")
def q_chat_render(spark, sf_dir):
    return chat_frame(spark, sf_dir).select("episode_id", "step", "text")


def _chat_sql(role: str, content: str) -> str:
    return f"({Q.lit(_PRE)} || '{role}' || {Q.lit(_POST)} || {content} || {Q.lit(LAYOUT.end)})"


CHOSEN_SQL = Q.render(TPL.output, {"reason": Q.shown("corrected_reason"), "action": Q.shown("corrected_action")})


@register("pref_chat_render", ids=("P8", "P4"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f"""
SELECT episode_id, step, {_chat_sql('user', PROMPT_SQL)} AS prompt, {_chat_sql('assistant', CHOSEN_SQL)} AS chosen,
       {_chat_sql('assistant', RESPONSE_SQL)} AS rejected
FROM hsteps WHERE is_corrected IS DISTINCT FROM false""")
def q_pref_chat_render(spark, sf_dir):
    rows = P.pref_rows(S.uncorrected_skip(history_steps(spark, sf_dir)), TPL)
    return P.pref_chat_render(rows, LAYOUT)


@register("completion_span", ids=("P9",), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + f""",
c AS (SELECT episode_id, step, {CHAT_SQL} AS text FROM hsteps WHERE is_corrected IS DISTINCT FROM false)
SELECT episode_id, step,
       CAST(CASE WHEN instr(text, {Q.lit(P.RESPONSE_MARKER)}) > 0
                 THEN instr(text, {Q.lit(P.RESPONSE_MARKER)}) + {len(P.RESPONSE_MARKER)} ELSE 0 END AS BIGINT) AS completion_start,
       CAST(CASE WHEN instr(text, {Q.lit(P.RESPONSE_MARKER)}) > 0
                 THEN length(text) - instr(text, {Q.lit(P.RESPONSE_MARKER)}) - {len(P.RESPONSE_MARKER)} + 1
                 ELSE 0 END AS BIGINT) AS completion_chars
FROM c""")
def q_completion_span(spark, sf_dir):
    c = chat_frame(spark, sf_dir)
    start, n = P.completion_span(F.col("text"))
    return c.select("episode_id", "step", start.alias("completion_start"), n.alias("completion_chars"))


@register("left_truncate", ids=("P10",), sql="""
WITH t AS (SELECT doc_id, text, regexp_split_to_array(text, '[ \\t\\n\\r\\f]+') AS toks FROM documents)
SELECT doc_id, CASE WHEN length(text) > 2000 THEN right(text, 2000) ELSE text END AS tail_chars,
       array_to_string(CASE WHEN len(toks) > 50 THEN toks[len(toks) - 49:] ELSE toks END, ' ') AS tail_tokens
FROM t""")
def q_left_truncate(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents
    return d.select("doc_id", P.left_truncate(F.col("text"), 2000).alias("tail_chars"),
                    P.left_truncate(F.col("text"), 50, unit="tokens").alias("tail_tokens"))


@register("pack_blocks", ids=("P11",), sql="""
SELECT doc_id, CAST(floor((sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                           - n_chars) / 100000) AS BIGINT) AS block
FROM documents""")
def q_pack_blocks(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents.select("doc_id", "n_chars")
    return P.pack_blocks(d, F.col("n_chars"), 100000, "doc_id", "doc_id").select("doc_id", "block")


@register("search_texts", ids=("P12",), sql=Q.with_(Q.GOALS) + """,
x AS (SELECT idx, [instruction] || list_transform(attributes, lambda a: a || ' ' || instruction) || [lower(instruction)] AS t
      FROM goals)
SELECT idx, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS search_text FROM x""")
def q_search_texts(spark, sf_dir):
    return P.search_texts(bind.goals(bind.Tables(spark, sf_dir).part))


@register("candidate_build", ids=("P13",), sql=Q.with_(Q.EVENT_CANDIDATES) + """,
c AS (SELECT episode_id, list_concat(candidate_actions, ['search', CAST(episode_id AS VARCHAR)]) AS clickables
      FROM ecands),
x AS (SELECT c.episode_id, list_transform(list_filter(c.clickables, lambda v: v <> 'search'),
               lambda v: 'click[' || CASE WHEN v = CAST(c.episode_id AS VARCHAR) AND p.p_partkey IS NOT NULL
                                          THEN 'item - ' || p.p_name ELSE v END || ']') AS clicks
      FROM c LEFT JOIN part p ON p.p_partkey = c.episode_id),
y AS (SELECT episode_id, CASE WHEN episode_id % 4 = 0 THEN ['search[<search query>]'] ELSE clicks END AS l
      FROM x)
SELECT episode_id, array_to_string(CASE WHEN len(l) = 0 THEN ['finish'] ELSE l END, ',') AS candidates
FROM y""")
def q_candidate_build(spark, sf_dir):
    from episodeflow.operators.candidates import candidate_build
    t = bind.Tables(spark, sf_dir)
    c = bind.event_candidates(t.events).select(
        "episode_id", F.concat("candidate_actions", F.array(F.lit("search"), F.col("episode_id").cast("string")))
        .alias("clickables"))
    # Items are shown by their title from the id -> title dictionary (join, then align titles).
    titles = t.part.select(F.col("p_partkey").alias("episode_id"), "p_name")
    j = c.join(titles, "episode_id", "left")
    titles = F.transform("clickables", lambda v: F.when(v == F.col("episode_id").cast("string"), F.col("p_name")))
    cands = candidate_build(F.col("clickables"), titles, F.col("episode_id") % 4 == 0)
    return j.select("episode_id", F.array_join(cands, ",").alias("candidates"))


DEMO_SQL = """
ev AS (SELECT user_id, event_id, event_type, props, value,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
demo AS (SELECT user_id, rn // 20 AS chunk, CAST(rn % 20 AS INTEGER) AS step, props AS observation,
                CASE WHEN value < 5 THEN [] ELSE [event_type, 'back'] END AS cands, event_type AS action_text,
                CASE WHEN value < 1 THEN -1 ELSE event_id % 3 END AS idx
         FROM ev)"""


@register("zip_demo", ids=("P14", "M4"), sql=Q.with_(DEMO_SQL) + """,
s AS (SELECT user_id, chunk, step, observation,
             CASE WHEN len(cands) = 0 THEN ['search[search query]'] ELSE cands END AS c, idx, action_text
      FROM demo),
a AS (SELECT *, CASE WHEN idx < 0 THEN action_text ELSE c[idx + 1] END AS action FROM s)
SELECT user_id, chunk, step, observation, array_to_string(c, ',') AS candidates, action,
       CASE WHEN action IS NULL THEN 'action index out of range' END AS reject_reason
FROM a""")
def q_zip_demo(spark, sf_dir):
    from episodeflow.operators.candidates import zip_demo
    ev = bind.Tables(spark, sf_dir).events
    # Event numbering per user with the skew-safe per-group rank (no per-user window).
    e = S.step_number(ev.select("user_id", "ts", "event_id", "event_type", "props", "value"),
                      "user_id", ["ts", "event_id"], "rn")
    # Parallel-array records, one per 20-event chunk of a user (bounded arrays).
    rec = F.struct(
        (F.col("rn") % 20).alias("step"), F.col("props").alias("state"),
        F.when(F.col("value") < 5, F.array().cast("array<string>"))
         .otherwise(F.array("event_type", F.lit("back"))).alias("avail"),
        F.col("event_type").alias("act"),
        F.when(F.col("value") < 1, F.lit(-1)).otherwise(F.col("event_id") % 3).cast("int").alias("idx"))
    demos = (e.groupBy("user_id", F.expr("rn div 20").alias("chunk"))
              .agg(F.array_sort(F.collect_list(rec)).alias("r"))
              .select("user_id", "chunk", F.col("r.state").alias("states"), F.col("r.avail").alias("available_actions"),
                      F.col("r.act").alias("actions"), F.col("r.idx").alias("action_idxs")))
    ok, rejects = zip_demo(demos, ["user_id", "chunk"])
    steps = ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects.drop("action_idx"))
    return steps.select("user_id", "chunk", "step", "observation", F.array_join("candidate_actions", ",").alias("candidates"),
                        "action", "reject_reason")


# --- P5 (state-extraction variant) with X3 JSON text --------------------------

EXTRACT_SYSTEM = "You read a trajectory and write down the hidden state it reveals."
_EXTRACT_ITEM = ("'{\"observation\": ' || " + Q.json_str("observation")
                 + " || ', \"candidate_actions\": ' || " + Q.json_list("candidate_actions")
                 + " || ', \"reason\": ' || " + Q.json_str("reason")
                 + " || ', \"action\": ' || " + Q.json_str("action")
                 + " || ', \"is_corrected\": ' || coalesce(CAST(is_corrected AS VARCHAR), 'null')"
                 + " || ', \"corrected_reason\": ' || " + Q.json_str("corrected_reason")
                 + " || ', \"corrected_action\": ' || " + Q.json_str("corrected_action") + " || '}'")


@register("extraction_request", ids=("P5", "X3"), sql=Q.with_(Q.TEXT_STEPS) + f""",
r AS (SELECT episode_id, '[' || string_agg({_EXTRACT_ITEM}, ', ' ORDER BY step) || ']' AS traj
      FROM tsteps GROUP BY episode_id)
SELECT episode_id, '{EXTRACT_SYSTEM}' AS system_content, 'Trajectory (JSON):' || chr(10) || traj AS user_content
FROM r""")
def q_extraction_request(spark, sf_dir):
    from episodeflow.functions.pytext import json_dict, json_list, json_str
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    item = F.struct("step", json_dict([
        ("observation", F.col("observation")),
        ("candidate_actions", json_list(F.col("candidate_actions"), json_str)),
        ("reason", F.col("reason")), ("action", F.col("action")), ("is_corrected", F.col("is_corrected")),
        ("corrected_reason", F.col("corrected_reason")), ("corrected_action", F.col("corrected_action"))],
        kinds={"candidate_actions": "raw", "is_corrected": "raw"}).alias("j"))  # every key of a step
    per_ep = st.groupBy("episode_id").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    traj = F.concat(F.lit("["), F.array_join(F.transform("_s", lambda x: x["j"]), ", "), F.lit("]"))
    return per_ep.select("episode_id", F.lit(EXTRACT_SYSTEM).alias("system_content"),
                         F.concat(F.lit("Trajectory (JSON):\n"), traj).alias("user_content"))
