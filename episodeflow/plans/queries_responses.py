"""Registered response jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.functions import parsers as R
from episodeflow.functions.pytext import py_list_of
from episodeflow.operators import correct as C
from episodeflow.operators import responses as RS
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.registry import register

WS = Q.ws_class()
WSC = Q.ws_chars()


def _s_reason(t: str, r: str = "REASON:", a: str = "ACTION:") -> str:
    pat = f"'(?s){r}{WS}*(.*?){WS}*{a}'"
    return f"(CASE WHEN regexp_matches({t}, {pat}) THEN trim(regexp_extract({t}, {pat}, 1), {WSC}) ELSE {t} END)"


def _s_line(t: str, a: str = "ACTION:") -> str:
    return f"trim(regexp_extract({t}, '{a}{WS}*([^\\n]+)', 1), {WSC})"


def _s_clean(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9 /]', '', 'g')"


def _s_shell_action(t: str) -> str:
    pat = f"'(?s)ACTION:{WS}*```[a-zA-Z]*{WS}*(.*?){WS}*```'"
    return (f"(CASE WHEN regexp_matches({t}, {pat}) THEN trim(regexp_extract({t}, {pat}, 1), {WSC}) "
            f"ELSE {_s_line(t)} END)")


def _s_status(t: str, action: str, r: str = "REASON:", a: str = "ACTION:") -> str:
    return (f"(CASE WHEN {action} = '' THEN 'no_action' "
            f"WHEN NOT regexp_matches({t}, '(?s){r}.*{a}') THEN 'no_reason' ELSE 'ok' END)")


SHELL_T = "replace(response, '\\n', chr(10))"
CORR_T = "replace(replace(response, 'REASON:', 'CORRECTED_REASON:'), 'ACTION:', 'CORRECTED_ACTION:')"

_DIALECT_SQL = {
    "game": ("response", _s_reason("response"), _s_clean(_s_line("response")), "REASON:", "ACTION:"),
    "shop": ("response", _s_reason("response"), _s_line("response"), "REASON:", "ACTION:"),
    "shell": (SHELL_T, _s_reason(SHELL_T), _s_shell_action(SHELL_T), "REASON:", "ACTION:"),
    "sql": (SHELL_T, _s_reason(SHELL_T),
            f"(CASE WHEN contains(split_part({_s_shell_action(SHELL_T)}, chr(10), 1), ';') "
            f"THEN split_part(split_part({_s_shell_action(SHELL_T)}, chr(10), 1), ';', 1) || ';' "
            f"ELSE split_part({_s_shell_action(SHELL_T)}, chr(10), 1) END)", "REASON:", "ACTION:"),
    "corrected": (CORR_T, _s_reason(CORR_T, "CORRECTED_REASON:", "CORRECTED_ACTION:"),
                  _s_clean(_s_line(CORR_T, "CORRECTED_ACTION:")), "CORRECTED_REASON:", "CORRECTED_ACTION:"),
}


def _parse_sql(dialect: str) -> str:
    t, reason, action, r, a = _DIALECT_SQL[dialect]
    status_src = "response" if dialect != "corrected" else CORR_T
    return Q.with_(Q.RESPONSES) + f"""
SELECT event_id, {reason} AS reason, {action} AS action, {_s_status(status_src, action, r, a)} AS status
FROM resp"""


def _responses(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    return bind.responses(t.events, t.documents)


def _make_parse(dialect: str, key: str, rids: tuple[str, ...]):
    @register(key, ids=(*rids, "U1"), sql=_parse_sql(dialect))
    def q(spark, sf_dir):
        df = _responses(spark, sf_dir)
        if dialect == "corrected":
            df = df.withColumn("response", F.replace(F.replace(
                "response", F.lit("REASON:"), F.lit("CORRECTED_REASON:")),
                F.lit("ACTION:"), F.lit("CORRECTED_ACTION:")))
        return RS.parse_responses(df, dialect).select("event_id", "reason", "action", "status")
    return q


for _d, _k, _id in [("game", "parse_game", ("R1", "X1", "X4", "X6")), ("shop", "parse_shop", ("R2",)),
                    ("shell", "parse_shell", ("R3", "X7")), ("sql", "parse_sql", ("R4",)),
                    ("corrected", "parse_corrected", ("R5",))]:
    _make_parse(_d, _k, _id)


# --- JSON blocks -------------------------------------------------------------

FENCED_SQL = """
fenced AS (
  SELECT doc_id,
         'Here is the answer:' || chr(10) || '```json' || chr(10) ||
         '{"id": ' || CAST(doc_id AS VARCHAR) || ', "lang": "' || lang || '", ' || chr(10) ||
         '  "note": "say \\"hi\\" to C:\\\\dir",' || chr(10) ||
         '  "text": "' || replace(text, '"', '') || '",' || chr(10) || '}' ||
         CASE WHEN doc_id % 3 = 0 THEN '```' ELSE chr(10) || '```' END AS response
  FROM documents)"""


def fenced(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents
    nl = F.lit("\n")
    whole = F.replace(F.col("text"), F.lit('"'), F.lit(""))
    body = F.concat(
        F.lit("Here is the answer:"), nl, F.lit("```json"), nl,
        F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), F.col("lang"), F.lit('", '), nl,
        F.lit('  "note": "say \\"hi\\" to C:\\\\dir",'), nl,
        F.lit('  "text": "'), whole, F.lit('",'), nl, F.lit("}"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("```")).otherwise(F.concat(nl, F.lit("```"))))
    return d.select("doc_id", body.alias("response"))


def _s_block(t: str) -> str:
    pat = "'```json\\n([\\s\\S]*?)\\n```'"
    return f"(CASE WHEN regexp_matches({t}, {pat}) THEN regexp_extract({t}, {pat}, 1) END)"


def _s_repair(b: str) -> str:
    s = f"replace({b}, '\\\"', '''')"
    s = f"replace({s}, '\\', '\\\\')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, ',{WS}*}}', '}}', 'g')"
    s = f"regexp_replace({s}, ',{WS}*]', ']', 'g')"
    return s


@register("json_block", ids=("R6",), sql=Q.with_(FENCED_SQL) + f"""
SELECT doc_id, {_s_block('response')} AS block FROM fenced""")
def q_json_block(spark, sf_dir):
    return fenced(spark, sf_dir).select("doc_id", R.json_block(F.col("response")).alias("block"))


@register("json_repair", ids=("R7",), sql=Q.with_(FENCED_SQL) + f"""
SELECT doc_id, {_s_repair(_s_block('response'))} AS repaired FROM fenced""")
def q_json_repair(spark, sf_dir):
    b = R.json_block(F.col("response"))
    return fenced(spark, sf_dir).select("doc_id", R.json_repair(b).alias("repaired"))


@register("json_parse", ids=("R8", "X21"), sql="""
WITH x AS (SELECT event_id, event_id % 5 AS r, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN r = 2 THEN 7 WHEN r = 0 THEN k END AS k, r IN (0, 2) AS has_k,
       CASE WHEN r IN (1, 3) THEN 'invalid_json' ELSE 'ok' END AS status
FROM x""")
def q_json_parse(spark, sf_dir):
    """Answers by event number: whole, cut off, with a repeated key, with trailing text, without the key but with NaN."""
    ev = bind.Tables(spark, sf_dir).events
    r, props = F.col("event_id") % 5, F.col("props")
    text = (F.when(r == 1, F.substr(props, F.lit(1), F.length(props) - 1)).when(r == 2, F.lit('{"k": 1, "k": 7}'))
             .when(r == 3, F.concat(props, F.lit(" more"))).when(r == 4, F.lit('{"n": NaN}')).otherwise(props))
    rows = ev.select("event_id", text.alias("t")).withColumn("ok", RS.json_valid(F.col("t")))
    parsed = F.when(F.col("ok"), F.from_json("t", "k long"))
    keys = F.when(F.col("ok"), F.map_keys(F.from_json("t", "map<string,string>")))
    return rows.select(
        "event_id", parsed["k"].alias("k"), F.coalesce(F.array_contains(keys, "k"), F.lit(False)).alias("has_k"),
        F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("invalid_json")).alias("status"))


@register("task_extract", ids=("R10",), sql="""
WITH x AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0
                      THEN text || chr(10) || chr(10) || 'Your task is to: ' || lang ||
                           ' ' || source || chr(10) || 'more'
                      ELSE text END AS obs
  FROM documents)
SELECT doc_id, regexp_extract(obs, '\\n\\nYour task is to: ([^\\n]*)', 1) AS task FROM x""")
def q_task_extract(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents
    obs = F.when(F.col("doc_id") % 2 == 0, F.concat(
        F.col("text"), F.lit("\n\nYour task is to: "), F.col("lang"), F.lit(" "),
        F.col("source"), F.lit("\nmore"))).otherwise(F.col("text"))
    return d.select("doc_id", R.task_extract(obs).alias("task"))


@register("path_key", ids=("R11",), sql="""
SELECT page_id, CASE WHEN instr(url, 'example.com/') > 0
                     THEN substr(url, instr(url, 'example.com/') + 12) END AS path_key
FROM pages""")
def q_path_key(spark, sf_dir):
    p = bind.Tables(spark, sf_dir).pages
    return p.select("page_id", R.path_key(F.col("url"), "example.com/").alias("path_key"))


# --- answers: validation, merge, flags ---------------------------------------

def _steps_answers(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    return st, bind.answers(st)


@register("validate_answer", ids=("R12",), sql=Q.with_(Q.TEXT_STEPS, Q.ANSWERS) + """
SELECT episode_id, coalesce(reject_reason, 'ok') AS status FROM judged""")
def q_validate_answer(spark, sf_dir):
    st, ans = _steps_answers(spark, sf_dir)
    good, rejects = C.validate_answers(ans, st)
    ok = good.select("episode_id").distinct().withColumn("status", F.lit("ok"))
    return ok.unionByName(rejects.select("episode_id", F.col("reject_reason").alias("status")))


MERGED_SQL = Q.with_(Q.TEXT_STEPS, Q.ANSWERS) + """,
merged AS (
  SELECT a.episode_id, a.step, s.observation AS original_observation,
         CASE WHEN a.has_original_reason THEN a.original_reason ELSE s.reason END AS original_reason,
         s.action AS original_action, a.corrected_reason, a.corrected_action,
         CASE WHEN s.candidate_actions IS NULL THEN a.a_candidate_actions
              WHEN a.has_candidate_actions THEN a.a_candidate_actions ELSE s.candidate_actions END AS candidate_actions,
         s.candidate_actions IS NOT NULL AS rollout_has_cands, a.has_is_corrected, a.is_corrected
  FROM ans a JOIN tsteps s USING (episode_id, step)
  WHERE a.episode_id IN (SELECT episode_id FROM judged WHERE reject_reason IS NULL)),
flagged AS (
  SELECT *, CASE WHEN rollout_has_cands AND has_is_corrected
                      AND NOT coalesce(list_contains(candidate_actions, corrected_action), false)
                 THEN false ELSE is_corrected END AS flag
  FROM merged)"""


def _merged(spark, sf_dir):
    st, ans = _steps_answers(spark, sf_dir)
    good, _ = C.validate_answers(ans, st)
    return C.correction_merge(st, good)


@register("correction_merge", ids=("J3",), sql=MERGED_SQL + f"""
SELECT episode_id, step, original_observation, original_reason, original_action, corrected_reason,
       corrected_action, {Q.py_list('candidate_actions')} AS candidates_text, flag AS is_corrected
FROM flagged""")
def q_correction_merge(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.select("episode_id", "step", "original_observation", "original_reason", "original_action",
                    "corrected_reason", "corrected_action",
                    py_list_of("candidate_actions").alias("candidates_text"), "is_corrected")


@register("teacher_flag", ids=("R13",), sql=MERGED_SQL + """
SELECT episode_id, step, has_is_corrected, flag AS is_corrected FROM flagged""")
def q_teacher_flag(spark, sf_dir):
    return _merged(spark, sf_dir).select("episode_id", "step", "has_is_corrected", "is_corrected")


@register("self_flag", ids=("R14",), sql=Q.with_(Q.TEXT_STEPS) + """,
x AS (SELECT episode_id, step, action,
             CASE WHEN step % 3 = 2 THEN 'search[' || split_part(observation, ' ', 1) || ']'
                  ELSE corrected_action END AS new_action,
             CASE WHEN episode_id % 2 = 0 THEN list_append(candidate_actions, corrected_action)
                  ELSE candidate_actions END AS cands
      FROM tsteps)
SELECT episode_id, step,
       CASE WHEN new_action = action THEN false
            WHEN NOT coalesce(list_contains(cands, new_action), false)
                 AND NOT contains(new_action, 'search') THEN false
            ELSE true END AS is_corrected
FROM x""")
def q_self_flag(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    # The student's self-correction: every third step proposes a search, others the next action;
    # even episodes also list the proposed action among the candidates.
    new = F.when(F.col("step") % 3 == 2, F.concat(F.lit("search["), F.substring_index("observation", " ", 1),
                                                  F.lit("]"))).otherwise(F.col("corrected_action"))
    cands = F.when(F.col("episode_id") % 2 == 0,
                   F.array_append("candidate_actions", F.col("corrected_action"))).otherwise(F.col("candidate_actions"))
    return st.select("episode_id", "step", C.self_flag(F.col("action"), new, cands).alias("is_corrected"))


@register("candidate_check", ids=("J12", "X14"), sql=Q.with_(Q.TEXT_STEPS) + """
SELECT episode_id, step, coalesce(list_contains(candidate_actions, corrected_action), false) AS in_candidates,
       CAST(len(candidate_actions) AS BIGINT) AS n_candidates
FROM tsteps""")
def q_candidate_check(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    return st.select("episode_id", "step",
                     C.candidate_check(F.col("corrected_action"), F.col("candidate_actions")).alias("in_candidates"),
                     F.size("candidate_actions").cast("long").alias("n_candidates"))


# --- the correction job from fenced answers to corrections and rejects --------

def _s_parsed(x: str) -> str:
    """A text after json.dumps, the repair rules and parsing (repair keeps the escapes as text)."""
    s = f"replace({Q.json_str(x)}, '\\\"', '''')"
    s = f"regexp_replace({s}, '{WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, ',{WS}*}}', '}}', 'g')"
    s = f"regexp_replace({s}, ',{WS}*]', ']', 'g')"
    return f"regexp_replace({s}, '^\"|\"$', '', 'g')"


CORRECT_SQL = Q.with_(Q.TEXT_STEPS) + """,
eps AS (SELECT episode_id, count(*) AS n FROM tsteps GROUP BY episode_id),
verdicts AS (SELECT episode_id, CASE WHEN episode_id % 13 = 5 THEN 'no answer' WHEN episode_id % 11 = 3 THEN 'invalid_json'
       WHEN episode_id % 11 = 5 THEN 'missing summary' WHEN episode_id % 5 = 1 AND n > 1 THEN 'length mismatch'
       WHEN episode_id % 7 = 2 AND episode_id % 3 <> 0 THEN 'missing corrected_action' END AS reject_reason FROM eps)"""


def _correct(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    return C.correct_job(bind.correction_responses(st), st, 3)


@register("correct_pipeline", ids=("J3", "R6", "R7", "R8", "R12", "R13", "W6", "X21"), sql=CORRECT_SQL + f""",
c AS (SELECT t.*, {_s_parsed('t.corrected_reason')} AS cr,
             CASE WHEN t.episode_id % 7 = 2 AND t.step = 0 THEN 'zzz' ELSE {_s_parsed('t.corrected_action')} END AS ca,
             {_s_parsed('t.reason')} AS pr
      FROM tsteps t JOIN verdicts v USING (episode_id) WHERE v.reject_reason IS NULL)
SELECT episode_id, step, CASE WHEN episode_id % 11 = 4 THEN 2 ELSE 1 END AS attempt,
       'episode ' || CAST(episode_id AS VARCHAR) AS summary, observation AS original_observation,
       CASE WHEN step % 2 = 0 THEN pr ELSE reason END AS original_reason, action AS original_action,
       cr AS corrected_reason, ca AS corrected_action, {Q.py_list('candidate_actions')} AS candidates_text,
       CASE WHEN is_corrected IS NOT NULL AND NOT list_contains(candidate_actions, ca) THEN false ELSE is_corrected END AS is_corrected
FROM c""")
def q_correct_pipeline(spark, sf_dir):
    good, _ = _correct(spark, sf_dir)
    return good.select("episode_id", "step", "attempt", "summary", "original_observation", "original_reason", "original_action",
                       "corrected_reason", "corrected_action", py_list_of("candidate_actions").alias("candidates_text"), "is_corrected")


@register("correct_rejects", ids=("R12", "X21"), sql=CORRECT_SQL + """
SELECT episode_id, reject_reason FROM verdicts WHERE reject_reason IS NOT NULL""")
def q_correct_rejects(spark, sf_dir):
    return _correct(spark, sf_dir)[1]


def _trajectory_json(spark, sf_dir):
    """A fenced JSON answer per conversation, with a fault of each kind by its number."""
    from episodeflow.functions.pytext import json_dict
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    item = F.struct("step", json_dict([("reason", F.col("reason")), ("action", F.col("action"))]).alias("j"))
    per = st.groupBy("episode_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    e = F.col("episode_id")
    traj = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ", "), F.lit("]"))
    body = (F.when(e % 5 == 1, F.lit('{"answer": 1}')).when(e % 5 == 2, F.lit('{"trajectory": ["text"]}'))
             .otherwise(F.concat(F.lit('{"trajectory": '), traj, F.lit("}"))))
    return per.select("episode_id", F.when(e % 5 == 3, F.lit("no block")).otherwise(
        F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("response"))


@register("trajectory_answers", ids=("R9",), sql=Q.with_(Q.TEXT_STEPS) + """
SELECT episode_id, CASE WHEN episode_id % 5 = 3 THEN 'no_block' WHEN episode_id % 5 IN (1, 2) THEN 'not_a_list_of_objects' ELSE 'ok' END AS status,
       CAST(CASE WHEN episode_id % 5 IN (1, 2, 3) THEN 0 ELSE count(*) END AS INTEGER) AS n_steps
FROM tsteps GROUP BY episode_id""")
def q_trajectory_answers(spark, sf_dir):
    rows = RS.trajectory_answers(_trajectory_json(spark, sf_dir))
    return rows.select("episode_id", "status", F.greatest(F.coalesce(F.size("trajectory"), F.lit(0)), F.lit(0)).alias("n_steps"))
