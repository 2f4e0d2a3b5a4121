"""Oracle SQL text (DuckDB dialect) shared by the registered queries.

These strings restate each binding of ``bind.py`` in plain SQL so that an
independent engine can recompute every registered query.
"""

from __future__ import annotations


def py_str(x: str) -> str:
    """SQL for Python ``repr(str)`` (quote choice and the common escapes)."""
    esc = (f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), "
           f"chr(13), '\\r'), chr(9), '\\t')")
    return (f"(CASE WHEN {x} IS NULL THEN 'None' "
            f"WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END)")


def py_list(lst: str, render=py_str) -> str:
    return (f"(CASE WHEN {lst} IS NULL THEN 'None' ELSE "
            f"'[' || array_to_string(list_transform({lst}, lambda e: {render('e')}), ', ') || ']' END)")


def shown(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


TEXT_STEPS = """
turns AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
         max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS task
  FROM conversations),
pairs AS (
  SELECT conv_id AS episode_id,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS step,
         turn, task, text AS observation, next_text AS reason,
         split_part(next_text, chr(10), 1) AS action
  FROM turns WHERE role = 'user' AND next_role = 'assistant'),
tsteps AS (
  SELECT *,
         CASE WHEN episode_id % 3 = 0 THEN NULL
              WHEN (episode_id + turn) % 3 = 1 THEN false ELSE true END AS is_corrected,
         coalesce(lead(reason) OVER (PARTITION BY episode_id ORDER BY step), reason) AS corrected_reason,
         coalesce(lead(action) OVER (PARTITION BY episode_id ORDER BY step), action) AS corrected_action,
         CASE WHEN lag(action) OVER (PARTITION BY episode_id ORDER BY step) IS NULL THEN [action]
              ELSE [lag(action) OVER (PARTITION BY episode_id ORDER BY step), action] END AS candidate_actions
  FROM pairs)"""

SCORED_STEPS = """
ssteps AS (
  SELECT user_id AS episode_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step,
         event_id, ts, props AS observation, event_type AS action, value AS score
  FROM events)"""

EVENT_CANDIDATES = """
ecands AS (
  SELECT user_id AS episode_id,
         list_filter(list_sort(list(DISTINCT event_type)), lambda x, i: i - 1 <> user_id % 5) AS candidate_actions
  FROM events GROUP BY user_id)"""

STATE = """
state AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS state FROM supplier)"""

SUMMARIES = """
summ AS (
  SELECT o_custkey AS env_idx, o_orderstatus AS model_id, count(*) AS num_actions,
         floor(avg(o_totalprice) / 50000) / 10 AS score
  FROM orders GROUP BY o_custkey, o_orderstatus)"""

GOALS = """
goals AS (
  SELECT p_partkey AS idx, p_name AS instruction,
         [p_brand, p_type, CAST(p_size AS VARCHAR)] AS attributes,
         p_retailprice AS price_upper, p_type AS category
  FROM part)"""

def request_item() -> str:
    """A step as a teacher request shows it (Python text of a dict)."""
    return ("'{''timestep'': ' || CAST(step AS VARCHAR) || ', ''observation'': ' || " + py_str("observation")
            + " || ', ''candidate_actions'': ' || " + py_list("candidate_actions")
            + " || ', ''reason'': ' || " + py_str("reason") + " || ', ''action'': ' || " + py_str("action")
            + " || '}'")


HISTORY_ITEM = ("'{''observation'': ' || " + py_str("e.observation")
                + " || ', ''action'': ' || " + py_str("e.action") + " || '}'")


def history_text(lst: str) -> str:
    return (f"coalesce('[' || array_to_string(list_transform({lst}, lambda e: {HISTORY_ITEM}), ', ') || ']', '[]')")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render(text: str, slots: dict[str, str]) -> str:
    """SQL twin of ``operators.prompts.render``."""
    import string

    parts = []
    for literal, name, _spec, _conv in string.Formatter().parse(text):
        if literal:
            parts.append(lit(literal))
        if name is not None:
            parts.append(f"({slots[name]})")
    return "(" + " || ".join(parts) + ")"


def ws_class() -> str:
    from episodeflow.functions.parsers import WS
    return WS


def ws_chars() -> str:
    from episodeflow.functions.parsers import PY_WHITESPACE
    return lit(PY_WHITESPACE)


RESPONSES = """
resp AS (
  SELECT e.event_id,
         (CASE WHEN e.event_id % 7 = 0 THEN coalesce(d.w, e.props) ELSE 'REASON: ' || coalesce(d.w, e.props) END) || chr(10) ||
         (CASE WHEN e.event_id % 11 = 0
               THEN 'ACTION: ```bash' || chr(10) || e.event_type || '!' || chr(10) || '```'
               ELSE 'ACTION: ' || e.event_type || '!' END) AS response
  FROM events e
  LEFT JOIN (SELECT doc_id, text AS w FROM documents) d
    ON d.doc_id = e.event_id)"""

ANSWERS = """
ans AS (
  SELECT episode_id, step,
         true AS has_corrected_reason, corrected_reason,
         NOT (episode_id % 7 = 2 AND step = 0) AS has_corrected_action,
         CASE WHEN NOT (episode_id % 7 = 2 AND step = 0) THEN corrected_action END AS corrected_action,
         step % 2 = 0 AS has_original_reason,
         CASE WHEN step % 2 = 0 AND (episode_id + step) % 4 <> 0 THEN reason END AS original_reason,
         episode_id % 2 = 0 AS has_candidate_actions,
         CASE WHEN episode_id % 2 = 0 THEN list_concat(candidate_actions, [corrected_action]) END AS a_candidate_actions,
         is_corrected IS NOT NULL AS has_is_corrected, is_corrected
  FROM (SELECT *, max(step) OVER (PARTITION BY episode_id) AS last_step FROM tsteps)
  WHERE NOT (episode_id % 5 = 1 AND step = last_step AND last_step > 0) AND episode_id % 13 <> 5),
judged AS (
  SELECT s.episode_id,
         CASE WHEN s.n <> coalesce(a.m, 0) THEN 'length mismatch'
              WHEN a.all_r = 0 THEN 'missing corrected_reason'
              WHEN a.all_a = 0 THEN 'missing corrected_action' END AS reject_reason
  FROM (SELECT episode_id, count(*) AS n FROM tsteps GROUP BY episode_id) s
  LEFT JOIN (SELECT episode_id, count(*) AS m, min(CAST(has_corrected_reason AS INTEGER)) AS all_r,
               min(CAST(has_corrected_action AS INTEGER)) AS all_a
        FROM ans GROUP BY episode_id) a USING (episode_id))"""


def _chr(c: str) -> str:
    return f"chr({ord(c)})" if ord(c) < 32 else lit(c)


def json_str(x: str) -> str:
    """SQL for Python ``json.dumps(str)`` (ASCII escapes, surrogate pairs above FFFF)."""
    esc = x
    for raw, shown in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                       ("\b", "\\b"), ("\f", "\\f")]:
        esc = f"replace({esc}, {_chr(raw)}, {lit(shown)})"
    per = ("CASE WHEN unicode(ch) BETWEEN 32 AND 126 THEN ch "
           "WHEN unicode(ch) > 65535 THEN '\\u' || lower(hex(55296 + (unicode(ch) - 65536) // 1024)) "
           "|| '\\u' || lower(hex(56320 + (unicode(ch) - 65536) % 1024)) "
           "ELSE '\\u' || lpad(lower(hex(unicode(ch))), 4, '0') END")
    return (f"(CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || "
            f"array_to_string(list_transform(string_split({esc}, ''), lambda ch: {per}), '') || '\"' END)")


def json_list(lst: str, render=json_str) -> str:
    return (f"(CASE WHEN {lst} IS NULL THEN 'null' ELSE "
            f"'[' || array_to_string(list_transform({lst}, lambda e: {render('e')}), ', ') || ']' END)")
