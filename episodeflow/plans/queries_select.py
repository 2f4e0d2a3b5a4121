"""Registered selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.functions.pytext import py_list_of
from episodeflow.operators import steps as S
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.queries_prompts import HIST_CTE, history_steps
from episodeflow.plans.registry import register

EP_SQL = "SELECT episode_id, count(*) AS n_steps, arg_max(score, step) AS last_score FROM ssteps"


def scored(spark, sf_dir):
    return bind.scored_steps(bind.Tables(spark, sf_dir).events)


def scored_episodes(spark, sf_dir):
    return bind.scored_episodes(bind.Tables(spark, sf_dir).events)


@register("episode_summary", ids=("A1",), sql=Q.with_(Q.SCORED_STEPS) + """,
e AS (SELECT episode_id, count(*) AS n_steps, arg_max(score, step) AS last_score FROM ssteps GROUP BY episode_id)
SELECT c.c_custkey AS episode_id, coalesce(e.n_steps, 0) AS num_actions, coalesce(e.last_score, 0.0) AS score
FROM customer c LEFT JOIN e ON e.episode_id = c.c_custkey""")
def q_episode_summary(spark, sf_dir):
    """Every customer starts an episode; one without events has no steps."""
    started = bind.Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("episode_id"))
    e = S.with_empty(started, scored_episodes(spark, sf_dir))
    return e.select("episode_id", F.col("n_steps").alias("num_actions"), F.coalesce("last_score", F.lit(0.0)).alias("score"))


@register("score_filter", ids=("F1", "X11"), sql=Q.with_(Q.SCORED_STEPS) + EP_SQL + """
GROUP BY episode_id HAVING arg_max(score, step) >= 50.0""")
def q_score_filter(spark, sf_dir):
    return S.score_filter(scored_episodes(spark, sf_dir), 50.0)


@register("length_filter", ids=("F2",), sql=Q.with_(Q.SCORED_STEPS) + EP_SQL + """
GROUP BY episode_id HAVING count(*) <= 70""")
def q_length_filter(spark, sf_dir):
    return S.length_filter(scored_episodes(spark, sf_dir), 70)


@register("skip_missing", ids=("F3",), sql="""
SELECT d.doc_id, l.quality AS trajectory, CASE WHEN l.quality IS NULL THEN 'no trajectory' END AS reject_reason
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_skip_missing(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    eps = t.documents.select("doc_id").join(
        t.labels.select("doc_id", F.col("quality").alias("trajectory")), "doc_id", "left")
    ok, rejects = S.skip_missing(eps, "trajectory")
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)


@register("uncorrected_skip", ids=("F4", "X20"), sql=Q.with_(Q.TEXT_STEPS, HIST_CTE) + """
SELECT episode_id, step, is_corrected, CAST(coalesce(len(history), 0) AS BIGINT) AS n_history
FROM hsteps WHERE is_corrected IS DISTINCT FROM false""")
def q_uncorrected_skip(spark, sf_dir):
    h = S.uncorrected_skip(history_steps(spark, sf_dir))
    return h.select("episode_id", "step", "is_corrected", F.col("n_history").cast("long").alias("n_history"))


@register("failed_select", ids=("F5", "J8"), sql=Q.with_(Q.SCORED_STEPS) + """,
failed AS (SELECT episode_id FROM ssteps GROUP BY episode_id HAVING arg_max(score, step) <= 25.0)
SELECT episode_id, step, action FROM ssteps WHERE episode_id IN (SELECT episode_id FROM failed)""")
def q_failed_select(spark, sf_dir):
    """The steps of failed episodes, a semi join on the episode."""
    summ = scored_episodes(spark, sf_dir).withColumnRenamed("last_score", "score")
    ids = S.failed_select(summ, 25.0).select("episode_id")
    return S.id_subset(scored(spark, sf_dir), ids, "episode_id").select("episode_id", "step", "action")


@register("start_index", ids=("F6",), sql=Q.with_(Q.SCORED_STEPS) + """
SELECT episode_id AS env_idx, count(*) AS n_steps, episode_id > 40 AS after_start_strict
FROM ssteps WHERE episode_id >= 40 GROUP BY episode_id""")
def q_start_index(spark, sf_dir):
    e = scored_episodes(spark, sf_dir).withColumnRenamed("episode_id", "env_idx")
    kept = S.start_index(e, 40, "env_idx", inclusive=True)
    return kept.select("env_idx", "n_steps", S.after_start(F.col("env_idx"), 40, inclusive=False).alias("after_start_strict"))


@register("id_subset", ids=("F7",), sql=Q.with_(Q.SCORED_STEPS) + EP_SQL + """
WHERE episode_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY episode_id""")
def q_id_subset(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    ids = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("episode_id"))
    return bind.scored_episodes(S.id_subset(t.events, ids.withColumnRenamed("episode_id", "user_id"), "user_id"))


@register("goal_ranges", ids=("F8",), sql=Q.with_(Q.GOALS) + """
SELECT idx, CASE WHEN idx < 500 THEN 'test' WHEN idx < 1500 THEN 'eval' ELSE 'train' END AS split
FROM goals""")
def q_goal_ranges(spark, sf_dir):
    return S.goal_ranges(bind.goals(bind.Tables(spark, sf_dir).part)).select("idx", "split")


@register("field_remap", ids=("F9",), sql=Q.with_(Q.TEXT_STEPS) + """
SELECT episode_id, step, observation, corrected_reason AS reason, corrected_action AS action FROM tsteps""")
def q_field_remap(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    return S.field_remap(st, {"observation": "observation", "reason": "corrected_reason",
                              "action": "corrected_action"}, keep=("episode_id", "step"))


@register("optional_defaults", ids=("F10",), sql=f"""
WITH x AS (
  SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL
                        ELSE [CAST(l.quality AS VARCHAR), CAST(l.toxic AS VARCHAR)] END AS cands,
         CASE WHEN l.toxic = 1 THEN d.lang END AS task
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN cands IS NULL THEN '' ELSE {Q.py_list('cands')} END AS candidates_text,
       coalesce(task, '') AS task_text
FROM x""")
def q_optional_defaults(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    x = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    cands = F.when(F.col("quality").isNull(), F.lit(None)).otherwise(
        F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")))
    task = F.when(F.col("toxic") == 1, F.col("lang"))
    x = x.withColumn("_cands", cands)
    return x.select("doc_id",
                    F.when(F.col("_cands").isNull(), F.lit("")).otherwise(py_list_of("_cands")).alias("candidates_text"),
                    S.optional_default(task, "").alias("task_text"))


@register("step_cap", ids=("F12",), sql=Q.with_(Q.SCORED_STEPS) + """
SELECT episode_id, step, action FROM ssteps WHERE step < 20""")
def q_step_cap(spark, sf_dir):
    rows = bind.scored_rows(bind.Tables(spark, sf_dir).events).select("episode_id", "event_id", "ts", "action")
    return S.first_steps(rows, 20, ("ts", "event_id")).select("episode_id", "step", "action")


@register("episode_cap", ids=("F13",), sql=Q.with_(Q.SCORED_STEPS) + EP_SQL + """
GROUP BY episode_id ORDER BY episode_id LIMIT 25""")
def q_episode_cap(spark, sf_dir):
    return S.episode_cap(scored_episodes(spark, sf_dir), 25)


@register("conditional_ban", ids=("F14",), sql=Q.with_(Q.SCORED_STEPS, Q.EVENT_CANDIDATES) + """,
sel AS (SELECT episode_id, count(DISTINCT action) AS selected FROM ssteps GROUP BY episode_id)
SELECT c.episode_id,
       array_to_string(list_filter(c.candidate_actions,
           lambda x: x <> 'purchase' OR s.selected = p.p_size % 5 + 1), ',') AS candidates_text
FROM ecands c JOIN sel s USING (episode_id) JOIN part p ON p.p_partkey = c.episode_id""")
def q_conditional_ban(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    sel = (t.events.groupBy(F.col("user_id").alias("episode_id"))
           .agg(F.count_distinct("event_type").alias("selected")))
    opts = t.part.select(F.col("p_partkey").alias("episode_id"), (F.col("p_size") % 5 + 1).alias("total"))
    j = bind.event_candidates(t.events).join(sel, "episode_id").join(opts, "episode_id")
    kept = S.conditional_ban(F.col("candidate_actions"), F.col("selected"), F.col("total"), "purchase")
    return j.select("episode_id", F.array_join(kept, ",").alias("candidates_text"))


@register("step_number", ids=("W2",), sql=Q.with_(Q.SCORED_STEPS) + """
SELECT episode_id, event_id, step FROM ssteps""")
def q_step_number(spark, sf_dir):
    ev = bind.Tables(spark, sf_dir).events.select("user_id", "ts", "event_id")
    return (S.step_number(ev, "user_id", ["ts", "event_id"])
             .select(F.col("user_id").alias("episode_id"), "event_id", "step"))


@register("episode_split", ids=("W4", "X13"), sql=Q.with_(Q.TEXT_STEPS) + """,
eps AS (SELECT DISTINCT episode_id FROM tsteps),
r AS (SELECT episode_id,
             row_number() OVER (ORDER BY md5('42:' || CAST(episode_id AS VARCHAR)), episode_id) AS rk,
             count(*) OVER () AS n
      FROM eps)
SELECT episode_id, CASE WHEN rk <= floor(n * 0.85) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_episode_split(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    eps = st.select("episode_id").distinct()
    return S.episode_split(eps, "episode_id", 0.85, 42).select("episode_id", "split")


@register("prefix_split", ids=("W5", "X13"), sql="""
WITH r AS (SELECT p_partkey AS idx, row_number() OVER (ORDER BY p_partkey) AS rk, count(*) OVER () AS n
           FROM part)
SELECT idx, CASE WHEN rk <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_prefix_split(spark, sf_dir):
    items = bind.Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("idx"))
    return S.prefix_split(items, "idx", 0.7).select("idx", "split")


@register("first_valid_attempt", ids=("W6",), sql="""
WITH a AS (SELECT user_id AS request_id, event_type AS kind, event_id, value > 5 AS valid,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt
           FROM events)
SELECT request_id, kind, min(attempt) AS attempt, arg_min(event_id, attempt) AS event_id
FROM a WHERE valid AND attempt <= 3 GROUP BY request_id, kind""")
def q_first_valid_attempt(spark, sf_dir):
    att = bind.attempts(bind.Tables(spark, sf_dir).events).select(
        "request_id", "kind", "attempt", "valid", "event_id")
    return (S.first_valid_attempt(att, 3, ("request_id", "kind"))
             .select("request_id", "kind", F.col("attempt").cast("long").alias("attempt"), "event_id"))


@register("prev_observation", ids=("W7",), sql=Q.with_(Q.SCORED_STEPS) + """
SELECT episode_id, step, lag(observation) OVER (PARTITION BY episode_id ORDER BY step) AS prev_observation
FROM ssteps""")
def q_prev_observation(spark, sf_dir):
    rows = bind.scored_rows(bind.Tables(spark, sf_dir).events).select("episode_id", "event_id", "ts", "observation")
    return (S.prev_observation(rows, order=("ts", "event_id"), number="step")
             .select("episode_id", "step", "prev_observation"))


@register("episode_truncate", ids=("W8",), sql=Q.with_(Q.SCORED_STEPS) + """,
d AS (SELECT *, coalesce(max(CAST(action = 'purchase' AS INTEGER)) OVER (
          PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done_before
      FROM ssteps)
SELECT episode_id, step, action FROM d WHERE done_before = 0 AND step < 100""")
def q_episode_truncate(spark, sf_dir):
    rows = bind.scored_rows(bind.Tables(spark, sf_dir).events).select("episode_id", "event_id", "ts", "action")
    return (S.episode_truncate(rows, F.col("action") == "purchase", 100, order=("ts", "event_id"), number="step")
             .select("episode_id", "step", "action"))
