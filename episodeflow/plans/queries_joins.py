"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.operators import correct as C
from episodeflow.operators import metering as M
from episodeflow.operators import metrics as MT
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.registry import register


@register("state_lookup", ids=("J1", "M5"), sql=Q.with_(Q.SCORED_STEPS, Q.STATE) + """
SELECT e.episode_id, e.n_steps, s.state, s.state IS NOT NULL AS has_state
FROM (SELECT episode_id, count(*) AS n_steps FROM ssteps GROUP BY episode_id) e
LEFT JOIN state s ON s.id = CAST(e.episode_id AS VARCHAR)""")
def q_state_lookup(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    eps = bind.scored_episodes(t.events).select("episode_id", "n_steps")
    j = C.state_lookup(eps, bind.state_table(t.supplier), "episode_id")
    return j.select("episode_id", "n_steps", "state", F.col("state").isNotNull().alias("has_state"))


GEN_SQL = """
gen AS (SELECT doc_id // 4 AS episode_id, CAST(doc_id % 4 AS INTEGER) AS step,
               text AS reason FROM documents)"""


@register("reason_merge", ids=("J2",), sql=Q.with_(Q.TEXT_STEPS, GEN_SQL) + """,
j AS (SELECT episode_id, CASE WHEN m IS NULL THEN 'no answer' WHEN n <> m THEN 'length mismatch' END AS why
      FROM (SELECT episode_id, count(*) AS n FROM tsteps GROUP BY episode_id) s
      LEFT JOIN (SELECT episode_id, count(*) AS m FROM gen GROUP BY episode_id) g USING (episode_id))
SELECT t.episode_id, t.step, t.observation, t.action, g.reason, NULL::VARCHAR AS reject_reason
FROM tsteps t JOIN gen g USING (episode_id, step) WHERE t.episode_id IN (SELECT episode_id FROM j WHERE why IS NULL)
UNION ALL SELECT episode_id, NULL, NULL, NULL, NULL, why FROM j WHERE why IS NOT NULL""")
def q_reason_merge(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    st = bind.text_steps(t.conversations).select("episode_id", "step", "observation", "action")
    gen = t.documents.select(F.expr("doc_id div 4").alias("episode_id"),
                             (F.col("doc_id") % 4).cast("int").alias("step"),
                             F.col("text").alias("reason"))
    good, rejects = C.reason_merge(st, gen)
    return (good.select("episode_id", "step", "observation", "action", "reason", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(rejects, allowMissingColumns=True))


@register("detail_enrich", ids=("J4",), sql=Q.with_(Q.SUMMARIES) + """,
d AS (SELECT 'run' || CAST(o_custkey % 3 AS VARCHAR) AS run_dir, o_orderstatus AS model_id, o_custkey AS env_idx, 1.0 AS r_type,
             CAST(count(*) AS DOUBLE) / 8 AS r_att, 0.5 AS r_price, CAST(max(o_orderkey) % 4 AS DOUBLE) / 4 AS r_option
      FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT s.*, 'run' || CAST(s.env_idx % 3 AS VARCHAR) AS run_dir, CAST(coalesce(d.r_type, 0) AS DOUBLE) AS r_type, coalesce(d.r_att, 0) AS r_att,
       CAST(coalesce(d.r_price, 0) AS DOUBLE) AS r_price, coalesce(d.r_option, 0) AS r_option
FROM summ s LEFT JOIN d ON d.run_dir = 'run' || CAST(s.env_idx % 3 AS VARCHAR) AND d.model_id = s.model_id AND d.env_idx = s.env_idx""")
def q_detail_enrich(spark, sf_dir):
    """Summaries of several runs with the details of those that have an urgent order."""
    orders = bind.Tables(spark, sf_dir).orders
    run = lambda c: F.concat(F.lit("run"), (F.col(c) % 3).cast("string"))
    sm = bind.summaries(orders).withColumn("run_dir", run("env_idx"))
    detail = (orders.where(F.col("o_orderpriority") == "1-URGENT")
              .groupBy(run("o_custkey").alias("run_dir"), F.col("o_orderstatus").alias("model_id"), F.col("o_custkey").alias("env_idx"))
              .agg(F.lit(1.0).alias("r_type"), (F.count("*").cast("double") / 8).alias("r_att"), F.lit(0.5).alias("r_price"),
                   ((F.max("o_orderkey") % 4).cast("double") / 4).alias("r_option")))
    return MT.detail_enrich(sm, detail)


MODELS = ["F", "O", "P"]


@register("outer_merge", ids=("J5",), sql=Q.with_(Q.SUMMARIES) + """
SELECT coalesce(f.env_idx, o.env_idx, p.env_idx) AS env_idx, f.score AS score_F, o.score AS score_O,
       p.score AS score_P
FROM (SELECT env_idx, score FROM summ WHERE model_id = 'F') f
FULL JOIN (SELECT env_idx, score FROM summ WHERE model_id = 'O') o ON o.env_idx = f.env_idx
FULL JOIN (SELECT env_idx, score FROM summ WHERE model_id = 'P') p ON p.env_idx = coalesce(f.env_idx, o.env_idx)""")
def q_outer_merge(spark, sf_dir):
    sm = bind.summaries(bind.Tables(spark, sf_dir).orders)
    # Same result as N full outer joins, with one shuffle: union of long rows + pivot.
    return MT.model_pivot(sm, "env_idx", "model_id", MODELS, values=("score",))


@register("model_pivot", ids=("A4", "J6"), sql=Q.with_(Q.SUMMARIES) + """
SELECT env_idx,
       max(score) FILTER (WHERE model_id = 'F') AS score_F, max(num_actions) FILTER (WHERE model_id = 'F') AS num_actions_F,
       max(score) FILTER (WHERE model_id = 'O') AS score_O, max(num_actions) FILTER (WHERE model_id = 'O') AS num_actions_O,
       max(score) FILTER (WHERE model_id = 'P') AS score_P, max(num_actions) FILTER (WHERE model_id = 'P') AS num_actions_P
FROM summ GROUP BY env_idx""")
def q_model_pivot(spark, sf_dir):
    sm = bind.summaries(bind.Tables(spark, sf_dir).orders)
    return MT.model_pivot(sm, "env_idx", "model_id", MODELS)


@register("resume_anti", ids=("J7", "ST2"), sql="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_resume_anti(spark, sf_dir):
    """J7 as the batch form of ST2's resume."""
    t = bind.Tables(spark, sf_dir)
    return C.resume_anti(t.documents.select("doc_id"), t.labels, "doc_id")


@register("name_to_id", ids=("J9", "X5"), sql="""
WITH m AS (SELECT lower(p_name) AS title, max(p_partkey) AS item_id FROM part GROUP BY lower(p_name))
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, m.item_id
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN m ON m.title = lower(upper(p.p_name))""")
def q_name_to_id(spark, sf_dir):
    """J9 (+X5): clicked title -> item id; of a repeated title the last id counts."""
    t = bind.Tables(spark, sf_dir)
    # Title -> id dictionary: on a duplicate title the last id (highest position) wins.
    names = t.part.groupBy(F.lower("p_name").alias("title")).agg(F.max_by("p_partkey", "p_partkey").alias("item_id"))
    clicks = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("clicked")), "l_partkey")
    return (clicks.join(names, F.lower(clicks["clicked"]) == names["title"], "left")
                  .select("l_orderkey", "l_linenumber", "l_partkey", "item_id"))


def _priced(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    return M.usage_cost(bind.usage(st))


USAGE_SQL = """
usage AS (
  SELECT episode_id AS run_id, step,
         CASE WHEN episode_id % 4 = 0 THEN 'gpt-4o' WHEN episode_id % 4 = 1 THEN 'gpt-4o-mini'
              WHEN episode_id % 4 = 2 THEN 'local-student' ELSE 'new-model' END AS model,
         CASE WHEN episode_id % 4 = 2 THEN 'local' ELSE 'openai' END AS provider,
         CAST(length(observation) AS BIGINT) AS prompt_tokens, CAST(length(reason) AS BIGINT) AS completion_tokens
  FROM tsteps),
prices AS (SELECT * FROM (VALUES {values}) p(model, in_units, out_units)),
priced AS (
  SELECT u.*, CASE WHEN u.provider <> 'openai' THEN 0 ELSE u.prompt_tokens * p.in_units + u.completion_tokens * p.out_units END AS cost_units,
         CASE WHEN u.provider <> 'openai' THEN 'free' WHEN p.in_units IS NULL THEN 'unpriced' ELSE 'ok' END AS status
  FROM usage u LEFT JOIN prices p USING (model))""".format(
    values=", ".join(f"('{m}', {M._units(i)}, {M._units(o)})" for m, i, o in M.PRICES_USD))


@register("usage_cost", ids=("J10", "R16", "M13"), sql=Q.with_(Q.TEXT_STEPS, USAGE_SQL) + """
SELECT run_id, step, model, cost_units, CAST(cost_units AS DOUBLE) * 1e-10 AS cost, status FROM priced""")
def q_usage_cost(spark, sf_dir):
    return _priced(spark, sf_dir).select("run_id", "step", "model", "cost_units", "cost", "status")


EXP_SQL = """
g AS (SELECT p_partkey AS idx, p_name || ' ' || p_type AS title,
             p_name || ' ' || p_type || ', and price lower than ' || CAST(p_size AS VARCHAR) || '.00 Dollars' AS instruction
      FROM part),
x AS (SELECT p_name || ' ' || p_type || '.' AS k, list_sort(list(DISTINCT p_brand)) AS texts FROM part
      GROUP BY p_name, p_type HAVING count(*) > 1)"""


@register("query_expand", ids=("J11",), sql=Q.with_(EXP_SQL) + """
SELECT g.idx, CAST(coalesce(len(x.texts), 0) + 1 AS BIGINT) AS n_texts,
       array_to_string(coalesce(x.texts, []) || [lower(g.instruction)], '|') AS texts
FROM g LEFT JOIN x ON trim(x.k, '.') = split_part(g.instruction, ', and price lower than', 1)""")
def q_query_expand(spark, sf_dir):
    p = bind.Tables(spark, sf_dir).part
    title = F.concat_ws(" ", "p_name", "p_type")
    goals = p.select(F.col("p_partkey").alias("idx"), F.concat(
        title, F.lit(", and price lower than "), F.col("p_size").cast("string"), F.lit(".00 Dollars"))
        .alias("instruction"))
    # A title that several parts share expands to their brands; the others have no expansion.
    exp = (p.groupBy(title.alias("title")).agg(F.array_sort(F.collect_set("p_brand")).alias("texts"), F.count("*").alias("n"))
            .where("n > 1").select(F.concat("title", F.lit(".")).alias("k"), "texts"))
    out = C.query_expand(goals, exp)
    return out.select("idx", F.size("texts").cast("long").alias("n_texts"), F.array_join("texts", "|").alias("texts"))
