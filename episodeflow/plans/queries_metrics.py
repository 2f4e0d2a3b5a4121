"""Registered report and metering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.operators import metering as M
from episodeflow.operators import metrics as MT
from episodeflow.operators import ordering as O
from episodeflow.operators import steps as S
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.queries_joins import USAGE_SQL, _priced
from episodeflow.plans.registry import register

CAT_SQL = Q.with_(Q.SUMMARIES) + """,
cat AS (SELECT c_custkey AS env_idx, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS category
        FROM customer),
sc AS (SELECT s.*, c.category FROM summ s JOIN cat c USING (env_idx))"""


def _sm_cat(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    return bind.summaries(t.orders).join(bind.categories(t.customer), "env_idx")


@register("category_means", ids=("A2",), sql=CAT_SQL + """
SELECT category, round(avg(score), 6) AS mean_score, round(avg(num_actions), 6) AS mean_num_actions
FROM sc WHERE category IS NOT NULL GROUP BY category""")
def q_category_means(spark, sf_dir):
    m = MT.category_means(_sm_cat(spark, sf_dir), "category", ["score", "num_actions"])
    return m.select("category", F.round("mean_score", 6).alias("mean_score"),
                    F.round("mean_num_actions", 6).alias("mean_num_actions"))


OVERALL_SQL = CAT_SQL + """,
g AS (SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category,
             grouping(category) AS gid, avg(score) AS mean_score, avg(num_actions) AS mean_num_actions
      FROM sc GROUP BY GROUPING SETS ((category), ()))"""


@register("means_with_overall", ids=("A3", "O5"), sql=OVERALL_SQL + """
SELECT category, round(mean_score, 6) AS mean_score, round(mean_num_actions, 6) AS mean_num_actions
FROM g WHERE gid = 1 OR category IS NOT NULL""")
def q_means_with_overall(spark, sf_dir):
    m = MT.means_with_overall(_sm_cat(spark, sf_dir), "category", ["score", "num_actions"])
    return m.select("category", F.round("mean_score", 6).alias("mean_score"),
                    F.round("mean_num_actions", 6).alias("mean_num_actions"))


# Report row order for the customer-segment binding (the game report uses MT.GAME_REPORT_ORDER).
SEGMENT_ORDER = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "overall"]


@register("ordered_report", ids=("O9", "X17", "X19"), sql=OVERALL_SQL + """,
ord AS (SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'MACHINERY'),
                              (4, 'HOUSEHOLD'), (5, 'overall')) o(pos, category))
SELECT o.pos, o.category, printf('%.1f', g.mean_score * 100) AS score_text,
       printf('%.1f', g.mean_num_actions) AS num_actions_text
FROM ord o LEFT JOIN (SELECT * FROM g WHERE gid = 1 OR category IS NOT NULL) g USING (category)""")
def q_ordered_report(spark, sf_dir):
    m = MT.means_with_overall(_sm_cat(spark, sf_dir), "category", ["score", "num_actions"])
    rep = MT.ordered_report(m, "category", SEGMENT_ORDER)
    return rep.select("pos", "category",
                      MT.one_decimal_text(F.col("mean_score") * 100).alias("score_text"),
                      MT.one_decimal_text(F.col("mean_num_actions")).alias("num_actions_text"))


MODEL_ROWS_SQL = """
mr AS (SELECT event_type AS model_id, value / 500 AS score, CAST(value > 100 AS DOUBLE) AS r_type,
              CAST(value > 50 AS DOUBLE) AS r_att, CAST(value > 10 AS DOUBLE) AS r_price,
              CAST(value > 5 AS DOUBLE) AS r_option, CAST(event_id % 30 AS DOUBLE) AS num_actions FROM events)"""


@register("model_means", ids=("A5", "X18"), sql=Q.with_(MODEL_ROWS_SQL) + """
SELECT model_id, round_even(avg(r_att) * 100, 1) AS r_att, round_even(avg(r_option) * 100, 1) AS r_option,
       round_even(avg(r_type) * 100, 1) AS r_type, round_even(avg(r_price) * 100, 1) AS r_price,
       round_even(avg(score) * 10, 1) AS score, round_even(avg(num_actions), 1) AS num_actions, count(*) AS n
FROM mr GROUP BY model_id""")
def q_model_means(spark, sf_dir):
    ev = bind.Tables(spark, sf_dir).events
    v = F.col("value")
    rows = ev.select(F.col("event_type").alias("model_id"), (v / 500).alias("score"),
                     (F.col("event_id") % 30).cast("double").alias("num_actions"),
                     *[(v > t).cast("double").alias(n) for n, t in
                       [("r_type", 100), ("r_att", 50), ("r_price", 10), ("r_option", 5)]])
    return MT.model_means(rows)


@register("failure_fix", ids=("A6", "F12"), sql=Q.with_(Q.SCORED_STEPS) + """,
s AS (SELECT episode_id, count(*) AS num_actions, CAST(CASE WHEN arg_max(score, step) > 100 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
      FROM ssteps WHERE step < 20 GROUP BY episode_id)
SELECT episode_id, CASE WHEN score = 0 AND num_actions = 20 THEN 30 ELSE num_actions END AS num_actions, score FROM s""")
def q_failure_fix(spark, sf_dir):
    rows = bind.scored_rows(bind.Tables(spark, sf_dir).events).select("episode_id", "event_id", "ts", "score")
    st = S.first_steps(rows, 20, ("ts", "event_id"))
    sm = S.episodes(st).select("episode_id", F.col("n_steps").alias("num_actions"),
                               F.when(F.col("last_score") > 100, 1.0).otherwise(0.0).alias("score"))
    return MT.failure_fix(sm, 20, 30)


@register("dup_models", ids=("A7",), sql="""
SELECT lang AS model_id, count(DISTINCT source) AS n_runs FROM documents GROUP BY lang HAVING count(DISTINCT source) > 1""")
def q_dup_models(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents.select(F.col("lang").alias("model_id"), F.col("source").alias("run"))
    return MT.dup_models(d, "model_id", "run")


@register("action_counts", ids=("A8", "ST3"), sql="""
SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type""")
def q_action_counts(spark, sf_dir):
    """How often each action occurs."""
    ev = bind.Tables(spark, sf_dir).events
    return ev.groupBy(F.col("event_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@register("category_counts", ids=("A8",), sql="""
SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type""")
def q_category_counts(spark, sf_dir):
    p = bind.Tables(spark, sf_dir).part
    return p.groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@register("attribute_outcomes", ids=("A9",), sql="""
WITH x AS (
  SELECT [g.p_brand, g.p_type, CAST(g.p_size AS VARCHAR)] AS attributes,
         [b.p_brand, b.p_type, CAST(b.p_size AS VARCHAR)] AS bought
  FROM lineitem l JOIN part g ON g.p_partkey = l.l_partkey JOIN part b ON b.p_partkey = l.l_partkey + l.l_linenumber),
e AS (SELECT unnest(attributes) AS attribute, bought FROM x)
SELECT attribute, CAST(sum(CAST(list_contains(bought, attribute) AS BIGINT)) AS BIGINT) AS n_ok,
       CAST(sum(1 - CAST(list_contains(bought, attribute) AS BIGINT)) AS BIGINT) AS n_fail
FROM e GROUP BY attribute""")
def q_attribute_outcomes(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    g = bind.goals(t.part)
    li = t.lineitem.select("l_partkey", (F.col("l_partkey") + F.col("l_linenumber")).alias("_bought"))
    x = (li.join(g.select(F.col("idx").alias("l_partkey"), "attributes"), "l_partkey")
           .join(g.select(F.col("idx").alias("_bought"), F.col("attributes").alias("purchased_attrs")), "_bought"))
    return MT.attribute_outcomes(x)


@register("item_clicks", ids=("A10",), sql="""
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS item, count(*) AS n
FROM events WHERE event_type = 'click' GROUP BY 1""")
def q_item_clicks(spark, sf_dir):
    ev = bind.Tables(spark, sf_dir).events.where(F.col("event_type") == "click")
    return ev.groupBy(F.get_json_object("props", "$.k").cast("long").alias("item")).agg(F.count(F.lit(1)).alias("n"))


@register("click_rank", ids=("A10", "X14"), sql="""
WITH named AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name FROM lineitem l
               JOIN part p ON p.p_partkey = l.l_partkey),
vis AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS visible FROM named GROUP BY l_orderkey)
SELECT n.l_orderkey, n.l_linenumber,
       CAST(coalesce(nullif(list_position(v.visible, c.p_name), 0), -1) AS BIGINT) AS click_rank
FROM named n JOIN vis v USING (l_orderkey) JOIN part c ON c.p_partkey = n.l_suppkey""")
def q_click_rank(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    named = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("pk")).join(
        t.part.select(F.col("p_partkey").alias("pk"), "p_name"), "pk")
    # Visible list per order: orders are small groups (a handful of lines each).
    clicked = t.part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("clicked"))
    lines = named.join(clicked, "l_suppkey", "left").select(
        "l_orderkey", F.struct("l_linenumber", "pk", "p_name", "clicked").alias("line"))
    # One grouping gives an order's visible list and its clicks: orders are small groups (a handful of lines each).
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    each = orders.select("l_orderkey", F.transform("lines", lambda s: s["p_name"]).alias("visible"), F.explode("lines").alias("line"))
    return (each.where(F.col("line.clicked").isNotNull())
            .select("l_orderkey", "line.l_linenumber", MT.click_rank(F.col("visible"), F.col("line.clicked")).alias("click_rank")))


@register("episode_metrics", ids=("A11",), sql="""
WITH e AS (
  SELECT o.o_orderkey, max(l.l_discount) * 10 AS reward, count(*) AS n_steps,
         bool_or(l.l_partkey = o.o_custkey) AS bought_goal
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
SELECT o_orderkey, reward, n_steps, reward = 1.0 AS harsh, reward = 1.0 AND bought_goal AS exact,
       round(reward / n_steps, 9) AS norm
FROM e""")
def q_episode_metrics(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    j = t.orders.select("o_orderkey", "o_custkey").join(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_discount", "l_partkey"), "o_orderkey")
    e = j.groupBy("o_orderkey").agg((F.max("l_discount") * 10).alias("reward"), F.count(F.lit(1)).alias("n_steps"),
                                    F.bool_or(F.col("l_partkey") == F.col("o_custkey")).alias("bought_goal"))
    m = MT.episode_metrics(F.col("reward"), F.col("n_steps"), F.col("bought_goal"))
    return e.select("o_orderkey", "reward", "n_steps", m["harsh"].alias("harsh"), m["exact"].alias("exact"),
                    F.round(m["norm"], 9).alias("norm"))


@register("match_score", ids=("A12", "X10"), sql="""
WITH x AS (
  SELECT d.doc_id, string_split(b.text, ' ') AS attrs, [d.lang, 'src'] AS opts, d.text,
         [d.source || ' ' || d.text] AS cands, d.source
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
c AS (SELECT doc_id, len(list_filter(attrs, lambda a: contains(lower(text), a) OR contains(lower(source), a) OR contains(lower(opts[1]), a))) AS n_att,
             len(list_filter(opts, lambda o: len(list_filter(cands, lambda c: contains(c, o))) > 0)) AS n_opt,
             len(attrs) AS la, len(opts) AS lo FROM x)
SELECT doc_id, round(n_att / la, 9) AS r_att, round(n_opt / lo, 9) AS r_opt,
       round((n_att + n_opt + 1) / (la + lo + 1), 9) AS r
FROM c""")
def q_match_score(spark, sf_dir):
    t = bind.Tables(spark, sf_dir)
    # Every document is estimated against one benchmark item (items are numbered from 0).
    items = t.benchmark.select("item_id", F.col("text").alias("btext"))
    x = t.documents.withColumn("item_id", F.col("doc_id") % F.lit(items.count())).join(items, "item_id")
    m = MT.match_score(F.split("btext", " "), F.array("lang", F.lit("src")), [F.col("text"), F.col("source"), F.col("lang")],
                       F.array(F.concat("source", F.lit(" "), F.col("text"))))
    return x.select("doc_id", *[F.round(m[k], 9).alias(k) for k in ("r_att", "r_opt", "r")])


@register("success_rate", ids=("A13",), sql="""
SELECT round(avg(CAST(quality = 1 AS DOUBLE)), 9) AS success_rate, count(*) AS n FROM labels""")
def q_success_rate(spark, sf_dir):
    lab = bind.Tables(spark, sf_dir).labels
    return lab.agg(F.round(MT.success_rate(F.col("quality").cast("double")), 9).alias("success_rate"),
                   F.count(F.lit(1)).alias("n"))


@register("cost_totals", ids=("A14",), sql=Q.with_(Q.TEXT_STEPS, USAGE_SQL) + """,
g AS (SELECT model, sum(coalesce(cost_units, 0)) AS u, count(*) AS n_calls FROM priced GROUP BY model)
SELECT model, CAST(u AS DOUBLE) * 1e-10 AS total_cost, CAST(u AS DOUBLE) * 1e-10 / n_calls AS mean_cost, n_calls,
       CAST(u AS DOUBLE) * 1e-10 / n_calls * n_calls AS projected_cost
FROM g""")
def q_cost_totals(spark, sf_dir):
    return M.cost_totals(_priced(spark, sf_dir), "model")


RUNNING_COST_SQL = Q.with_(Q.TEXT_STEPS, USAGE_SQL) + """,
r AS (SELECT model, run_id, step,
             sum(coalesce(cost_units, 0)) OVER (PARTITION BY model ORDER BY run_id, step
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cu,
             row_number() OVER (PARTITION BY model ORDER BY run_id, step) AS position,
             count(*) OVER (PARTITION BY model) AS n
      FROM priced)
SELECT model, run_id, step, CAST(cu AS DOUBLE) * 1e-10 AS running_cost, position,
       CAST(cu AS DOUBLE) * 1e-10 / position AS running_mean,
       CAST(cu AS DOUBLE) * 1e-10 / position * n AS projected_cost
FROM r"""


@register("running_cost", ids=("W3",), sql=RUNNING_COST_SQL)
def q_running_cost(spark, sf_dir):
    r = M.running_cost(_priced(spark, sf_dir), "model", ["run_id", "step"])
    return r.select("model", "run_id", "step", "running_cost", "position", "running_mean", "projected_cost")


@register("split_sizes", ids=("A15", "S10", "W4"), sql=Q.with_(Q.TEXT_STEPS) + """,
eps AS (SELECT DISTINCT episode_id FROM tsteps),
r AS (SELECT episode_id, row_number() OVER (ORDER BY md5('42:' || CAST(episode_id AS VARCHAR)), episode_id) AS rk,
             count(*) OVER () AS n FROM eps),
sp AS (SELECT episode_id, CASE WHEN rk <= floor(n * 0.85) THEN 'train' ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n FROM tsteps JOIN sp USING (episode_id)
WHERE is_corrected IS DISTINCT FROM false GROUP BY split""")
def q_split_sizes(spark, sf_dir):
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    sp = S.episode_split(st.select("episode_id").distinct())
    rows = S.uncorrected_skip(st).join(sp, "episode_id")
    return O.split_sizes(rows)


@register("min_size", ids=("A15", "S7"), sql="""
SELECT min(n) AS min_n, count(*) AS n_dirs FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def q_min_size(spark, sf_dir):
    d = bind.datasets(bind.Tables(spark, sf_dir).documents)
    sizes = d.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_n"), F.count(F.lit(1)).alias("n_dirs"))


PART_PREFIXES = [("SMALL", "small"), ("S", "s-other"), ("PROMO", "promo"), ("MEDIUM", "medium"),
                 ("LARGE", "large"), ("ECO", "eco")]


@register("category_map", ids=("X9", "X8"), sql="""
WITH x AS (SELECT p_partkey, 'parts/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path FROM part),
k AS (SELECT p_partkey, string_split(path, '/')[2] AS key FROM x)
SELECT p_partkey, CASE WHEN starts_with(key, 'SMALL') THEN 'small' WHEN starts_with(key, 'S') THEN 's-other'
                       WHEN starts_with(key, 'PROMO') THEN 'promo' WHEN starts_with(key, 'MEDIUM') THEN 'medium'
                       WHEN starts_with(key, 'LARGE') THEN 'large' WHEN starts_with(key, 'ECO') THEN 'eco' END AS category
FROM k""")
def q_category_map(spark, sf_dir):
    p = bind.Tables(spark, sf_dir).part
    path = F.concat(F.lit("parts/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"))
    key = F.get(F.split(path, "/"), 1)
    return p.select("p_partkey", MT.category_map(key, PART_PREFIXES).alias("category"))
