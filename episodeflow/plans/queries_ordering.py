"""Registered sort / sample / mix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodeflow.operators import ordering as O
from episodeflow.plans import bind
from episodeflow.plans.registry import register


@register("natural_sort_limit", ids=("O1", "X15"), sql="""
WITH f AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'x' ELSE '' END || CAST(doc_id AS VARCHAR) || '.json' AS name FROM documents),
good AS (SELECT name FROM f WHERE name NOT LIKE 'x%' ORDER BY CAST(regexp_extract(name, '^(\\d+)\\.', 1) AS BIGINT), name LIMIT 10)
SELECT name, NULL::VARCHAR AS reject_reason FROM good UNION ALL SELECT name, 'non-numeric stem' FROM f WHERE name LIKE 'x%'""")
def q_natural_sort_limit(spark, sf_dir):
    stem = F.concat(F.when(F.col("doc_id") % 7 == 3, "x").otherwise(""), F.col("doc_id").cast("string"))
    files = bind.Tables(spark, sf_dir).documents.select(F.concat(stem, F.lit(".json")).alias("name"))
    good, rejects = O.natural_sort_limit(files, "name", 10)
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)


@register("seeded_shuffle", ids=("O2",), sql="""
SELECT doc_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS shuffle_key,
       row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos
FROM documents""")
def q_seeded_shuffle(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents.select("doc_id")
    return O.seeded_shuffle(d, "doc_id", 42, "pos").select("doc_id", "shuffle_key", "pos")


@register("prior_mix", ids=("O3", "O5"), sql="""
WITH cur AS (SELECT doc_id FROM documents WHERE lang <> 'en'),
prior AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
          FROM documents WHERE lang = 'en')
SELECT doc_id, 'current' AS origin FROM cur
UNION ALL
SELECT doc_id, 'prior' AS origin FROM prior WHERE rk <= (SELECT count(*) FROM cur)""")
def q_prior_mix(spark, sf_dir):
    d = bind.Tables(spark, sf_dir).documents
    # Current iteration: the non-English documents; prior data: the (larger) English set.
    cur = d.where(F.col("lang") != "en").select("doc_id")
    prior = d.where(F.col("lang") == "en").select("doc_id")
    return O.prior_mix(cur, prior, "doc_id", 42)


@register("balanced_mix", ids=("O4", "S7"), sql="""
WITH r AS (SELECT lang AS dir, doc_id,
                  row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn
           FROM documents)
SELECT dir, doc_id FROM r
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""")
def q_balanced_mix(spark, sf_dir):
    # One data set per language (unequal sizes: the balance takes the smallest size from each).
    d = bind.Tables(spark, sf_dir).documents.select(F.col("lang").alias("dir"), "doc_id")
    return O.balanced_mix(d, "dir", "doc_id", 42).select("dir", "doc_id")


@register("prior_mix_order", ids=("O3", "O2"), sql="""
WITH cur AS (SELECT doc_id FROM documents WHERE lang <> 'en'),
prior AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
          FROM documents WHERE lang = 'en'),
m AS (SELECT 'current' AS origin, doc_id FROM cur
      UNION ALL SELECT 'prior', doc_id FROM prior WHERE rk <= (SELECT count(*) FROM cur))
SELECT origin, doc_id, md5('42:' || origin || ':' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM m""")
def q_prior_mix_order(spark, sf_dir):
    """The prior-data mix as it goes into training: appended, then shuffled as a whole."""
    return O.reshuffled(q_prior_mix(spark, sf_dir), ["origin", "doc_id"], 42).select("origin", "doc_id", "shuffle_key")


@register("training_mix", ids=("O4", "S6"), sql="""
WITH d AS (SELECT lang AS dir, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split, dir ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn,
      count(*) OVER (PARTITION BY split, dir) AS n FROM d),
m AS (SELECT *, min(n) OVER (PARTITION BY split) AS least FROM r)
SELECT split, dir, doc_id, md5('42:' || split || ':' || dir || ':' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM m WHERE rn <= least""")
def q_training_mix(spark, sf_dir):
    """Training and evaluation sets of several folders (one a language), each balanced and shuffled by itself."""
    d = bind.Tables(spark, sf_dir).documents
    rows = d.select(F.col("lang").alias("dir"), F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split"), "doc_id")
    return O.training_mix(rows, ["train", "test"], "dir", "doc_id").select("split", "dir", "doc_id", "shuffle_key")


@register("key_intersect", ids=("O6",), sql="""
SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def q_key_intersect(spark, sf_dir):
    """Keys that both sides have."""
    t = bind.Tables(spark, sf_dir)
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@register("candidate_cap", ids=("O7", "X12"), sql="""
WITH c AS (
  SELECT l_orderkey // 4 AS episode_id,
         'item-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS cand,
         row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn,
         count(*) OVER (PARTITION BY l_orderkey // 4) AS n
  FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, rn > 6
                                   ORDER BY md5('42:' || cand), cand) AS hr FROM c)
SELECT episode_id, CAST(max(n) AS BIGINT) AS n_candidates,
       string_agg(cand, '|' ORDER BY CASE WHEN n <= 20 OR rn <= 6 THEN 0 ELSE 1 END,
                  CASE WHEN n <= 20 OR rn <= 6 THEN rn ELSE 0 END, md5('42:' || cand), cand) AS kept
FROM r WHERE n <= 20 OR rn <= 6 OR hr <= 10
GROUP BY episode_id""")
def q_candidate_cap(spark, sf_dir):
    li = bind.Tables(spark, sf_dir).lineitem
    c = li.select(F.expr("l_orderkey div 4").alias("episode_id"), "l_orderkey", "l_linenumber", "l_partkey",
                  F.concat(F.lit("item-"), F.col("l_partkey").cast("string"), F.lit("-"),
                           F.col("l_linenumber").cast("string")).alias("cand"))
    # Candidate lists are small per episode (a few orders); listed in (order, line) order.
    lists = c.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "cand"))), lambda s: s["cand"]).alias("cands"))
    return lists.select("episode_id", F.size("cands").cast("long").alias("n_candidates"),
                        F.array_join(O.candidate_cap(F.col("cands")), "|").alias("kept"))


@register("random_goal", ids=("O8",), sql="""
SELECT p_partkey AS idx, p_name AS instruction FROM part
ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 3""")
def q_random_goal(spark, sf_dir):
    g = bind.goals(bind.Tables(spark, sf_dir).part)
    return O.random_goal(g, "idx", 3, 42).select("idx", "instruction")
