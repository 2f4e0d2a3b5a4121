"""Registered reader queries: driver rows are written as files below the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.registry import register
from episodeflow.session import scratch_path
from episodeflow.sources import details, files, json_ranges, sinks


#: The written files are of a few MB, so their ranges are smaller than a large file's.
SMALL_RANGE = 128 << 10


def _root(spark, name: str) -> str:
    return scratch_path(spark, f"files/{name}-{uuid.uuid4().hex}")


@register("summary_scan", ids=("S3", "S4", "A7"), sql=Q.with_(Q.SUMMARIES) + """
SELECT CASE WHEN env_idx % 3 = 0 THEN 'game run' ELSE 'shop+run' END AS run, env_idx,
       CASE WHEN env_idx % 3 = 0 THEN 'g,' || CAST(env_idx AS VARCHAR) END AS gamefile, model_id,
       CAST(num_actions AS INTEGER) AS num_actions, score
FROM summ""")
def q_summary_scan(spark, sf_dir):
    """Two runs of two families: one with a gamefile column, one without; both are bound by their headers."""
    sm = bind.summaries(bind.Tables(spark, sf_dir).orders)
    root = _root(spark, "summaries")
    game, shop = sm.where("env_idx % 3 = 0"), sm.where("env_idx % 3 <> 0")
    cell = F.concat(F.lit("g,"), F.col("env_idx").cast("string")).alias("gamefile")
    game.select("env_idx", cell, "model_id", "num_actions", "score").write.option("header", True).csv(f"{root}/game run")
    shop.select("env_idx", "model_id", "num_actions", "score").write.option("header", True).csv(f"{root}/shop+run")
    back = files.discover_summaries(spark, root, name="*.csv")
    return back.select(F.substring_index("run_dir", "/", -1).alias("run"), "env_idx", "gamefile", "model_id", "num_actions", "score")


@register("iteration_scan", ids=("S7", "S10"), sql="""
SELECT CAST(doc_id % 4 AS INTEGER) AS iter, doc_id, text FROM documents WHERE doc_id % 4 <= 2 AND doc_id % 5 <> 0""")
def q_iteration_scan(spark, sf_dir):
    """Training rows of iterations 0 to 2; test rows and later iterations stay out."""
    d = bind.Tables(spark, sf_dir).documents
    rows = d.select((F.col("doc_id") % 4).cast("int").alias("iter"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), "doc_id", "text")
    root = _root(spark, "iterations")
    sinks.write_rows(rows, root, ["iter", "split"])
    return files.scan_iterations(spark, root, 2, fmt="parquet", split="train").select("iter", "doc_id", "text")


@register("episode_scan", ids=("S1", "S9", "W2"), sql=Q.with_(Q.TEXT_STEPS) + """
SELECT episode_id, step, task, observation, reason, action, is_corrected, corrected_reason, corrected_action,
       array_to_string(candidate_actions, '|') AS candidates
FROM tsteps""")
def q_episode_scan(spark, sf_dir):
    """Every conversation as an episode file under its own name, written and read back."""
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    step = ["observation", "candidate_actions", "reason", "action", "is_corrected", "corrected_reason", "corrected_action"]
    # An episode's steps are one file, so they are one row (episodes are bounded by the action caps).
    eps = st.groupBy("episode_id").agg(F.first("task", ignorenulls=True).alias("task"),
                                       F.array_sort(F.collect_list(F.struct("step", *step))).alias("trajectory"))
    eps = eps.withColumn("trajectory", F.transform("trajectory", lambda s: F.struct(*[s[c].alias(c) for c in step])))
    root = _root(spark, "episodes")
    sinks.write_episodes(eps.withColumnRenamed("episode_id", "episode_name"), root)
    good, _ = files.scan_episode_dir(spark, root, numbered=True)
    return files.episode_steps(good).select("episode_id", "step", "task", "observation", "reason", "action", "is_corrected", "corrected_reason",
                                            "corrected_action", F.array_join("candidate_actions", "|").alias("candidates"))


@register("detail_scan", ids=("S8", "J4", "S3", "S4"), sql="""
WITH summ AS (SELECT 'run ' || l_linestatus AS run, 'lab+' || l_returnflag || '/' || CAST(l_suppkey % 2 AS VARCHAR) AS model_id, l_suppkey AS env_idx,
                     CAST(count(*) AS INTEGER) AS num_actions, CAST(sum(l_linenumber) % 11 AS DOUBLE) / 10 AS score, sum(l_linenumber) AS n
              FROM lineitem GROUP BY ALL)
SELECT run, model_id, env_idx, num_actions, score,
       CASE n % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' ELSE 'read' END AS detail_status,
       CAST(CASE WHEN n % 5 >= 2 THEN (n % 8) / 8 ELSE 0 END AS DOUBLE) AS r_type, CAST(CASE WHEN n % 5 >= 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS r_att,
       CAST(CASE WHEN n % 5 >= 2 AND n % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS r_price, CAST(0 AS DOUBLE) AS r_option
FROM summ""")
def q_detail_scan(spark, sf_dir):
    """Two run folders with summaries and detail files of nested model ids; some files are missing, cut short or not asked for."""
    n = F.sum("l_linenumber")
    sm = (bind.Tables(spark, sf_dir).lineitem
          .groupBy(F.concat(F.lit("run "), F.col("l_linestatus")).alias("run"),
                   F.concat(F.lit("lab+"), F.col("l_returnflag"), F.lit("/"), (F.col("l_suppkey") % 2).cast("string")).alias("model_id"),
                   F.col("l_suppkey").alias("env_idx"))
          .agg(F.count("*").cast("int").alias("num_actions"), ((n % 11).cast("double") / 10).alias("score"), n.alias("n")))
    root = _root(spark, "details")
    sinks.write_rows(sm.select("run", "env_idx", "model_id", "num_actions", "score", "n"), f"{root}/rows")
    sm = spark.read.parquet(f"{root}/rows")
    runs = f"{root}/runs"
    info = F.struct(F.struct(((F.col("n") % 8).cast("double") / 8).alias("r_type"), F.lit(0.5).alias("r_att"),
                             F.when(F.col("n") % 2 == 1, 1.0).alias("r_price")).alias("verbose")).alias("info")
    text = F.to_json(F.struct(info))
    place = F.concat("run", F.lit("/"), "model_id", F.lit("/"), F.col("env_idx").cast("string"), F.lit(".json"))
    held = sm.where("n % 5 <> 0").select(place.alias("name"), F.when(F.col("n") % 5 == 1, F.left(text, F.lit(20))).otherwise(text).alias("text"))
    other = sm.where("n % 3 = 0").select(F.concat("run", F.lit("/not compared/"), "model_id", F.lit("/"), F.col("env_idx").cast("string"), F.lit(".json")).alias("name"), text.alias("text"))
    sinks.write_named(held.unionByName(other), runs, "name", "text", folders=True)
    for run in ("run F", "run O"):
        sm.where(F.col("run") == run).select("env_idx", "model_id", "num_actions", "score").write.option("header", True).csv(f"{runs}/{run}/summary")
    found = files.discover_summaries(spark, runs, name="*.csv").drop("gamefile").withColumn("run_dir", F.regexp_replace("run_dir", "/summary$", ""))
    return details.detail_scan(found, runs).select(F.substring_index("run_dir", "/", -1).alias("run"), "model_id", "env_idx", "num_actions", "score",
                                                   "detail_status", *files.SCORES)


def _entries(rows, file_no, order, entry):
    """One file's entries in order, joined by commas; ``file_no`` bounds how many rows a file holds."""
    held = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], entry.alias("entry"))))
    return rows.groupBy(F.coalesce(file_no, F.lit(-1)).cast("string").alias("file_no")).agg(F.array_join(F.transform(held, lambda e: e["entry"]), ",\n").alias("entries"))


@register("training_set_scan", ids=("S6",), sql="""
SELECT CAST(conv_id // 200 AS INTEGER) AS file_no, conv_id, turn, role, text FROM conversations""")
def q_training_set_scan(spark, sf_dir):
    """Every turn as a training row of JSON array files (200 conversations a file), each read in many byte ranges."""
    c = bind.Tables(spark, sf_dir).conversations
    message = lambda role, content: F.array(F.struct(role.alias("role"), content.alias("content")))
    row = F.to_json(F.struct("conv_id", "turn", message(F.col("role"), F.col("text")).alias("prompt"),
                             message(F.lit("assistant"), F.lit("[]{},\\")).alias("response")))
    root = _root(spark, "training-sets")
    texts = _entries(c, F.floor(F.col("conv_id") / 200), ("conv_id", "turn"), row)
    sinks.write_named(texts.select(F.concat("file_no", F.lit(".json")).alias("name"), F.concat(F.lit("[\n"), "entries", F.lit("\n]")).alias("text")), root, "name", "text")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), *files.SFT_ROW.fields])
    rows, _ = json_ranges.scan_array(spark, root, schema, size=SMALL_RANGE)
    first = F.get("prompt", F.lit(0))
    return rows.select(F.regexp_extract("file", "([^/]*)[.]json$", 1).cast("int").alias("file_no"), "conv_id", "turn", first["role"].alias("role"),
                       first["content"].alias("text"))


@register("state_map_scan", ids=("S5", "S11"), sql="""
SELECT CAST(event_id // 4096 AS INTEGER) AS file_no, CAST(user_id AS VARCHAR) AS id, arg_max(props, (ts, event_id)) AS state
FROM events GROUP BY event_id // 4096, user_id""")
def q_state_map_scan(spark, sf_dir):
    """JSON object files (4096 events a file) that name an id many times, each read in many byte ranges; the last state counts."""
    ev = bind.Tables(spark, sf_dir).events
    entry = F.to_json(F.create_map(F.col("user_id").cast("string"), F.col("props")))
    root = _root(spark, "state-maps")
    texts = _entries(ev, F.floor(F.col("event_id") / 4096), ("ts", "event_id"), F.substr(entry, F.lit(2), F.length(entry) - 2))
    sinks.write_named(texts.select(F.concat("file_no", F.lit(".json")).alias("name"), F.concat(F.lit("{"), "entries", F.lit("}")).alias("text")), root, "name", "text")
    rows, _ = json_ranges.scan_map(spark, root, size=SMALL_RANGE // 8)
    return rows.select(F.regexp_extract("file", "([^/]*)[.]json$", 1).cast("int").alias("file_no"), "id", "state")
