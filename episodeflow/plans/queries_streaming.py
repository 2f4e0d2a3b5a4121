"""Registered incremental, sink-shaped and generation queries (ST1, ST3, S11, S13, U3, R15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from episodeflow.operators.answer_log import generate_logged
from episodeflow.operators.generate import EchoGenerator, batch_generate
from episodeflow.plans import bind
from episodeflow.plans import sqlgen as Q
from episodeflow.plans.queries_joins import _priced
from episodeflow.plans.queries_metrics import RUNNING_COST_SQL
from episodeflow.plans.registry import register
from episodeflow.session import scratch_path
from episodeflow.sources import sinks
from episodeflow.sources.state_map import read_states, upsert_states
from episodeflow.streaming import landed as L
from episodeflow.streaming import stream as ST

GEN_SYSTEM = "You correct the steps of a student agent."


@register("stream_summary", ids=("ST1", "S12"), sql="""
SELECT user_id AS episode_id, count(*) AS num_actions, arg_max(value, (ts, event_id)) AS score
FROM events GROUP BY user_id""")
def q_stream_summary(spark, sf_dir):
    ev = ST.table_stream(spark, sf_dir, "events", ST.EVENTS)
    return ST.run_to_sink(ST.summary_stream(ev), "stream_summary", ["episode_id"])


@register("stream_counts", ids=("ST3",), sql="""
SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type""")
def q_stream_counts(spark, sf_dir):
    ev = ST.table_stream(spark, sf_dir, "events", ST.EVENTS)
    return ST.run_to_sink(ST.counter_stream(ev), "stream_counts", ["action"])


@register("state_last_wins", ids=("S11", "M5"), sql="""
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(props, (ts, event_id)) AS state FROM events GROUP BY user_id""")
def q_state_last_wins(spark, sf_dir):
    ev = bind.Tables(spark, sf_dir).events
    rows = ev.select(F.col("user_id").cast("string").alias("id"), F.col("props").alias("state"),
                     bind.seq_key(F.col("ts"), F.col("event_id")).alias("seq"))
    return sinks.state_last_wins(rows, "id", "state", ["seq"])


@register("state_upsert", ids=("S11",), sql="""
SELECT conv_id, arg_max(text, (turn, text)) AS state, max(turn) AS turn, 'run-' || max(turn) % 3 AS run
FROM conversations GROUP BY conv_id""")
def q_state_upsert(spark, sf_dir):
    """The last text of every conversation, kept as a stored map by three runs, one of them called twice."""
    c = bind.Tables(spark, sf_dir).conversations
    path = scratch_path(spark, f"state-map-{uuid.uuid4().hex}")
    for i in (2, 0, 1, 0):
        upsert_states(c.where(F.col("turn") % 3 == i), path, f"run-{i}", "conv_id", "text", ["turn"])
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    states = read_states(spark, path, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, text string, run string")
    return states.select("conv_id", F.col("text").alias("state"), "turn", "run")


def _add_files(rows, folder: str, key: str) -> int:
    """New files for a stream, one a shuffle partition; returns their number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows.repartition(n, key).write.mode("append").parquet(folder)
    return n


@register("stream_resume", ids=("ST2", "ST1", "S12"), sql="""
SELECT conv_id, count(*) AS num_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(turn) AS last_turn
FROM conversations GROUP BY conv_id""")
def q_stream_resume(spark, sf_dir):
    """Two runs over one checkpoint: the first ends mid-way, files are added, the second goes on."""
    c = bind.Tables(spark, sf_dir).conversations
    place = scratch_path(spark, f"streams/resume-{uuid.uuid4().hex}")
    n = _add_files(c.where("conv_id % 2 = 0"), f"{place}/in", "conv_id")
    turns = ST.file_stream(spark, f"{place}/in", c.schema, max_files=max(n // 2, 1))
    L.append_batches(turns, f"{place}/checkpoint", f"{place}/out", max_batches=1)
    _add_files(c.where("conv_id % 2 <> 0"), f"{place}/in", "conv_id")
    L.append_batches(turns, f"{place}/checkpoint", f"{place}/out")
    rows = L.read_landed(spark, f"{place}/out", c.schema)
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("num_turns"), F.sum(F.length("text")).alias("n_chars"),
                                       F.max("turn").alias("last_turn"))


@register("stream_cost", ids=("W3", "A14", "ST1"), sql=RUNNING_COST_SQL)
def q_stream_cost(spark, sf_dir):
    """Running cost over calls that arrive in four runs of a stream, each ended once before its batch is committed."""
    place = scratch_path(spark, f"streams/cost-{uuid.uuid4().hex}")
    calls = _priced(spark, sf_dir).select("model", "run_id", "step", "cost_units")
    calls.write.parquet(f"{place}/calls")
    calls = spark.read.schema(calls.schema).parquet(f"{place}/calls")
    low, high = calls.agg(F.min("run_id"), F.max("run_id")).first()
    part = F.floor((F.col("run_id") - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    for i in range(4):
        _add_files(calls.where(part == i), f"{place}/in", "run_id")
        arriving = ST.file_stream(spark, f"{place}/in", calls.schema)
        for most in (1, None):
            L.stream_cost(arriving, f"{place}/checkpoint", f"{place}/out", "model", ["run_id", "step"], most)
    r = L.read_cost(spark, f"{place}/out", calls.schema, "model")
    return r.select("model", "run_id", "step", "running_cost", "position", "running_mean", "projected_cost")


@register("encode_values", ids=("S13", "X23"), sql="""
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS total,
       CASE WHEN strftime(o_orderdate, '%f') = '000000' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END AS orderdate
FROM orders""")
def q_encode_values(spark, sf_dir):
    o = bind.Tables(spark, sf_dir).orders
    x = o.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
                 F.col("o_orderdate").alias("orderdate"))
    return sinks.encode_values(x)


@register("use_db", ids=("U3",), sql="""
SELECT n.n_nationkey, 'use ' || lower(replace(r.r_name, ' ', '_')) || '; SELECT * FROM ' || n.n_name AS statement
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_use_db(spark, sf_dir):
    """The statement that selects a task's database."""
    t = bind.Tables(spark, sf_dir)
    nation, region = t.nation, t.region
    j = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    db = F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("_")))
    return j.select("n_nationkey", F.concat(F.lit("use "), db, F.lit("; SELECT * FROM "), F.col("n_name")).alias("statement"))


_GEN_ITEM = Q.request_item()


@register("batch_generate", ids=("R15", "U2", "W6"), sql=Q.with_(Q.TEXT_STEPS) + f""",
r AS (SELECT episode_id, '[' || string_agg({_GEN_ITEM}, ', ' ORDER BY step) || ']' AS traj, max(task) AS task FROM tsteps GROUP BY episode_id),
u AS (SELECT episode_id AS request_id, '{GEN_SYSTEM}' AS sys, length('Trajectory:' || chr(10) || traj || chr(10) || chr(10) ||
             'Privileged state:' || chr(10) || {Q.shown('task')}) AS n FROM r),
a AS (SELECT *, CAST(unnest(CASE WHEN n % 7 = 0 THEN [1, 2] ELSE [1] END) AS INTEGER) AS attempt FROM u),
t AS (SELECT *, n % 7 <> 0 OR attempt = 2 AS ok, 'REASON: ' || sys || chr(10) || 'ACTION: ' || CAST(n AS VARCHAR) AS x FROM a)
SELECT request_id, attempt, 'echo' AS model, CASE WHEN ok THEN x END AS text, CASE WHEN ok THEN length(sys) + n END AS prompt_tokens,
       CASE WHEN ok THEN length(x) END AS completion_tokens, ok, CASE WHEN NOT ok THEN 'RuntimeError: overloaded' END AS error FROM t""")
def q_batch_generate(spark, sf_dir):
    from episodeflow.operators import prompts as P
    st = bind.text_steps(bind.Tables(spark, sf_dir).conversations)
    req = P.teacher_request(st, state=F.col("task"), system_text=GEN_SYSTEM).select(F.col("episode_id").alias("request_id"), "messages")
    return batch_generate(req, EchoGenerator, retries=3)


@register("generate_resume", ids=("R15", "U2", "J7"), sql=f"""
WITH u AS (SELECT conv_id || '-' || turn AS request_id, length(text) AS n, CASE WHEN min(conv_id % 2) OVER (PARTITION BY text) = 0 THEN 'first' ELSE 'second' END AS run
           FROM conversations WHERE role = 'user'),
a AS (SELECT *, CAST(unnest(CASE WHEN n % 7 = 0 THEN [1, 2] ELSE [1] END) AS INTEGER) AS attempt FROM u)
SELECT request_id, attempt, run, n % 7 <> 0 OR attempt = 2 AS ok, CASE WHEN n % 7 <> 0 OR attempt = 2 THEN 'REASON: {GEN_SYSTEM}' || chr(10) || 'ACTION: ' || n END AS text
FROM a""")
def q_generate_resume(spark, sf_dir):
    """Every user turn as a request; a first run covers half of the conversations, the second asks only what the log lacks."""
    c = bind.Tables(spark, sf_dir).conversations.where("role = 'user'")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    req = c.select("conv_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
                   F.array(said("system", F.lit(GEN_SYSTEM)), said("user", F.col("text"))).alias("messages"))
    log = scratch_path(spark, f"answer-log-{uuid.uuid4().hex}")
    generate_logged(req.where("conv_id % 2 = 0"), EchoGenerator, log, "first", batch_size=1024)
    return generate_logged(req, EchoGenerator, log, "second", batch_size=1024).select("request_id", "attempt", "run", "ok", "text")
