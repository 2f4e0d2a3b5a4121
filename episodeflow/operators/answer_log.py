"""Resumable generation (R15, U2, J7): paid answers go to an append-only log as they come.

A request is known by a digest of its messages and sampling settings, so equal requests are asked once and
share their answer. Each call's answers are a file of the log, renamed into place before the next call;
they do not wait for the task or the job to end. A run first takes from the requests those that the log
has finished (a valid answer, or all attempts used) and goes on with the others at their next attempt. So
does a task that is tried again, with what its earlier tries left in the log. At most the calls in flight
are paid twice: one batch a task that is killed, and what speculative copies of a task ask.

A log belongs to one rule of valid answers; use another folder for another rule.
"""

from __future__ import annotations

import sys
import uuid
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeflow.operators.generate import MAX_NEW_TOKENS, TEMPERATURE, Generator, _call
from episodeflow.session import ship_package
from episodeflow.sources.named_files import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWER = pa.schema([("digest", pa.string()), ("attempt", pa.int32()), ("text", pa.string()), ("prompt_tokens", pa.int64()),
                    ("completion_tokens", pa.int64()), ("ok", pa.bool_()), ("error", pa.string())])
LOGGED = "digest string, attempt int, text string, prompt_tokens long, completion_tokens long, ok boolean, error string, run string"


def request_digest(messages: Column, model: str, temperature: float = TEMPERATURE, max_new_tokens: int = MAX_NEW_TOKENS) -> Column:
    """256-bit digest of a request; null messages are a request of their own."""
    settings = F.lit(f"{model}\n{temperature!r}\n{max_new_tokens}\n")
    return F.sha2(F.concat(settings, F.coalesce(F.to_json(messages), F.lit("null"))), 256)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """One row per digest and attempt; of an attempt that was paid twice, the answer of the smallest run and text."""
    fs, path = file_system(log)
    fs.create_dir(path, recursive=True)
    rows = spark.read.schema(LOGGED).parquet(log)
    rest = [c for c in rows.columns if c not in ("digest", "attempt")]
    # The struct's first fields decide: valid answers first, then run and text.
    best = F.min(F.struct((~F.col("ok")).alias("_bad"), "run", *[c for c in rest if c != "run"])).alias("a")
    return rows.groupBy("digest", "attempt").agg(best).select("digest", "attempt", *[F.col(f"a.{c}").alias(c) for c in rest])


def _asker(make_generator: Callable[[], Generator], log: str, retries: int, check: Callable[[str], bool], temperature: float, batch_size: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = file_system(log)
        fs.create_dir(folder, recursive=True)
        part = f"part-{TaskContext.get().partitionId():06d}-"
        # What earlier tries of this task (same requests: they are dealt by digest) have left in this run.
        left: dict[str, tuple[int, bool]] = {}
        for info in fs.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith(part):
                old = pq.read_table(info.path, filesystem=fs, columns=["digest", "attempt", "ok"], partitioning=None)
                for d, n, ok in zip(*(c.to_pylist() for c in old.columns)):
                    m, was = left.get(d, (0, False))
                    left[d] = (max(m, n), was or ok)
        generate = make_generator()
        asked = 0
        for pdf in batches:
            todo = []
            for d, done, ms in zip(pdf["digest"], pdf["done"], pdf["messages"]):
                n, ok = left.get(d, (0, False))
                if not ok:
                    todo.append((d, [dict(m) for m in (ms if ms is not None else [])], max(int(done), n)))
            for attempt in range(1, retries + 1):
                due = [(d, ms) for d, ms, done in todo if done < attempt]
                valid = set()
                for i in range(0, len(due), batch_size):
                    batch = due[i: i + batch_size]
                    rows = []
                    for (d, _), answer in zip(batch, _call(generate, [ms for _, ms in batch], attempt, temperature)):
                        if isinstance(answer, Exception):
                            rows.append((d, attempt, None, None, None, False, f"{type(answer).__name__}: {answer}"))
                        else:
                            rows.append((d, attempt, *answer, bool(check(answer[0])), None))
                    name = uuid.uuid4().hex
                    pq.write_table(pa.Table.from_pylist([dict(zip(ANSWER.names, r)) for r in rows], schema=ANSWER), f"{folder}/_{name}", filesystem=fs)
                    fs.move(f"{folder}/_{name}", f"{folder}/{part}{name}.parquet")
                    valid |= {r[0] for r in rows if r[5]}
                    asked += len(rows)
                todo = [t for t in todo if t[0] not in valid]
        yield pd.DataFrame({"asked": [asked]})

    return ask


def generate_logged(requests: DataFrame, make_generator: Callable[[], Generator], log: str, run: str, retries: int = 3,
                    valid: Callable[[str], bool] | None = None, key: str = "request_id", messages: str = "messages", model: str = "echo",
                    temperature: float = TEMPERATURE, batch_size: int = 64, tasks: int | None = None) -> DataFrame:
    """Answers of all requests, one row per request and attempt, asking only what ``log`` does not hold yet.

    ``run`` names this run in the log (letters, digits, '-'); the column ``run`` says which run paid an
    attempt. Calling again after a failure, with the same ``run`` or another, goes on where it ended.
    Requests with equal messages share their answers; repeated keys give repeated rows.
    """
    spark = requests.sparkSession
    ship_package(spark)
    rows = requests.select(F.col(key).alias("request_id"), F.col(messages).alias("messages"))
    rows = rows.withColumn("digest", request_digest(F.col("messages"), model, temperature))
    logged = read_log(spark, log)
    state = logged.groupBy("digest").agg(F.max("attempt").alias("done"), F.max("ok").alias("ok"))
    known = rows.dropDuplicates(["digest"]).join(state, "digest", "left")
    todo = known.where(~F.coalesce("ok", F.lit(False)) & (F.coalesce("done", F.lit(0)) < retries))
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    # Dealt by digest into a fixed number of tasks: a task that is tried again has the same requests.
    dealt = todo.select("digest", F.coalesce("done", F.lit(0)).alias("done"), "messages").repartition(n, "digest")
    ask = _asker(make_generator, f"{log.rstrip('/')}/run={run}", retries, valid or (lambda t: "ACTION:" in t), temperature, batch_size)
    dealt.mapInPandas(ask, "asked long").write.format("noop").mode("overwrite").save()
    return rows.select("request_id", "digest").join(read_log(spark, log).where(F.col("attempt") <= retries), "digest")
