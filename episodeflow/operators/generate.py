"""Batch generation stage (R15, U2): a request table in, a landed response table out.

The generator is a picklable callable factory; one client is built per
partition inside ``mapInPandas`` (Arrow batches) and called with a batch of
message lists. Every attempt becomes a row, an exception too, so a failing
call never fails the task (which would repeat the paid calls of the
partition) and retries are data (first valid attempt = W6). The responses
are landed in the shared folder: using them twice does not repeat the calls.
"""

from __future__ import annotations

import sys
import uuid
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Ship this module's functions and classes (e.g. EchoGenerator) by value, so
# Python workers need not import the package. Generators defined elsewhere
# travel the usual way (``--py-files``).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sampling settings of every generation call.
TEMPERATURE = 0.3
MAX_NEW_TOKENS = 256

#: One call's answer: text, prompt tokens, completion tokens; or the exception it raised.
Answer = "tuple[str, int, int] | Exception"
#: (message lists, attempt, temperature) -> one answer for each list.
Generator = Callable[[Sequence[Sequence[dict]], int, float], Sequence]


class EchoGenerator:
    """Deterministic stand-in for a chat model (tests, dry runs).

    It answers with the system text and the length of the last user text, and
    fails the first attempt of a user text whose length is divisible by 7.
    """

    def __call__(self, batch: Sequence[Sequence[dict]], attempt: int, temperature: float) -> list:
        return [self.one(messages, attempt) for messages in batch]

    def one(self, messages: Sequence[dict], attempt: int):
        system = "".join(m["content"] for m in messages if m["role"] == "system")
        user = [m["content"] for m in messages if m["role"] == "user"][-1]
        if attempt == 1 and len(user) % 7 == 0:
            return RuntimeError("overloaded")
        text = f"REASON: {system}\nACTION: {len(user)}"
        return text, len(system) + len(user), len(text)


def response_schema(key: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("request_id", key.dataType), T.StructField("attempt", T.IntegerType()), T.StructField("model", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
        T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])


def _call(generate: Generator, batch: list, attempt: int, temperature: float) -> list:
    """Answers of a batch; if the whole call fails, each request is tried alone."""
    try:
        return list(generate(batch, attempt, temperature))
    except Exception as e:
        if len(batch) == 1:
            return [e]
        return [_call(generate, [one], attempt, temperature)[0] for one in batch]


def attempts(requests: DataFrame, make_generator: Callable[[], Generator], retries: int = 3, valid: Callable[[str], bool] | None = None,
             key: str = "request_id", messages: str = "messages", model: str = "echo", temperature: float = TEMPERATURE, batch_size: int = 64) -> DataFrame:
    """One row per attempt of every request, not landed yet."""
    check = valid or (lambda t: "ACTION:" in t)
    schema = response_schema(requests.schema[key])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()  # one client per partition
        for pdf in batches:
            todo = [(k, [dict(m) for m in (ms if ms is not None else [])]) for k, ms in zip(pdf[key].tolist(), pdf[messages].tolist())]
            rows = []
            for attempt in range(1, retries + 1):
                again = []
                for i in range(0, len(todo), batch_size):
                    part = todo[i: i + batch_size]
                    for (k, ms), answer in zip(part, _call(generate, [ms for _, ms in part], attempt, temperature)):
                        if isinstance(answer, Exception):
                            rows.append((k, attempt, model, None, None, None, False, f"{type(answer).__name__}: {answer}"))
                        else:
                            rows.append((k, attempt, model, *answer, bool(check(answer[0])), None))
                        if not rows[-1][6]:
                            again.append((k, ms))
                todo = again
            out = pd.DataFrame(rows, columns=names)
            out["prompt_tokens"] = out["prompt_tokens"].astype("Int64")
            out["completion_tokens"] = out["completion_tokens"].astype("Int64")
            yield out

    return requests.select(key, messages).mapInPandas(run, schema)


def batch_generate(requests: DataFrame, make_generator: Callable[[], Generator], **options) -> DataFrame:
    """R15 (+U2): run the generator over every request (``key``, ``messages``) and land the attempts."""
    from episodeflow.session import scratch_path

    spark = requests.sparkSession
    rows = attempts(requests, make_generator, **options)
    path = scratch_path(spark, f"responses/{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
