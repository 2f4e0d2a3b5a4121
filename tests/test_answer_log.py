"""R15 with a log: no call is repeated after a failed job; equal requests are asked once."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle

from episodeflow.operators.answer_log import generate_logged, read_log

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module

KIND = "request_id string, messages array<struct<role:string,content:string>>"


class Killed(BaseException):
    """Ends a worker, unlike an answer's exception."""


def factory(journal, fatal=None):
    """Generator that notes every call in a folder; garbled first attempts for texts with 'g', dies at ``fatal``."""
    def make():
        def generate(batch, attempt, temperature):
            out = []
            for ms in batch:
                text = ms[-1]["content"] if ms else ""
                if fatal is not None and text == fatal:
                    raise Killed(fatal)
                with open(f"{journal}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{text}#{attempt}")
                if "e" in text:
                    raise TimeoutError("slow")
                out.append(("garbled" if "g" in text and attempt == 1 else f"ACTION: {text}", 1, 2))
            return out
        return generate
    return make


def calls(journal):
    return sorted(open(f"{journal}/{n}").read() for n in os.listdir(journal))


def frame(spark, texts):
    return spark.createDataFrame([(f"r{i}", [("user", t)] if t is not None else None) for i, t in enumerate(texts)], KIND)


@pytest.fixture()
def place(tmp_path):
    os.makedirs(tmp_path / "journal")
    return str(tmp_path / "journal"), str(tmp_path / "the log")


def test_failed_job_resumes_without_repeated_calls(spark, place):
    journal, log = place
    texts = [f"t{i}" for i in range(20)] + ["g1", "g2", "t3", "t3", "e", None]
    req = frame(spark, texts)
    with pytest.raises(Exception, match="Killed"):
        generate_logged(req, factory(journal, fatal="t11"), log, "one", batch_size=1, tasks=1)
    before = calls(journal)
    assert 0 < len(before) < 20 and not any(c.startswith("t11") for c in before)
    out = generate_logged(req, factory(journal), log, "two", batch_size=1, tasks=3).collect()
    expected = sorted([f"t{i}#1" for i in range(20)] + ["g1#1", "g1#2", "g2#1", "g2#2", "#1"] + [f"e#{n}" for n in (1, 2, 3)])
    assert calls(journal) == expected  # each call once over both runs
    assert {(r.request_id, r.attempt): (r.text, r.ok, r.error) for r in out} == {
        **{(f"r{i}", 1): (f"ACTION: t{i}", True, None) for i in range(20)},
        **{(f"r{i}", 1): ("garbled", False, None) for i in (20, 21)}, **{(f"r{i}", 2): (f"ACTION: {texts[i]}", True, None) for i in (20, 21)},
        ("r22", 1): ("ACTION: t3", True, None), ("r23", 1): ("ACTION: t3", True, None), ("r25", 1): ("ACTION: ", True, None),
        **{("r24", n): (None, False, "TimeoutError: slow") for n in (1, 2, 3)}}
    assert {r.run for r in out} == {"one", "two"}
    generate_logged(req, factory(journal), log, "three")
    assert calls(journal) == expected  # nothing left to ask
    more = generate_logged(req, factory(journal), log, "four", retries=4).where("request_id = 'r24'").count()
    assert more == 4 and calls(journal) == sorted([*expected, "e#4"])


def test_task_tried_again_reads_what_it_left(spark, place):
    journal, log = place
    req = frame(spark, [f"t{i}" for i in range(12)])
    with pytest.raises(Exception, match="Killed"):
        generate_logged(req, factory(journal, fatal="t5"), log, "one", batch_size=1, tasks=1)
    generate_logged(req, factory(journal), log, "one", batch_size=5, tasks=1)  # same run name, so the same part files
    assert calls(journal) == sorted(f"t{i}#1" for i in range(12))


def test_settings_are_part_of_a_request_and_no_requests(spark, place):
    journal, log = place
    req = frame(spark, ["a", "b"])
    assert generate_logged(req.limit(0), factory(journal), log, "none").collect() == [] and read_log(spark, log).count() == 0
    generate_logged(req, factory(journal), log, "one")
    generate_logged(req, factory(journal), log, "two", temperature=0.9)
    generate_logged(req, factory(journal), log, "three", model="other")
    assert calls(journal) == sorted(["a#1", "b#1"] * 3)
    assert sorted(r.run for r in generate_logged(req, factory(journal), log, "four", temperature=0.9).collect()) == ["two", "two"]
