"""S5 and S6 in many tasks: elements cut at any byte equal the whole file's."""

import json
import os
import random

import pytest
from pyspark.sql import types as T

from episodeflow.sources import json_ranges as J

ROW = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType()), T.StructField("a", T.ArrayType(T.StringType()))])


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "\n", "ab", " ", "\\\\\\", ":"]) for _ in range(rng.randrange(30)))


def cuts(path, size, opening="["):
    """Elements by the two passes in plain Python, as the tasks do them."""
    length = os.path.getsize(path)
    out, quotes, depth = [], 0, 0
    for start in range(0, length, size):
        end = min(start + size, length)
        out += list(J._cut(path, start, end, quotes % 2, depth, opening))
        _, _, n, outside, inside = J._count(path, start, end)
        depth += inside if quotes % 2 else outside
        quotes += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_range_size(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(J, "BLOCK", rng.choice([1, 2, 3, 7, 64]) if seed else 1 << 20)
    rows = [{"n": i, "t": odd_text(rng), "a": [odd_text(rng) for _ in range(rng.randrange(3))]} for i in range(12)] + ["\\", 3, None, [[]], {}]
    path = str(tmp_path / "a.json")
    put(path, " " * rng.choice([0, 200]) + json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    for size in (1, 2, 5, 17, 100, 10_000):
        got = cuts(path, size)
        assert [json.loads(e) for _, e, p in got] == rows and not any(p for _, _, p in got)
        assert [at for at, _, _ in got] == sorted(at for at, _, _ in got)


def test_array_files(spark, tmp_path):
    root = f"{tmp_path}/a b+1%20"
    rng = random.Random(3)
    rows = [{"n": i, "t": odd_text(rng) + "x" * (5000 if i == 7 else 0), "a": ["p", None]} for i in range(60)]
    put(f"{root}/train.json", json.dumps(rows))
    put(f"{root}/bom.json", b"\xef\xbb\xbf \n" + json.dumps(rows[:2]).encode())
    put(f"{root}/none.json", " [ ] ")
    put(f"{root}/object.json", '{"n": 1, "t": ["[", 2]}')
    put(f"{root}/short.json", json.dumps(rows[:3])[:-5])
    put(f"{root}/mixed.json", '[{"n": 1}, {"n": "x"}, 5, null, {"n": 2, "other": {}},]')
    put(f"{root}/bytes.json", b'[{"t": "\xff"}, {"n": 3}]')
    put(f"{root}/empty.json", "")
    for size in (64, 1 << 20):
        good, bad = J.scan_array(spark, root, ROW, size=size)
        got = {}
        for r in sorted(good.collect(), key=lambda r: (r.file, r.at)):
            got.setdefault(os.path.basename(r.file), []).append({"n": r.n, "t": r.t, "a": r.a})
        none = {"t": None, "a": None}
        assert got == {"train.json": rows, "bom.json": rows[:2], "short.json": rows[:2], "mixed.json": [{"n": 1, **none}, {"n": 2, **none}],
                       "bytes.json": [{"n": 3, **none}]}
        assert sorted((os.path.basename(r.file), r.problem) for r in bad.collect()) == [
            ("bytes.json", "no UTF-8"), *[("mixed.json", "not as the schema says")] * 3, ("object.json", "does not begin with ["), ("short.json", "cut short")]
    held = J.elements(spark, f"{root}/train.json", size=64)
    assert len({r[0] for r in held.selectExpr("spark_partition_id()").distinct().collect()}) > 1  # one file, several tasks


def test_map_files(spark, tmp_path):
    m = {f"k{i}": f'state "{i}" \\ {{,}}' for i in range(30)} | {'q"': "", "é": "ü"}
    put(f"{tmp_path}/s/m.json", json.dumps(m))
    put(f"{tmp_path}/s/twice.json", '{"a": "1", "b": null, "a": "2"}')
    put(f"{tmp_path}/s/list.json", "[1]")
    for size in (16, 1 << 20):
        good, bad = J.scan_map(spark, f"{tmp_path}/s", size=size)
        got = {}
        for r in good.collect():
            got.setdefault(os.path.basename(r.file), {})[r.id] = r.state
        assert got == {"m.json": m, "twice.json": {"a": "2", "b": None}}
        assert [(os.path.basename(r.file), r.problem) for r in bad.collect()] == [("list.json", "does not begin with {")]


def test_no_files(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    good, bad = J.scan_array(spark, str(tmp_path / "none"), ROW)
    assert good.columns == ["file", "at", "n", "t", "a"] and good.collect() == [] and bad.collect() == []
