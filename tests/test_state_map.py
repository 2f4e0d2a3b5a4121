"""A stored map that runs update by key; three runs are one fold."""

import os

import pytest
from pyspark.sql import functions as F

from episodeflow.sources import state_map as SM

KIND = "id string, seq int, state string"
MAP = "id string, seq int, state string, run string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), KIND)


def put(df, path, run, buckets=4):
    return SM.upsert_states(df, path, run, "id", "state", ["seq"], buckets)


def held(spark, path):
    return {r.id: (r.seq, r.state, r.run) for r in SM.read_states(spark, path, MAP).collect()}


def test_runs_in_any_order_equal_one_fold(spark, tmp_path):
    everything = [(f"k{i % 13}", i, None if i % 5 == 0 else f"s{i}") for i in range(60)] + [(None, 3, "n"), (None, 9, None), ("k1", None, "z")]
    parts = [[r for j, r in enumerate(everything) if j % 3 == k] for k in range(3)]
    want = {}
    for k, part in enumerate(parts):
        for key, seq, state in part:
            order = lambda s, t: (s is not None, s or 0, t is not None, t or "")
            if key not in want or order(seq, state) > order(*want[key][:2]):
                want[key] = (seq, state, f"r{k}")
    for n, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        path = str(tmp_path / f"map{n}")
        for k in order:
            put(rows(spark, *parts[k]), path, f"r{k}")
        assert held(spark, path) == want


def test_ties_repeats_and_old_rows(spark, tmp_path):
    path = str(tmp_path / "map")
    put(rows(spark, ("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 5, "new")), path, "one")
    assert held(spark, path) == {"a": (1, "y", "one"), "b": (5, "new", "one")}
    assert put(rows(spark, ("a", 9, "late")), path, "one") == 0  # an applied run does nothing
    put(rows(spark, ("b", 2, "old"), ("a", 1, "y")), path, "two")
    assert held(spark, path) == {"a": (1, "y", "two"), "b": (5, "new", "one")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "map")
    put(rows(spark, *[(f"k{i}", 1, "s") for i in range(50)]), path, "one", 8)
    files = lambda: {b: sorted(f for f in os.listdir(f"{path}/{b}") if f.endswith(".parquet")) for b in os.listdir(path) if b.startswith("bucket=")}
    before = files()
    assert len(before) == 8
    assert put(rows(spark, ("k7", 2, "t")), path, "two", 3) == 1  # the number of buckets stays that of the first run
    after = files()
    assert sum(before[b] != after[b] for b in before) == 1 and held(spark, path)["k7"] == (2, "t", "two")
    assert len(held(spark, path)) == 50


def test_run_that_ended_half_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "map")
    put(rows(spark, ("a", 1, "x"), ("b", 1, "x")), path, "one")
    real = SM._mark

    def lost(name, text=""):
        if "_applied-" in name:
            raise OSError("driver lost")
        real(name, text)

    monkeypatch.setattr(SM, "_mark", lost)
    two = rows(spark, ("a", 2, "y"), ("c", 1, "z"))
    with pytest.raises(OSError):
        put(two, path, "two")
    monkeypatch.setattr(SM, "_mark", real)
    for b in os.listdir(path):  # buckets that the commit had removed and not yet replaced
        if b.startswith("bucket=") and os.path.exists(f"{path}-runs/two/{b}"):
            for f in os.listdir(f"{path}/{b}"):
                os.remove(f"{path}/{b}/{f}")
    with pytest.raises(ValueError, match="not applied"):
        put(two, path, "three")
    put(rows(spark), path, "two")  # what was merged before is taken, not the rows given now
    assert held(spark, path) == {"a": (2, "y", "two"), "b": (1, "x", "one"), "c": (1, "z", "two")}


def test_empty_runs_and_names(spark, tmp_path):
    path = str(tmp_path / "map")
    assert put(rows(spark), path, "none") == 0 and held(spark, path) == {}
    put(rows(spark, ("", 0, "")), path, "one")
    assert held(spark, path) == {"": (0, "", "one")}
    with pytest.raises(ValueError):
        put(rows(spark), path, "../x")
    wide = rows(spark, ("q", 1, "s")).withColumns({"bucket": F.lit("b"), "run": F.lit("r"), "w": F.lit(1)})
    put(wide, path, "two")
    assert held(spark, path)["q"] == (1, "s", "two")
