"""Files under their own names; tasks tried again, failing jobs, odd names."""

import os

import pytest
from pyspark.sql import functions as F

from episodeflow.sources import files, sinks
from episodeflow.sources.named_files import NamedFilesWriter


def listing(path):
    return sorted(n for n in os.listdir(path) if n != "_SUCCESS" and not n.startswith("."))


def test_episodes_round_trip(spark, tmp_path):
    rows = [(n, n, [("o", "a"), ("é\n", None)]) for n in ("7", "a b", "x+y", "ü%20", "12")] + [("none", None, [])]
    eps = spark.createDataFrame(rows, "episode_name string, task string, trajectory array<struct<observation:string,action:string>>")
    path = str(tmp_path / "out dir")
    for pretty in (False, True):  # the second write replaces the first
        sinks.write_episodes(eps.repartition(4), path, pretty=pretty)
        assert listing(path) == sorted(f"{n}.json" for n, _, _ in rows)
        good, bad = files.scan_episode_dir(spark, path)
        back = {r.episode_name: r for r in good.collect()}
        assert set(back) == {n for n, _, _ in rows} and bad.count() == 0
        assert back["a b"].task == "a b" and back["7"].episode_id == 7 and [s.observation for s in back["ü%20"].trajectory] == ["o", "é\n"]
    assert not [n for n in os.listdir(tmp_path) if ".writing-" in n]


def test_overwrite_replaces_and_append_adds(spark, tmp_path):
    path = str(tmp_path / "f")
    frame = lambda *names: spark.createDataFrame([(n, f"text of {n}") for n in names], "n string, t string")
    sinks.write_named(frame("a", "b"), path, "n", "t")
    sinks.write_named(frame("b", "c"), path, "n", "t", "append")
    assert listing(path) == ["a", "b", "c"]
    sinks.write_named(frame("d"), path, "n", "t")
    assert listing(path) == ["d"] and open(f"{path}/d").read() == "text of d"
    sinks.write_named(frame("d").limit(0), path, "n", "t")
    assert listing(path) == []


@pytest.mark.parametrize("bad", [None, "", "a/b", "..", "keep2"])
def test_a_failed_job_leaves_the_target(spark, tmp_path, bad):
    path = str(tmp_path / "f")
    sinks.write_named(spark.createDataFrame([("keep", "1")], "n string, t string"), path, "n", "t")
    rows = spark.createDataFrame([(f"new{i}", "2") for i in range(20)] + [("keep2", "x"), (bad, "y")], "n string, t string")
    with pytest.raises(Exception, match="file name"):
        sinks.write_named(rows, path, "n", "t")
    assert listing(path) == ["keep"] and os.listdir(tmp_path) == ["f"]


def test_a_task_tried_again_writes_the_same_files(spark, tmp_path):
    """A first try of each task fails after all its files are in place."""
    path = str(tmp_path / "f")
    w = NamedFilesWriter(path, True)
    rows = spark.range(30).select(F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("string").alias("text"))

    def twice(batches):
        held = list(batches)
        w.write(iter(held))
        yield from held

    assert rows.repartition(3, "name").mapInArrow(twice, "name string, text string").count() == 30
    assert rows.repartition(5, "name").mapInArrow(twice, "name string, text string").count() == 30
    w.commit([])
    assert listing(path) == sorted(f"n{i}" for i in range(30)) and {open(f"{path}/n{i}").read() for i in range(30)} == {str(i) for i in range(30)}
    assert os.listdir(tmp_path) == ["f"]


def test_many_small_files_share_tasks(spark, tmp_path):
    """A task takes many files, and types steps once, not for each few files that Spark packs."""
    steps = [[("o", "a")] * (i % 3) for i in range(40)]
    eps = spark.createDataFrame([(str(i), s) for i, s in enumerate(steps)], "episode_name string, trajectory array<struct<observation:string,action:string>>")
    path = str(tmp_path / "out")
    sinks.write_episodes(eps, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # a scan partition for each file
    try:
        good, bad = files.scan_episode_dir(spark, path, numbered=True)
        rows = files.episode_steps(good).select("episode_id", "step", "observation", "action")
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        plan = rows._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")
        assert "try_variant_get" in plan[0] and "try_variant_get" not in plan[1]
        assert sorted(map(tuple, rows.collect())) == [(i, k, "o", "a") for i, s in enumerate(steps) for k in range(len(s))]
        assert good.count() == 40 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
