"""ST1, ST2, W3: batches landed by id, ended runs, folds and carried totals."""

import os

import pytest

from episodeflow.streaming import landed as L
from episodeflow.streaming import stream as ST

CALLS = "model string, run_id long, step int, cost_units long"


def add(spark, folder, rows, kind, files=1):
    spark.createDataFrame(rows, kind).repartition(files).write.mode("append").parquet(folder)


def test_ended_run_goes_on_exactly_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = spark.createDataFrame([], "n long").schema
    add(spark, src, [(i,) for i in range(40)], "n long", 4)
    rows = ST.file_stream(spark, src, schema, max_files=1)
    assert L.append_batches(rows, ckpt, out, max_batches=2) is False
    assert L.batches(out) == [0, 1] and not os.path.exists(f"{ckpt}/commits/1")  # landed, not committed
    add(spark, src, [(i,) for i in range(40, 50)], "n long")
    assert L.append_batches(rows, ckpt, out) is True
    assert sorted(r.n for r in L.read_landed(spark, out, schema).collect()) == list(range(50))
    assert L.append_batches(rows, ckpt, out) is True and L.read_landed(spark, out, schema).count() == 50


def test_batch_without_success_is_not_read(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = spark.createDataFrame([], "n long").schema
    spark.range(3).toDF("n").write.parquet(f"{out}/batch=0")
    spark.range(3).toDF("n").write.parquet(f"{out}/batch=1")
    os.remove(f"{out}/batch=1/_SUCCESS")
    assert L.batches(out) == [0] and L.read_landed(spark, out, schema).count() == 3
    assert L.read_landed(spark, str(tmp_path / "nothing"), schema).collect() == []


def test_other_failures_are_not_swallowed(spark, tmp_path):
    src = str(tmp_path / "in")
    add(spark, src, [(1,)], "n long")

    def land(batch, batch_id):
        raise KeyError("broken sink")

    with pytest.raises(Exception, match="broken sink"):
        L.run_landed(ST.file_stream(spark, src, spark.createDataFrame([], "n long").schema), str(tmp_path / "ckpt"), land)


def test_fold_keeps_the_latest_row(spark, tmp_path):
    out = str(tmp_path / "out")
    kind = "k string, v long"
    schema = spark.createDataFrame([], kind).schema
    for i, rows in enumerate([[("a", 1), (None, 1)], [("b", 2)], [("a", 3), (None, None)], [("c", 4)]]):
        spark.createDataFrame(rows, kind).write.parquet(f"{out}/batch={i}")
    want = {("a", 3), ("b", 2), (None, None), ("c", 4)}
    now = lambda: {(r.k, r.v) for r in L.read_current(spark, out, schema, ["k"]).collect()}
    assert now() == want
    L.fold_batches(spark, out, schema, ["k"], 2)
    assert L.batches(out) == [2, 3] and L.batches(out, "folded") == [1] and now() == want
    # A fold that ended before it removed anything: readers pass over the folded batches, the next one removes them.
    spark.createDataFrame([("a", 3), ("b", 2), (None, None)], kind).write.parquet(f"{out}/folded=2")
    assert now() == want
    L.fold_batches(spark, out, schema, ["k"], 3)
    assert L.batches(out) == [3] and L.batches(out, "folded") == [2] and now() == want
    L.fold_batches(spark, out, schema, ["k"], 3)
    assert now() == want


def test_many_batches_are_folded_on_the_way(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    add(spark, src, [(i, None, 1, f"t{i % 3}", 1.0, "{}") for i in range(60)], kind, 6)
    events = ST.file_stream(spark, src, ST.EVENTS, max_files=1)
    got = ST.run_to_sink(ST.counter_stream(events), "t", ["action"], checkpoint=ckpt, fold_every=2)
    assert {r.action: r.n for r in got.collect()} == {"t0": 20, "t1": 20, "t2": 20}
    assert L.batches(f"{ckpt}-results", "folded") == [3] and L.batches(f"{ckpt}-results") == [4, 5]


def test_running_cost_over_batches_with_nulls_and_an_ended_run(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = spark.createDataFrame([], CALLS).schema
    parts = [[("m", 1, s, 10 * s) for s in range(5)] + [(None, 1, 0, 7)], [("m", 2, 0, None), ("n", 2, 1, 3)],
             [("m", 3, s, 1) for s in range(40)] + [(None, 3, 0, 1)]]
    for i, part in enumerate(parts):
        add(spark, src, part, CALLS, 2)
        calls = ST.file_stream(spark, src, schema)
        if i != 1:
            assert L.stream_cost(calls, ckpt, out, "model", ["run_id", "step"], max_batches=1) is False
        assert L.stream_cost(calls, ckpt, out, "model", ["run_id", "step"]) is True
    total, count, want = {}, {}, {}
    for m, r, s, c in sorted((x for p in parts for x in p), key=lambda x: (x[0] or "", x[1], x[2])):
        total[m], count[m] = total.get(m, 0) + (c or 0), count.get(m, 0) + 1
        want[m, r, s] = (total[m], count[m])
    got = L.read_cost(spark, out, schema, "model").collect()
    assert len(got) == len(want) and {(r.model, r.run_id, r.step): (r.total_units, r.position) for r in got} == want
    last = max((r for r in got if r.model == "m"), key=lambda r: r.position)
    assert last.projected_cost == pytest.approx(last.running_cost) and last.position == 46
    assert len(L.batches(f"{out}-totals")) <= 2
