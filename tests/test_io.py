"""File sources, sinks and streams on small authored fixtures in temp folders."""

import json
import os

from pyspark.sql import functions as F

from episodeflow.operators import steps as S
from episodeflow.sources import files, sinks
from episodeflow.streaming import stream as ST


def _write(path, obj, raw=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(obj if raw else json.dumps(obj))


def test_episode_dir_scan_and_rejects(spark, tmp_path):
    d = str(tmp_path / "logs")
    step = {"observation": "o", "action": "a", "reason": "r", "score": 0.5, "candidate_actions": ["a", "b"]}
    _write(f"{d}/3.json", {"gamefile": "g", "trajectory": [step, dict(step, score=1.0)]})
    _write(f"{d}/12.json", {"gamefile": "h", "trajectory": [dict(step, is_corrected=False)]})
    _write(f"{d}/7.json", {"message": "no trajectory here"})
    _write(f"{d}/x1.json", {"trajectory": [step]})
    _write(f"{d}/notes.txt", "ignored", raw=True)
    eps, rej = files.scan_episode_dir(spark, d)
    assert sorted(r.episode_name for r in eps.collect()) == ["12", "3", "x1"]
    assert [r.reject_reason for r in rej.collect()] == ["no trajectory"]
    eps, rej = files.scan_episode_dir(spark, d, numbered=True)
    assert sorted(r.episode_id for r in eps.collect()) == [3, 12]
    assert sorted(r.reject_reason for r in rej.collect()) == ["no trajectory", "non-numeric file stem"]
    st = files.episode_steps(eps)
    got = sorted((r.episode_id, r.step, r.score) for r in st.collect())
    assert got == [(3, 0, 0.5), (3, 1, 1.0), (12, 0, 0.5)]
    e = S.episodes(st.select("episode_id", "step", "score"))
    assert {r.episode_id: r.last_score for r in e.collect()} == {3: 1.0, 12: 0.5}


def test_jsonl_demo_zip(spark, tmp_path):
    from episodeflow.operators.candidates import zip_demo
    p = str(tmp_path / "demo.jsonl")
    recs = [{"states": ["s0", "s1", "s2"], "available_actions": [[], ["a", "b"], ["c"]],
             "actions": ["free text", "x", "y"], "action_idxs": [0, -1, 5]}]
    _write(p, "\n".join(json.dumps(r) for r in recs), raw=True)
    demos = files.scan_jsonl(spark, p).withColumn("episode_id", F.lit(1))
    ok, rej = zip_demo(demos)
    assert [(r.step, r.action) for r in ok.orderBy("step").collect()] == [(0, "search[search query]"), (1, "x")]
    assert [r.step for r in rej.collect()] == [2]


def test_summary_discovery_and_details(spark, tmp_path):
    root = str(tmp_path / "eval")
    _write(f"{root}/runA/summary.csv", "env_idx,gamefile,model_id,num_actions,score\n1,g/a,org/m1,5,1.0\n", raw=True)
    _write(f"{root}/runB/sub/summary.csv", "env_idx,gamefile,model_id,num_actions,score\n2,g/b,m2,20,0.0\n", raw=True)
    sm = files.discover_summaries(spark, root)
    got = sorted((r.env_idx, os.path.basename(r.run_dir)) for r in sm.collect())
    assert got == [(1, "runA"), (2, "sub")]
    _write(f"{root}/runA/org/m1/1.json", {"info": {"verbose": {"r_att": 0.5, "r_type": 1.0}}})
    det = files.scan_eval_details(spark, f"{root}/runA")
    r = det.collect()[0]
    assert (r.model_id, r.env_idx, r.r_att, r.r_type, r.r_price) == ("org/m1", 1, 0.5, 1.0, 0.0)


def test_summaries_of_two_families_and_odd_paths(spark, tmp_path):
    """Columns are bound by each file's header; paths with spaces, plus and percent signs are keys."""
    root = str(tmp_path / "all runs+%41")
    _write(f"{root}/shop/summary.csv", "env_idx,model_id,num_actions,score\n500,org/m1,7,0.5\n", raw=True)
    _write(f"{root}/game 2/summary.csv", "env_idx,gamefile,model_id,num_actions,score\n1,\"g,a\",m2,5,1.0\n", raw=True)
    _write(f"{root}/shop/org/m1/500.json", {"info": {"verbose": {"r_att": 0.5}}})
    _write(f"{root}/game 2/m2/1.json", {"info": {}})
    sm = files.discover_summaries(spark, root)
    got = sorted(tuple(r) for r in sm.select("env_idx", "gamefile", "model_id", "num_actions", "score", "run_dir").collect())
    assert got == [(1, "g,a", "m2", 5, 1.0, f"{root}/game 2"), (500, None, "org/m1", 7, 0.5, f"{root}/shop")]
    one = files.scan_summary_csv(spark, f"{root}/shop/summary.csv").first()
    assert tuple(one) == (500, None, "org/m1", 7, 0.5)
    det = files.scan_eval_details(spark, root)
    key = files.detail_key(F.col("run_dir"), F.col("model_id"), F.col("env_idx"))
    joined = sm.withColumn("detail_path", key).join(det.select("detail_path", "r_att"), "detail_path", "left")
    assert sorted((r.env_idx, r.r_att) for r in joined.collect()) == [(1, 0.0), (500, 0.5)]
    assert sorted((r.model_id, r.env_idx) for r in files.scan_eval_details(spark, f"{root}/shop").collect()) == [("org/m1", 500)]


def test_state_map_and_last_wins(spark, tmp_path):
    p = str(tmp_path / "state.json")
    _write(p, {"1": "a", "2": "b", "2": "c"} if False else '{"1": "a", "2": "b", "2": "c"}', raw=True)
    m = {r.id: r.state for r in files.scan_state_map(spark, p).collect()}
    assert m == {"1": "a", "2": "c"}
    rows = spark.createDataFrame([("7", "old", 1), ("7", "new", 2), ("8", "x", 1)], "id string, state string, seq int")
    last = {r.id: r.state for r in sinks.state_last_wins(rows, "id", "state", ["seq"]).collect()}
    assert last == {"7": "new", "8": "x"}


def test_iterations_partition_pruning(spark, tmp_path):
    root = str(tmp_path / "sets")
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "iter int, text string")
    sinks.write_rows(rows, root, ["iter"])
    df = files.scan_iterations(spark, root, 2, fmt="parquet")
    assert sorted(r.iter for r in df.collect()) == [0, 1, 2]
    assert "PartitionFilters: [isnotnull(iter" in df._jdf.queryExecution().executedPlan().toString()


def test_encode_values(spark):
    df = spark.sql("SELECT CAST(1.25 AS DECIMAL(5,2)) AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t0, "
                   "TIMESTAMP_NTZ'2024-01-02 03:04:05.123400' AS t1, 'x' AS s")
    r = sinks.encode_values(df).first()
    assert r == (1.25, "2024-01-02T03:04:05", "2024-01-02T03:04:05.123400", "x")


def test_stream_resume_exactly_once(spark, tmp_path):
    src = str(tmp_path / "in")
    ckpt = str(tmp_path / "ckpt")
    os.makedirs(src)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    first = spark.createDataFrame([(1, None, 1, "click", 1.0, "{}"), (2, None, 1, "view", 2.0, "{}")], schema)
    first.write.mode("append").parquet(src)
    run = lambda: ST.run_to_sink(ST.counter_stream(ST.file_stream(spark, src, ST.EVENTS)), "t", ["action"], checkpoint=ckpt)
    out1 = run()
    assert {r.action: r.n for r in out1.collect()} == {"click": 1, "view": 1}
    spark.createDataFrame([(3, None, 2, "click", 1.0, "{}")], schema).write.mode("append").parquet(src)
    assert {r.action: r.n for r in run().collect()} == {"click": 2, "view": 1}
    assert {r.action: r.n for r in run().collect()} == {"click": 2, "view": 1}  # nothing new


def test_split_sink_training_scan_and_append(spark, tmp_path):
    from episodeflow.operators import prompts as P
    rows = spark.createDataFrame([(1, "p1", "r1", "train"), (2, "p2", "r2", "test")],
                                 "episode_id long, p string, r string, split string")
    sft = rows.select("split", P.message("user", F.col("p")).alias("prompt"),
                      P.message("assistant", F.col("r")).alias("response"))
    out = str(tmp_path / "ds")
    sinks.write_splits(sft, out, fmt="json")
    assert sorted(x for x in os.listdir(out) if x.startswith("split=")) == ["split=test", "split=train"]
    back = spark.read.schema(files.SFT_ROW).json(f"{out}/split=train")
    assert [r.prompt[0].content for r in back.collect()] == ["p1"]
    arr = str(tmp_path / "train.json")
    with open(arr, "w") as f:
        json.dump([{"prompt": [{"role": "user", "content": "a"}], "response": [{"role": "assistant", "content": "b"}]},
                   {"prompt": [{"role": "user", "content": "c"}], "response": [{"role": "assistant", "content": "d"}]}], f)
    ts = files.scan_training_set(spark, arr)
    assert sorted(r.response[0].content for r in ts.collect()) == ["b", "d"]
    summ = str(tmp_path / "summ")
    first = spark.createDataFrame([(1, "m", 3, 1.0)], "env_idx long, model_id string, num_actions int, score double")
    sinks.append_summary(first, summ)
    sinks.append_summary(first.withColumn("env_idx", F.lit(2).cast("long")), summ)
    assert sorted(r.env_idx for r in spark.read.parquet(summ).collect()) == [1, 2]


def test_episode_sink_partitioned(spark, tmp_path):
    out = str(tmp_path / "episodes")
    df = spark.createDataFrame([("game", 0, 1, 0, "o"), ("shop", 1, 2, 0, "p")],
                               "family string, iter int, episode_id long, step int, observation string")
    sinks.write_rows(df, out, ["family", "iter"])
    back = spark.read.parquet(out).where((F.col("family") == "shop") & (F.col("iter") == 1))
    assert [r.episode_id for r in back.collect()] == [2]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "family" in plan


def test_summary_csv_iter_folders_and_to_text(spark, tmp_path):
    p = str(tmp_path / "s.csv")
    _write(p, "env_idx,gamefile,model_id,num_actions,score\n3,a/b,m,7,0.5\n", raw=True)
    r = files.scan_summary_csv(spark, p).first()
    assert (r.env_idx, r.model_id, r.num_actions, r.score) == (3, "m", 7, 0.5)
    root = str(tmp_path / "mix")
    for k in range(3):
        _write(f"{root}/iter{k}/train.json", [{"prompt": [{"role": "user", "content": f"p{k}"}],
                                               "response": [{"role": "assistant", "content": "r"}]}])
    got = files.scan_iterations(spark, root, 1)
    assert sorted((r.iter, r.prompt[0].content) for r in got.collect()) == [(0, "p0"), (1, "p1")]
    df = spark.sql("SELECT named_struct('a', 1) AS s, 'x' AS t, 2 AS n")
    out = df.select(*[sinks.to_text(F.col(f.name), f.dataType) for f in df.schema.fields]).first()
    assert tuple(out) == ('{"a":1}', "x", "2")


def test_natural_sort_limit_rejects(spark):
    from episodeflow.operators.ordering import natural_sort_limit
    files_df = spark.createDataFrame([("10.json",), ("9.json",), ("abc.json",), ("100.json",)], "name string")
    good, rej = natural_sort_limit(files_df, "name", 2)
    assert [r.name for r in good.collect()] == ["9.json", "10.json"]
    assert [r.name for r in rej.collect()] == ["abc.json"]


def test_batch_generate_retries_and_pluggable_generator(spark):
    from episodeflow.operators.generate import batch_generate

    class FlakyFactory:
        """Garbled on the first attempt, then a raising call for one prompt (deterministic, picklable)."""

        def __call__(self):
            def gen(batch, attempt, temperature):
                if attempt == 2 and any(m[-1]["content"] == "b" for m in batch):
                    raise TimeoutError("slow")
                return [("ACTION: go" if attempt > 1 else "garbled", len(m), 2) for m in batch]
            return gen

    kind = "request_id string, messages array<struct<role:string,content:string>>"
    req = spark.createDataFrame([("x1", [("system", "s"), ("user", "a")]), ("x2", [("user", "b")])], kind).coalesce(1)
    out = batch_generate(req, FlakyFactory(), retries=3)
    rows = sorted((r.request_id, r.attempt, r.ok, r.error, r.prompt_tokens) for r in out.collect())
    assert rows == [("x1", 1, False, None, 2), ("x1", 2, True, None, 2), ("x2", 1, False, None, 1),
                    ("x2", 2, False, "TimeoutError: slow", None), ("x2", 3, True, None, 1)]
    out2 = batch_generate(req, FlakyFactory(), retries=2)
    assert {(r.request_id, r.attempt, r.ok) for r in out2.collect()} == {("x1", 1, False), ("x1", 2, True), ("x2", 1, False), ("x2", 2, False)}
    assert batch_generate(req.limit(0), FlakyFactory()).collect() == []


def test_running_summary_updates_incrementally(spark, tmp_path):
    import datetime
    src = str(tmp_path / "ev")
    ckpt = str(tmp_path / "ck")
    os.makedirs(src)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, 7, "view", 1.0, "{}"), (2, t + datetime.timedelta(seconds=1), 7, "click", 2.0, "{}")],
                          schema).write.mode("append").parquet(src)
    out1 = ST.run_to_sink(ST.summary_stream(ST.file_stream(spark, src, ST.EVENTS)), "s", ["episode_id"], checkpoint=ckpt)
    assert [(r.episode_id, r.num_actions, r.score) for r in out1.collect()] == [(7, 2, 2.0)]
    spark.createDataFrame([(3, t + datetime.timedelta(seconds=2), 7, "purchase", 9.0, "{}"),
                           (4, t, 8, "view", 4.0, "{}")], schema).write.mode("append").parquet(src)
    out2 = ST.run_to_sink(ST.summary_stream(ST.file_stream(spark, src, ST.EVENTS)), "s", ["episode_id"], checkpoint=ckpt)
    assert sorted((r.episode_id, r.num_actions, r.score) for r in out2.collect()) == [(7, 3, 9.0), (8, 1, 4.0)]


def test_table_stream_reads_one_file_or_a_folder(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.createDataFrame([(i, None, 1, "click", 1.0, "{}") for i in range(5)], schema)
    rows.repartition(3).write.parquet(str(tmp_path / "a" / "events.parquet"))
    part = next((tmp_path / "a" / "events.parquet").glob("part-*"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "events.parquet").write_bytes(part.read_bytes())
    n = spark.read.parquet(str(part)).count()
    for folder, want in (("a", 5), ("b", n)):
        got = ST.run_to_sink(ST.counter_stream(ST.table_stream(spark, str(tmp_path / folder), "events", ST.EVENTS)), "t", ["action"])
        assert [tuple(r) for r in got.collect()] == [("click", want)]
