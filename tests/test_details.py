"""S8 and J4 on files: only matched files are opened, missing and broken ones have a status."""

import json
import os

import pytest

from episodeflow.sources import details

SM = "run_dir string, model_id string, env_idx long, num_actions int"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def verbose(**scores):
    return json.dumps({"info": {"verbose": scores}, "more": [1, {"x": None}]}, indent=1)


def test_statuses_and_scores(spark, tmp_path):
    root = str(tmp_path / "all runs+1%20")
    put(f"{root}/a/org/m 1/0.json", verbose(r_type=1, r_att=0.5, r_price=None))
    put(f"{root}/a/org/m 1/1.json", "{\"info\": {\"verb")
    put(f"{root}/a/org/m 1/2.json", b"\xff\xfe")
    put(f"{root}/a/org/m 1/3.json", "")
    put(f"{root}/a/org/m 1/4.json", "{}")
    put(f"{root}/a/org/m 1/5.json", "[1]")
    put(f"{root}/a/org/m 1/6.json", verbose(r_type="high", r_att=1))
    put(f"{root}/b/org/m 1/0.json", "\ufeff" + verbose(r_option=0.25))
    put(f"{root}/b/m+é/0.json", " \n" + verbose(r_type=0.125))
    rows = [(f"{root}/a", "org/m 1", i, i) for i in range(8)] + [(f"{root}/b", "org/m 1", 0, 8), (f"{root}/b", "m+é", 0, 9), (f"{root}/b", "m+é", 0, 9),
            (f"{root}/b", None, 0, 10), (None, "m+é", 0, 11), (f"{root}/b", "m+é", None, 12)]
    got = sorted(tuple(r)[3:] for r in details.detail_scan(spark.createDataFrame(rows, SM), root).collect())
    zero = (0.0, 0.0, 0.0, 0.0)
    assert got == [
        (0, "read", 1.0, 0.5, 0.0, 0.0), (1, "unreadable", *zero), (2, "unreadable", *zero), (3, "missing", *zero), (4, "read", *zero),
        (5, "unreadable", *zero), (6, "unreadable", *zero), (7, "missing", *zero), (8, "read", 0.0, 0.0, 0.0, 0.25), (9, "read", 0.125, 0.0, 0.0, 0.0),
        (9, "read", 0.125, 0.0, 0.0, 0.0), (10, "missing", *zero), (11, "missing", *zero), (12, "missing", *zero)]


def test_only_matched_files_are_opened(spark, tmp_path):
    root = str(tmp_path)
    for i in range(6):
        put(f"{root}/r/m/{i}.json", verbose(r_type=i))
    listed = details.listed_files(spark, root)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    sm = spark.createDataFrame([(f"{root}/r", "m", i, 0) for i in (1, 1, 4, 9)], SM)
    wanted = sm.selectExpr("concat(run_dir, '/', model_id, '/', env_idx, '.json') AS detail_path")
    opened = details.matched_texts(wanted, listed)
    assert sorted(os.path.basename(r.detail_path) for r in opened.collect()) == ["1.json", "4.json"]


def test_paths_are_joined_above_the_packed_listing(spark, tmp_path):
    """Below it, a listing task would take a table of all paths for each of its scan partitions."""
    root = str(tmp_path)
    for i in range(3):
        put(f"{root}/r/m/{i}.json", verbose(r_type=i))
    wanted = spark.createDataFrame([(f"{root}/r/m/{i}.json",) for i in (1, 1, 2, 9)] + [(None,)], "detail_path string")
    found = details.wanted_files(wanted, details.listed_files(spark, root))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.split("Repartition ")[0] and "Join" not in plan.split("Repartition ")[1]
    assert found.columns == ["detail_path", "uri", "length"]
    assert sorted(os.path.basename(r.detail_path) for r in found.collect()) == ["1.json", "2.json"]


def test_no_rows_no_files_and_clashes(spark, tmp_path):
    os.makedirs(tmp_path / "empty")
    sm = spark.createDataFrame([("/r", "m", 1, 0)], SM)
    assert [r.detail_status for r in details.detail_scan(sm, str(tmp_path / "empty")).collect()] == ["missing"]
    put(f"{tmp_path}/r/m/1.json", verbose(r_type=1))
    assert details.detail_scan(sm.limit(0), str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="r_att"):
        details.detail_scan(sm.selectExpr("*", "1.0 AS r_att"), str(tmp_path))
