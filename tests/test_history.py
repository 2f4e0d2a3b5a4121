"""Shared-prefix histories against the window form, and a long episode in several tasks."""

import pytest
from pyspark.sql import functions as F

from episodeflow.operators import steps as S
from episodeflow.plans import bind

from data_paths import SMOKE


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("chunk", [1, 3, 4, 256])
def test_equal_to_the_window_form(spark, chunk):
    st = bind.text_steps(bind.Tables(spark, SMOKE).conversations)
    want = S.step_history_text(st).withColumn("n_history", F.col("n_history").cast("long"))
    assert rows_of(S.shared_history(st, chunk=chunk).select(want.columns)) == rows_of(want)


def test_null_episode_gaps_and_odd_texts(spark):
    rows = [(None, 0, "a", "b'"), (None, 1, None, "c\n"), (1, 0, "", ""), (1, 5, "é ", "x"), (1, 9, "z", None), (2, 7, "only", "late")]
    st = spark.createDataFrame(rows, "episode_id long, step int, observation string, action string")
    want = S.step_history_text(st).withColumn("n_history", F.col("n_history").cast("long"))
    assert rows_of(S.shared_history(st, chunk=2).select(want.columns)) == rows_of(want)
    assert S.shared_history(st.limit(0)).collect() == []


def test_a_long_episode_is_written_by_several_tasks(spark):
    n = 4000
    st = spark.range(n).select(F.lit(7).alias("episode_id"), F.col("id").cast("int").alias("step"), F.concat(F.lit("o"), F.col("id")).alias("observation"), F.lit("a").alias("action"))
    out = S.shared_history(st)
    item = "{{'observation': 'o{}', 'action': 'a'}}"
    got = out.select("step", F.length("history_text").alias("n"), F.md5("history_text").alias("m"), "n_history", F.spark_partition_id().alias("task"))
    rows = {r.step: r for r in got.collect()}
    assert len(rows) == n and len({r.task for r in rows.values()}) > 1
    import hashlib
    for k in (0, 1, 255, 256, 257, 512, 3999):
        text = "[" + ", ".join(item.format(i) for i in range(k)) + "]"
        assert (rows[k].n, rows[k].m, rows[k].n_history) == (len(text), hashlib.md5(text.encode()).hexdigest(), k)
