"""The carry between range partitions against plain Python."""

import random

import pytest

from episodeflow.plans.rank import in_group, prefix_sum

BIG = 2**53 + 1


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_in_group_equals_a_loop(spark, parts):
    rnd = random.Random(parts)
    # One group holds two thirds of the rows; a null group and nulls in every value column.
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), i, rnd.choice([None, BIG, -3, i]), rnd.choice(["x", None, str(i)]), rnd.choice([None, False, False, i % 40 == 0]))
            for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v long, t string, f boolean").repartition(5)
    got = in_group(df, "g", ["o"], position="pos", sums={"run": "v"}, lags={"prev": "t", "before": "v"}, flags={"seen": "f"}, num_partitions=parts).collect()
    want, state = [], {}
    for g, o, v, t, f in sorted(rows, key=lambda r: r[1]):
        pos, run, prev, before, seen = state.get(g, (0, 0, None, None, False))
        want.append((g, o, v, t, f, pos + 1, run + (v or 0), prev, before, seen))
        state[g] = pos + 1, run + (v or 0), t, v, seen or bool(f)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_prefix_sum_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(i, None if i % 2 else BIG, i) for i in range(9)], "o long, other long, v long")
    got = sorted(map(tuple, prefix_sum(df, ["o"], "v", num_partitions=3).collect()))
    assert got == [(i, None if i % 2 else BIG, i, i * (i + 1) // 2) for i in range(9)]
