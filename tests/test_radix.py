"""Radix selection against row_number, with repeated keys, equal rows, nulls and groups."""

import random

import pytest
from pyspark.sql import functions as F

from episodeflow.operators import ordering as O
from episodeflow.operators import steps as S
from episodeflow.plans import radix
from episodeflow.plans.radix import first_rows, hex_digits, long_digits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 200])
def test_longs_with_any_spread(spark, n):
    rng = random.Random(n)
    values = [0, -1, 2**62, -(2**62), 5, 6, 7] + [rng.randrange(-50, 50) * 2**rng.choice([0, 15, 16, 31, 40]) for _ in range(56)] + [None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = first_rows(df, n, ["v", "i"], long_digits(F.col("v"))).where("_first")
    want = sorted(((v is not None, v or 0, i) for i, v in enumerate(values)))[:n]
    assert sorted(r.i for r in got.collect()) == sorted(i for _, _, i in want)


def test_groups_and_counts_over_the_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k) for k in range(300)] + [("c", 1000)]
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", O.seeded_key(F.col("k")))
    got = {(r.g, r.k) for r in first_rows(df, 20, ["h", "k"], hex_digits(F.col("h")), ["g"]).where("_first").collect()}
    import hashlib
    want = set()
    for g in {g for g, _ in rows}:
        mine = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for x, k in rows if x == g)
        want |= {(g, k) for _, k in mine[:20]}
    assert got == want


@pytest.mark.parametrize("group", [[], ["g"]])
def test_a_key_with_most_rows(spark, group):
    """Copies of a key over the cut: exact numbers, all rows kept, the smaller row hash first."""
    rows = [(g, 7, p) for g in (1, 2) for p in range(40)] + [(g, 7, 99) for g in (1, 2)] * 30 + [(1, 8, 0), (1, 6, 0)]
    df = spark.createDataFrame(rows, "g int, k long, p int")
    for n in (1, 2, 37, 60, 69, 70):
        out = first_rows(df, n, ["k"], long_digits(F.col("k")), group)
        got = out.collect()
        assert sorted((r.g, r.k, r.p) for r in got) == sorted(rows)
        sizes = {}
        for r in got:
            sizes[r.g] = sizes.get(r.g, 0) + r["_first"]
        assert (sum(sizes.values()) == n) if not group else (sizes == {1: n, 2: min(n, 70)})
        again = out.repartition(3).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_plans_have_no_range_exchange(spark):
    d = spark.range(4000).select((F.col("id") % 3).alias("g"), "id")
    for df in (S.episode_split(d, "id"), S.prefix_split(d, "id"), O.prior_mix(d.where("g = 0"), d.where("g > 0"), "id"), O.balanced_mix(d, "g", "id")):
        text = plan(df)
        assert "rangepartitioning" not in text and "Window" not in text and "Exchange hash" not in text, text
        df.collect()


def test_more_groups_than_thresholds(spark, monkeypatch):
    d = spark.range(300).select((F.col("id") % 7).alias("g"), "id")
    few = sorted(map(tuple, O.balanced_mix(d, "g", "id").collect()))
    monkeypatch.setattr(O, "FEW_GROUPS", 3)
    assert sorted(map(tuple, O.balanced_mix(d, "g", "id").collect())) == few
    monkeypatch.setattr(radix, "FEW_GROUPS", 3)
    with pytest.raises(ValueError):
        first_rows(d, 2, ["id"], long_digits(F.col("id")), ["g"])


def test_empty_input(spark):
    none = spark.range(0).withColumn("g", F.lit(1))
    assert S.episode_split(none, "id").collect() == [] and O.balanced_mix(none, "g", "id").collect() == []
    mixed = O.prior_mix(none, spark.range(5).withColumn("g", F.lit(1)), "id")
    assert mixed.collect() == []
