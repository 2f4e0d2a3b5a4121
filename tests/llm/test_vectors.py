"""Operators 2 and 6 against brute force."""

import numpy as np
import pytest

from episodeflow.llm import bit_sliced_topk, collision_ann
from episodeflow.llm.bit_sliced_topk import top_products
from episodeflow.llm.collision_ann import nearest_neighbours

KIND = "vec_id long, embedding array<float>, label int, score double, rank int"


def frame(spark, ids, matrix):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.0, 1) for i, v in zip(ids, matrix)], KIND)


def brute(ids, matrix, near):
    out = {}
    m = np.array(matrix, np.float32).astype(float)
    for q, v in zip(ids, m):
        if q % 100 == 0:
            score = np.sqrt(((m - v) ** 2).sum(1)) if near else np.floor(1024 * m).astype(int) @ np.floor(1024 * v).astype(int)
            rank = sorted((s if near else -s, i) for s, i in zip(score.tolist(), ids) if i != q)[:10]
            out[q] = [(i, s if near else -s) for s, i in rank]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    m = rng.standard_normal((900, 24)) + rng.integers(0, 4, (900, 1))
    m[300:340] = m[300]  # ties
    return list(range(900)), m.astype(np.float32)


@pytest.mark.parametrize("block", [16_384, 130])
def test_top_products_are_exact(spark, data, block, monkeypatch):
    monkeypatch.setattr(bit_sliced_topk, "BLOCK", block)
    monkeypatch.setattr(bit_sliced_topk, "QUERY_BLOCK", 4)
    assert result(top_products(frame(spark, *data))) == brute(*data, False)


@pytest.mark.parametrize("block", [8_192, 200])
def test_neighbours_recall(spark, data, block, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", block)
    got, want = result(nearest_neighbours(frame(spark, *data))), brute(*data, True)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    dist = {q: dict(v) for q, v in brute(*data, True).items()}
    for q, v in got.items():
        assert v == sorted(v, key=lambda x: (x[1], x[0]))
        for i, s in v:
            assert i not in dist[q] or s == pytest.approx(dist[q][i], abs=1e-12)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    got, want = result(nearest_neighbours(df)), brute([r.vec_id for r in rows], [r.embedding for r in rows], True)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (100, [0, 0]), (1, None), (2, [nan, 1]), (3, [inf, 1]), (4, [None, 1]), (5, [1, 0]), (6, [-1, 2]), (None, [1, 0]), (200, [1, 2, 3]), (7, []), (300, []), (8, [-3000.5, 1e7])]
    df = frame(spark, *zip(*rows))
    assert result(nearest_neighbours(df))[0][0] == (5, 0.0)
    assert {i for i, _ in result(nearest_neighbours(df))[0]} == {5, 6, 8}
    assert 100 not in result(nearest_neighbours(df)) and 200 not in result(nearest_neighbours(df))
    got = result(top_products(df))
    assert got[0] == [(5, 1024 * 1024), (100, 0), (6, -1024 * 1024), (8, 1024 * -3072512)]
    assert [i for i, _ in got[100]] == [0, 5, 6, 8] and got[300] == [(7, 0)]
    assert nearest_neighbours(df.limit(0)).collect() == [] and top_products(df.limit(0)).collect() == []


def test_scores_beyond_64_bits_are_null_and_last(spark):
    df = frame(spark, [0, 1, 2, 3], [[3e15], [3e15], [1.0], [0.0]])
    assert result(top_products(df))[0] == [(3, 0), (1, None), (2, None)]
