"""Operator 2: approximate nearest neighbours by collision counting.

Each block of vectors has ``PROJECTIONS`` sorted arrays, one for each random projection. A query
opens a window of half-width WIDTH * R / 2 around its own projection in every array and widens R by
``GROWTH`` (virtual rehashing: the arrays stay as they are). A vector that has collided in at least
``THRESHOLD`` windows is verified by its Euclidean distance in double precision. The search of a
block ends when its k-th verified distance is at most R: a vector within R collides in a window with
probability P_NEAR, so it misses the threshold with probability below ``MISS``. When all windows
cover their arrays every vector has been verified, so the search ends in any case. No candidate is
dropped.

Every row is indexed. Defined results: a null id, a null vector, one with null, NaN or infinite
components and a zero vector take no part; vectors only meet vectors of equal length; a candidate
with the query's own id is not its neighbour; ties go to the smaller id; repeated rows are
candidates each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from episodeflow.llm.vector_blocks import K, finite, search

RATIO = 2.0
#: Window width that separates distance R from RATIO * R best.
WIDTH = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))
P_NEAR = math.erf(WIDTH / 2 / math.sqrt(2))
P_FAR = math.erf(WIDTH / 2 / RATIO / math.sqrt(2))
#: Chance that a vector within R is missed, and share of the far vectors that may be verified in vain.
MISS, VAIN = 0.1, 0.02
_A, _B = math.sqrt(math.log(2 / VAIN)), math.sqrt(math.log(1 / MISS))
PROJECTIONS = math.ceil((_A + _B) ** 2 / (2 * (P_NEAR - P_FAR) ** 2))
THRESHOLD = math.ceil(PROJECTIONS * (_A / _B * P_NEAR + P_FAR) / (1 + _A / _B))
GROWTH = 1.35
BLOCK, QUERY_BLOCK = 8_192, 2_048


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.matrix = matrix
        rng = np.random.default_rng(matrix.shape[1] * 1_000_003 + 5)
        self.axes = rng.standard_normal((PROJECTIONS, matrix.shape[1]))
        with np.errstate(over="ignore", invalid="ignore"):
            spots = np.nan_to_num(self.axes @ matrix.T)
        self.order = np.argsort(spots, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(spots, self.order, 1)
        spread = float((self.sorted[:, -1] - self.sorted[:, 0]).max())
        self.first = spread / 24 if spread > 0 else 1.0
        #: Radii until a window reaches over any array from anywhere inside it.
        self.steps = math.ceil(math.log(24 * 2 / WIDTH) / math.log(GROWTH)) + 1

    def nearest(self, query: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest found among ``allowed``, nearest first, ties by position."""
        n = len(self.matrix)
        hits = np.zeros(n, np.int16)
        verified = ~allowed
        spot = np.nan_to_num(self.axes @ query)
        # Window ends of all radii at once; the last window is the whole array.
        radii = self.first * GROWTH ** np.arange(self.steps)
        reach = np.concatenate([spot[:, None] - WIDTH * radii[::-1] / 2, spot[:, None], spot[:, None] + WIDTH * radii / 2], axis=1)
        ends = np.stack([np.searchsorted(a, r) for a, r in zip(self.sorted, reach)])
        ends = np.concatenate([np.zeros((PROJECTIONS, 1), ends.dtype), ends, np.full((PROJECTIONS, 1), n, ends.dtype)], axis=1)
        at, dist = np.zeros(0, np.int64), np.zeros(0)
        middle = self.steps + 1
        for t in range(1, self.steps + 2):
            new = [a[i: j] for a, i, j in zip(self.order, ends[:, middle - t], ends[:, middle - t + 1]) if i < j]
            new += [a[i: j] for a, i, j in zip(self.order, ends[:, middle + t - 1], ends[:, middle + t]) if i < j]
            if new:
                hits += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((hits >= THRESHOLD) & ~verified)
                if len(fresh):
                    verified[fresh] = True
                    at = np.concatenate([at, fresh])
                    dist = np.concatenate([dist, np.sqrt(((self.matrix[fresh] - query) ** 2).sum(1))])
            if t <= self.steps and len(at) >= k and np.partition(dist, k - 1)[k - 1] <= radii[t - 1]:
                break
        best = np.lexsort((at, dist))[:k]
        return at[best], dist[best]


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` (distance) of the queries' k nearest found."""

    def answer(index: Index, ids: np.ndarray, query_id: int, query: np.ndarray):
        at, dist = index.nearest(query, ids != query_id, k)
        return at, dist.tolist()

    return search(finite(vectors, id_col, vec_col, False), answer, BLOCK, QUERY_BLOCK, k, state=Index)
