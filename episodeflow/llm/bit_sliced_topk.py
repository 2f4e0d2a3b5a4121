"""Operator 6: exact top-k by integer inner product over a bit-sliced index.

A component x becomes floor(SCALE * x). In each block the values of a dimension, less their
minimum, are kept as slices: one bitmap over the rows for each binary digit. A query's score is a
sum of shifted slices (those of the complement where its weight is negative); bitmaps of equal
weight are added three at a time with bitmap arithmetic until one is left for each binary digit of
the score. Rows are then selected from the most significant slice downward. Rows that tie at the
boundary are resolved exactly: by the smaller id, since bits are in id order.

Defined results: a null id, a null vector and one with null, NaN or infinite components take no
part; an empty vector or one of other length only meets vectors of equal length; a candidate with
the query's own id is not its answer; ties go to the smaller id; repeated rows are candidates each;
a score beyond a 64-bit integer is null and ranks last; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from episodeflow.llm.vector_blocks import K, finite, search

SCALE = 1024
BLOCK, QUERY_BLOCK = 16_384, 2_048
_LIMIT = 2**63


def bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, first row first."""
    n = bits.shape[-1]
    pad = -n % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Slices:
    """Bit slices of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        scaled = np.floor(matrix * SCALE)
        whole = np.abs(scaled).max(initial=0) < 2**53
        values = scaled.astype(np.int64) if whole else np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(scaled.shape)
        self.n, self.dim = matrix.shape
        self.low = [int(x) for x in values.min(0)]
        plain, self.where = [], []
        for j in range(self.dim):
            rest = values[:, j] - self.low[j]
            n_bits = int(rest.max()).bit_length()
            self.where.append((len(plain), n_bits))
            for b in range(n_bits):
                plain.append(((rest >> b) & 1).astype(bool))
        self.valid = bitmaps(np.ones((1, self.n), bool))[0]
        both = bitmaps(np.array(plain, bool).reshape(len(plain), self.n))
        self.slices = np.concatenate([both, ~both & self.valid])
        self.flip = len(plain)

    def score_slices(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of score - offset, least significant first, and the offset."""
        at: dict[int, list[int]] = {}
        offset = 0
        for j, w in enumerate(query):
            first, n_bits = self.where[j]
            offset += w * self.low[j]
            if w < 0:
                offset += w * (2**n_bits - 1)
                first, w = first + self.flip, -w
            shift = 0
            while w:
                if w & 1:
                    for b in range(n_bits):
                        at.setdefault(shift + b, []).append(first + b)
                w >>= 1
                shift += 1
        out: list[np.ndarray] = []
        carried: dict[int, list[np.ndarray]] = {}
        weight, top = 0, max(at, default=-1)
        while weight <= top or weight in carried:
            pile = [self.slices[at[weight]]] if weight in at else []
            pile += carried.pop(weight, [])
            x = np.concatenate(pile) if pile else np.zeros((1, len(self.valid)), np.uint64)
            while len(x) > 1:
                k = max(len(x) // 3, 1)
                if len(x) == 2:
                    a, b = x[:1], x[1:]
                    carry, x = a & b, a ^ b
                else:
                    a, b, c = x[:k], x[k: 2 * k], x[2 * k: 3 * k]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    x = np.concatenate([half ^ c, x[3 * k:]])
                if carry.any():
                    carried.setdefault(weight + 1, []).append(carry)
            out.append(x[0])
            weight += 1
        return out, offset

    def top(self, slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k highest sums among ``allowed``; ties by position."""
        sure, open_ = np.zeros_like(allowed), allowed.copy()
        for s in reversed(slices):
            x = sure | (open_ & s)
            n = int(np.bitwise_count(x).sum())
            if n > k:
                open_ &= s
            else:
                sure = x
                open_ &= ~s
                if n == k:
                    return rows_of(sure)
        chosen = rows_of(sure)
        return np.concatenate([chosen, rows_of(open_)[: k - len(chosen)]])


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the queries' k highest integer inner products."""

    def answer(index: Slices, ids: np.ndarray, query_id: int, query: np.ndarray):
        weights = [int(x) for x in np.floor(query * SCALE).tolist()]
        slices, offset = index.score_slices(weights)
        allowed = index.valid.copy()
        lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
        for own in range(lo, hi):
            allowed[own // 64] &= ~np.uint64(1 << (own % 64))
        at = index.top(slices, allowed, k)
        score = [offset] * len(at)
        for b, s in enumerate(slices):
            on = (s[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            score = [x + (int(o) << b) for x, o in zip(score, on)]
        return at, [x if -_LIMIT <= x < _LIMIT else None for x in score]

    return search(finite(vectors, id_col, vec_col, True), answer, BLOCK, QUERY_BLOCK, k, score_type="long", ascending=False, state=Slices)


SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 10
"""
