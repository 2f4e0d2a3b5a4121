"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np

from episodeflow.llm.common import by_row

WIDTH = 5
_WORD = np.uint64(0x9E3779B97F4A7C15)
#: One odd multiplier for each place of a word in a shingle.
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, split at space and \\t..\\r), and word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    row_first = offsets[:-1][offsets[:-1] < len(data)]
    start[row_first] |= solid[row_first]
    kept = np.flatnonzero(solid)
    if not len(kept):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = start[kept]
    begin = np.flatnonzero(first)
    lengths = np.diff(np.append(begin, len(kept)))
    low = data[kept]
    low = low + (((low >= 65) & (low <= 90)).astype(np.uint8) << 5)
    powers = np.cumprod(np.full(int(lengths.max()), _WORD, np.uint64))
    inside = np.arange(len(kept), dtype=np.int32) - np.repeat(begin.astype(np.int32), lengths)
    value = low.astype(np.uint64)
    value += np.uint64(1)
    value *= powers[inside]
    out = np.add.reduceat(value, begin) + lengths.astype(np.uint64)
    return mix(out), np.searchsorted(kept[begin], offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats) and row offsets; two hashes of each row's word sequence.

    A row with one to four words has one shingle, the whole sequence; one without words has none.
    """
    words, at = word_hashes(data, offsets)
    n = np.diff(at)
    n_sh = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(n_sh)])
    out = np.zeros(int(out_at[-1]), np.uint64)
    long_ = n >= WIDTH
    if long_.any():
        inside = np.arange(len(words)) - np.repeat(at[:-1], n)
        full = inside + WIDTH <= np.repeat(n, n)
        pos = np.flatnonzero(full)
        acc = np.full(len(pos), np.uint64(WIDTH))
        for j in range(WIDTH):
            acc += words[pos + j] * _PLACES[j]
        rows = np.repeat(np.arange(len(n)), np.maximum(n - WIDTH + 1, 0) * long_)
        out[out_at[rows] + inside[pos]] = mix(acc)
    short = np.flatnonzero((n > 0) & ~long_)
    for k in range(1, WIDTH):
        rows = short[n[short] == k]
        if len(rows):
            acc = np.full(len(rows), np.uint64(k))
            for j in range(k):
                acc += words[at[rows] + j] * _PLACES[j]
            out[out_at[rows]] = mix(acc)
    place = mix(np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    whole = []
    for seed in (np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F)):
        ordered = mix(words ^ (place + seed))
        whole.append(mix(by_row(ordered, at, np.add, np.uint64(0)) + n.astype(np.uint64)))
    return out, out_at, whole[0], whole[1]


def distinct_in_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n), dtype=np.int64), n)
    order = np.lexsort((values, rows)) if len(n) > 1 else np.argsort(values, kind="stable")
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(len(n) + 1))
