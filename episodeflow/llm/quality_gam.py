"""Operator 1: quality classifier, a generalised additive model with pairwise interactions.

Numeric features of whole texts are cut into quantile bins. Cyclic boosting visits one feature
after another; each visit adds a shallow tree over that feature's bins (fitted to the log-loss
gradients) into the feature's lookup table. Then the feature pairs with the largest remaining
gain are boosted the same way with one cut on either axis. A score is the sum of looked-up bins.

The model is fitted on a bounded sample: the ``sample`` labelled rows with the smallest seeded
hash of their id. Only their features (``sample`` rows of ``len(FEATURES)`` doubles, at most
5 MB at the default) reach the driver. Scoring covers every row of the table in one pass without
a shuffle.

Defined results: a null text counts as empty and gets the score of an empty text; a null id is
never a training row and is held out = false; labels that are null are ignored; a repeated label
row counts once per row; without usable labels of both kinds every score is the share of label 1
(0.5 if there are none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeflow.llm.common import by_row, passes
from episodeflow.llm.shingles import word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "letter", "symbol", "comma_stop", "pipe", "exclaim",
    "newline", "non_ascii", "space", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "upper_words",
    "symbol_ends", "line_length", "distinct_lines", "word_entropy",
)
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.12

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~|<>{}[]\\=+_/`!"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    line = data == 10
    symbol = _SYMBOLS[data]

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[offsets]).astype(np.float64)

    share = 1.0 / np.maximum(size, 1)
    words, at = word_hashes(data, offsets)
    n_words = np.diff(at)
    per_word = 1.0 / np.maximum(n_words, 1)
    solid = ~blank
    end = solid.copy()
    end[:-1] &= blank[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= len(data))]
    end[inner - 1] |= solid[inner - 1]
    begin = solid.copy()
    begin[1:] &= blank[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] |= solid[first]
    two_upper = begin & upper
    if len(data):
        two_upper[:-1] &= upper[1:]
        two_upper[-1] = False

    rows = np.repeat(np.arange(n), n_words)
    order = np.lexsort((words, rows))
    w, r = words[order], rows[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    group = np.flatnonzero(new)
    times = np.diff(np.append(group, len(w)))
    group_at = np.searchsorted(r[group], np.arange(n + 1)) if len(group) else np.zeros(n + 1, np.int64)
    distinct = np.diff(group_at)
    top = by_row(times, group_at, np.maximum, 0)
    share_of = times * per_word[r[group]] if len(group) else np.zeros(0)
    entropy = by_row(-share_of * np.log(np.maximum(share_of, 1e-300)), group_at, np.add, 0.0)
    pair = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else np.zeros(0, np.uint64)
    inside = rows[1:] == rows[:-1] if len(words) > 1 else np.zeros(0, bool)
    next_same = np.bincount(rows[1:][inside & (words[1:] == words[:-1])], minlength=n) if len(words) > 1 else np.zeros(n)
    pr, pv = rows[1:][inside] if len(words) > 1 else np.zeros(0, int), pair[inside]
    o = np.lexsort((pv, pr))
    pr, pv = pr[o], pv[o]
    fresh = np.ones(len(pv), bool)
    fresh[1:] = (pv[1:] != pv[:-1]) | (pr[1:] != pr[:-1])
    pairs = np.bincount(pr[fresh], minlength=n)

    breaks = count(line)
    # Lines: equal sums of word hashes between line ends stand for equal lines.
    line_no = np.concatenate([[0], np.cumsum(line)])
    word_first = np.flatnonzero(begin)
    line_of = line_no[word_first]
    lr = rows.astype(np.int64) * (int(line_no[-1]) + 1) + line_of if len(words) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], lr[1:] != lr[:-1]])) if len(lr) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(words, starts) if len(starts) else np.zeros(0, np.uint64)
    line_row = rows[starts] if len(starts) else np.zeros(0, np.int64)
    o = np.lexsort((line_hash, line_row))
    lh, lrow = line_hash[o], line_row[o]
    fresh = np.ones(len(lh), bool)
    fresh[1:] = (lh[1:] != lh[:-1]) | (lrow[1:] != lrow[:-1])
    n_lines = np.bincount(lrow, minlength=n)
    distinct_lines = np.bincount(lrow[fresh], minlength=n)

    columns = (
        np.log1p(size), np.log1p(n_words), count(solid) * per_word, count(upper) * share, count((data >= 48) & (data <= 57)) * share,
        count(upper | lower | (data >= 128)) * share, count(symbol) * share, count((data == 44) | (data == 46)) * per_word,
        count(data == 124) * per_word, count(data == 33) * per_word, breaks * share, count(data >= 128) * share, count(blank) * share,
        distinct * per_word, top * per_word, next_same * per_word, pairs / np.maximum(n_words - 1, 1), count(two_upper) * per_word,
        count(end & symbol) * per_word, size / (breaks + 1.0), distinct_lines / np.maximum(n_lines, 1), entropy)
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


@dataclass
class Model:
    """``base + sum(main[f][bin of f]) + sum(pair tables)`` is the log-odds of label 1."""

    base: float
    cuts: list[np.ndarray]
    main: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (cut, add) in enumerate(zip(self.cuts, self.main)):
            z += add[np.searchsorted(cut, x[:, f], side="right")]
        for (a, b), add in zip(self.pairs, self.pair_tables):
            z += add[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g, h):
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Best tree of at most three cuts over ordered bins: a value for each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    spans = [(0, len(g))]
    for _ in range(3):
        best = (1e-12, None)
        for a, b in spans:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl * _leaf(gl, hl) + (gt - gl) * _leaf(gt - gl, ht - hl) - gt * _leaf(gt, ht)
            gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (a, b, a + k + 1))
        if best[1] is None:
            break
        a, b, c = best[1]
        spans.remove((a, b))
        for s, e in ((a, c), (c, b)):
            spans.append((s, e))
            out[s:e] = _leaf(g[s:e].sum(), h[s:e].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut on both axes of a table: its gain and the four values spread over the table."""
    def corners(t):
        c = t.cumsum(0).cumsum(1)
        return c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]

    (ga, gr, gc, gt), (ha, hr, hc, ht) = corners(g), corners(h)
    quads = [(ga, ha), (gr - ga, hr - ha), (gc - ga, hc - ha), (gt - gr - gc + ga, ht - hr - hc + ha)]
    gain = sum(a * _leaf(a, b) for a, b in quads) - gt * _leaf(gt, ht)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    values = [_leaf(a[i, j], b[i, j]) for a, b in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1:], out[i + 1:, : j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of main effects, then of the strongest pairs. ``y`` holds 0 and 1."""
    n_features = x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    empty = [np.zeros(0)] * n_features
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        base = 40.0 * np.sign(share - 0.5) if share in (0.0, 1.0) else np.log(share / (1 - share))
        return Model(float(base), empty, [np.zeros(1)] * n_features, empty, [], [])
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    main = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = slopes()
            k = len(main[f])
            add = RATE * _shallow_tree(np.bincount(bins[f], g, k), np.bincount(bins[f], h, k))
            main[f] += add
            z += add[bins[f]]
    pair_cuts = [_cuts(x[:, f], PAIR_BINS) for f in range(n_features)]
    coarse = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(pair_cuts)]

    def grid(a, b, v):
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        return np.bincount(coarse[a] * shape[1] + coarse[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(_cross(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(n_features) for b in range(a)]
    pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(pairs, tables):
            g, h = slopes()
            add = RATE * _cross(grid(a, b, g), grid(a, b, h))[1]
            t += add
            z += add[coarse[a], coarse[b]]
    return Model(base, cuts, main, pair_cuts, pairs, tables)


def held_out(id_col: str) -> F.Column:
    """One fold of five: the crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows outside the held-out fold with the smallest seeded hashes, at most ``sample``."""
    rows = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
            .filter(~held_out("id")))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(17)), "id", "y").limit(sample)  # a bounded side: at most `sample` rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                x = features(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index("id")), part.column(part.schema.names.index("y")), flat], ["id", "y", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    got = texts.select("id", "y", "text").mapInArrow(run, f"id {kind}, y int, x array<double>").orderBy("id", "y").limit(2 * sample).collect()
    x = np.array([r.x for r in got]) if got else np.zeros((0, len(FEATURES)))
    return fit(x, np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                s = model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return score(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
