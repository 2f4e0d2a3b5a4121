"""Operator 11: alignment of two tokenizers by galloping intersection.

1. Every task encodes whole texts with both tokenizers: A is a byte-level BPE (``bpe.Merger``) of a
   space and the text, B a sentencepiece model of the text. Token lengths in bytes, summed up, are
   two rising lists of ends.
2. The shorter list of a document drives: each of its ends starts in the longer one at the place its
   rank points to, gallops away in doubled steps until the end is enclosed, and a binary search
   finishes. All ends of a block of texts take each step together as arrays.
3. Common ends cut both lists into groups. The ranks of neighbouring common ends are the ranges of A
   and B tokens that overlap each other; the two tokens at a common end are a link.
4. A block of texts (``BLOCK_BYTES``, or one longer text) lands a row for each document, with its links
   as packed numbers of the block's distinct id pairs, and a row for each of those pairs with its count.
   No row is wider than a document, so readers, writers and sorts hold few bytes at once. The pairs of
   all blocks are summed by a grouped aggregate, so a pair that is in a third of all links is one row
   a block. The highest count of each B id is a table of at most the vocabulary's size.
5. The sums go back to the blocks by a join on the pair; the documents and the sums of a block meet by
   its number, and each block finishes its documents.

A text whose joined token bytes are not a space and the text (it holds U+2581, say) has no tokens.

Defined results: a null or empty text has no tokens: zeros and an empty ``groups_sha256``; null and
repeated ids are returned row by row; a very long text is a block of its own; ties for the highest
count all count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from episodeflow.llm.bpe import merger
from episodeflow.llm.common import land, passes, ragged, text_bytes
from episodeflow.llm.token_counts import tokenizer_path

#: Text bytes of a block, and of one pass of encoding and aligning within it.
BLOCK_BYTES, PASS = 4 << 20, 1 << 19
_MARK = "▁"


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            raw.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(_MARK, " ").encode())
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1)
        n = np.array([len(x) for x in found], np.int64)
        flat = np.empty(int(n.sum()), np.int64)
        at = 0
        for x in found:
            flat[at: at + len(x)] = x
            at += len(x)
        return flat, n

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each entry of a byte-level BPE file: one for each character of the entry."""
    import json

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for entry, i in vocab.items():
        out[i] = len(entry)
    return out


def offsets_of(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def gallop(values: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value the first place in ``longer[low:high]`` (rising) that is not below it.

    From ``guess`` steps of 1, 2, 4, ... enclose the place, on the side where it lies; then the range
    between the last two steps is halved. All values move at once; those that are done stand still.
    """
    low, high = low.copy(), high.copy()
    guess = np.clip(guess, low, np.maximum(high - 1, low))
    some = high > low
    below = np.zeros(len(values), bool)
    below[some] = longer[guess[some]] < values[some]
    low, high = np.where(below, guess + 1, low), np.where(below | ~some, high, guess)
    for up in (True, False):
        open_ = np.flatnonzero(some & (below if up else ~below))
        step = 1
        while len(open_):
            probe = guess[open_] + (step if up else -step)
            inside = (probe < high[open_]) if up else (probe >= low[open_])
            open_, probe = open_[inside], probe[inside]
            less = longer[probe] < values[open_]
            low[open_[less]] = probe[less] + 1
            high[open_[~less]] = probe[~less]
            open_ = open_[less if up else ~less]
            step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = longer[middle] < values[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(ends_a: np.ndarray, at_a: np.ndarray, ends_b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` of the ends that both lists of a row share, in order."""
    out_a, out_b = [], []
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    for drive_a in (True, False):
        rows = np.flatnonzero((n_a <= n_b) if drive_a else (n_a > n_b))
        short, at_s, n_s, long_, at_l, n_l = (ends_a, at_a, n_a, ends_b, at_b, n_b) if drive_a else (ends_b, at_b, n_b, ends_a, at_a, n_a)
        k = ragged(at_s[rows], n_s[rows])
        row = np.repeat(rows, n_s[rows])
        low = at_l[row]
        rank = (k - at_s[row]) * n_l[row] // np.maximum(n_s[row], 1)
        found = gallop(short[k], long_, low, low + n_l[row], low + rank)
        hit = found < low + n_l[row]
        hit[hit] = long_[found[hit]] == short[k[hit]]
        k, found = k[hit], found[hit]
        out_a.append(k if drive_a else found)
        out_b.append(found if drive_a else k)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@lru_cache(2)
def digits(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. size - 1: bytes, starts and lengths."""
    raw = [b"%d" % i for i in range(size)]
    n = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n


def group_digests(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """Hex SHA-256 of each row's groups ``a1,a2|b1;a3|b2,b3``; the last tokens of groups lie at ``cut_a`` and ``cut_b``."""
    raw, start, length = digits(int(max(a.max(initial=0), b.max(initial=0))) + 1)
    # Tokens in the order of the text of all groups: those of A, then those of B, group by group.
    first_a, first_b = np.concatenate([[0], cut_a[:-1] + 1]), np.concatenate([[0], cut_b[:-1] + 1])
    n_a, n_b = cut_a - first_a + 1, cut_b - first_b + 1
    place = np.cumsum(n_a + n_b) - (n_a + n_b)
    token = np.empty(len(a) + len(b), np.int64)
    token[ragged(place, n_a)] = a
    token[ragged(place + n_a, n_b)] = b
    mark = np.full(len(token), ord(","), np.uint8)
    mark[place + n_a - 1] = ord("|")
    mark[place + n_a + n_b - 1] = ord(";")
    room = length[token] + 1
    end = np.cumsum(room)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[ragged(end - room, room - 1)] = raw[ragged(start[token], room - 1)]
    out[end - 1] = mark
    edges = np.concatenate([[0], end])[at_a + at_b]  # a row's tokens of both lists lie side by side
    text = memoryview(out)
    return [hashlib.sha256(text[i: j - 1]).hexdigest() if j > i else "" for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]


def aligned(texts: list[str], data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
    """Ids and row offsets of A and B (rows that do not join to a space and the text are empty), and their common ends."""
    n = np.diff(offsets)
    full = n > 0
    spaced = np.full(int(n.sum() + full.sum()), 32, np.uint8)
    at = offsets_of(n + full)
    spaced[ragged(at[:-1] + full, n)] = data
    ids_a, n_a = merger(path_a).encode_plain(spaced, at)
    ids_a, len_a = ids_a.astype(np.int64), byte_lengths(path_a)
    model = pieces(path_b)
    ids_b, n_b = model.encode(texts)
    n_b_all, at_b = n_b, offsets_of(n_b)
    size_b = np.diff(np.concatenate([[0], np.cumsum(model.lengths[ids_b])])[at_b])
    good = full & (size_b == np.diff(at)) & (np.diff(np.concatenate([[0], np.cumsum(len_a[ids_a])])[offsets_of(n_a)]) == np.diff(at))
    rows = np.flatnonzero(good)
    same = model.joined(ids_b[ragged(at_b[rows], n_b[rows])]) == spaced[ragged(at[rows], np.diff(at)[rows])]
    if not same.all():
        good[rows] = np.logical_and.reduceat(same, offsets_of(np.diff(at)[rows])[:-1])
    ids_a, n_a = ids_a[np.repeat(good, n_a)], np.where(good, n_a, 0)
    ids_b, n_b = ids_b[np.repeat(good, n_b_all)], np.where(good, n_b, 0)
    at_a, at_b = offsets_of(n_a), offsets_of(n_b)
    cut_a, cut_b = common_ends(np.cumsum(len_a[ids_a]), at_a, np.cumsum(model.lengths[ids_b]), at_b)
    return ids_a, at_a, ids_b, at_b, cut_a, cut_b


def number_kind(size: int) -> type:
    """The narrowest numbers of the pairs of a block that has ``size`` of them."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block, _, _ in passes(batch, "text", BLOCK_BYTES):
                n_a, n_b, links, shas, pairs = [], [], [], [], []
                for part, data, offsets in passes(block, "text", PASS):
                    ids_a, at_a, ids_b, at_b, cut_a, cut_b = aligned(part.column(1).to_pylist(), data, offsets, path_a, path_b)
                    n_a.append(np.diff(at_a))
                    n_b.append(np.diff(at_b))
                    links.append(np.diff(np.searchsorted(cut_a, at_a)))
                    pairs.append((ids_a[cut_a] << 32) | ids_b[cut_b])
                    shas += group_digests(ids_a, at_a, ids_b, at_b, cut_a, cut_b)
                if not shas:
                    continue
                pair, link, times = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                n_links, number = np.concatenate(links), (part_id << 32) + made
                yield _rows(number, len(shas), id=block.column(0), n_a=pa.array(np.concatenate(n_a)), n_b=pa.array(np.concatenate(n_b)), n_links=pa.array(n_links),
                            sha=pa.array(shas, pa.string()), link=_packed(link.astype(number_kind(len(pair))), offsets_of(n_links)))
                yield _rows(number, len(pair), id=pa.nulls(len(pair), block.column(0).type), pair=pa.array(pair), times=pa.array(times))
                made += 1

    return run


def _rows(block: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a block: columns that are not given are null."""
    kinds = {"id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "sha": pa.string(), "link": pa.binary(), "pair": pa.int64(), "times": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *[columns[k] if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()]], ["block", *kinds])


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column: the bytes of each row's values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _finish(id_type: pa.DataType):
    def run(docs: pa.Table, stats: pa.Table) -> pa.Table:
        """The documents of one block; its pairs are numbered in rising order."""
        order = np.argsort(stats["pair"].to_numpy())
        count, best = stats["count"].to_numpy()[order], stats["best"].to_numpy()[order]
        link, n = text_bytes(docs["link"])[0].view(number_kind(len(order))), docs["n_links"]
        at = offsets_of(n.to_numpy())
        sums, hits = (np.diff(np.concatenate([[0], np.cumsum(x[link], dtype=np.int64)])[at]) for x in (count, best))
        return pa.table([docs["id"].cast(id_type), docs["n_a"], docs["n_b"], n, n, pa.array(hits), pa.array(sums), docs["sha"].cast(pa.string())],
                        ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row's whole text."""
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = land(rows.mapInArrow(_blocks(path_a, path_b), f"block long, id {kind}, n_a long, n_b long, n_links long, sha string, link binary, pair long, times long"), "token-blocks")
    pairs = blocks.filter("pair is not null").select("block", "pair", "times")
    counts = land(pairs.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("top"))
    counts = counts.withColumn("b", b_id).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    stats = pairs.select("block", "pair").join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    texts = blocks.filter("pair is null").select("block", "id", "n_a", "n_b", "n_links", "sha", "link")
    out = texts.groupBy("block").cogroup(stats.groupBy("of")).applyInArrow(
        _finish(to_arrow_type(blocks.schema["id"].dataType)), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)
