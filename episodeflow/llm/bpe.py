"""Byte-level BPE over batches of texts, by rank-synchronous array merging.

A batch of texts is one flat byte array. Pre-tokens are found by comparing the character
classes of neighbours, equal pre-tokens are merged once, and every distinct pre-token is a
row of a ragged symbol array. A round finds the lowest-rank adjacent pair of each row and
merges all its places in all rows at once; rows without a mergeable pair leave.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from episodeflow.llm.common import ragged

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The characters of Unicode's White_Space property.
WHITE = (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
#: What follows an apostrophe in the contractions of the pre-tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct pre-tokens that a Python worker remembers between batches (speed only).
REMEMBERED = 400_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE)] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point and first byte position of each character of valid UTF-8."""
    if not (data & 0x80).any():
        return data.astype(np.int32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    out = lead.copy()
    for low, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[more - 1]))
        if len(k):
            c = lead[k] & mask
            for j in range(1, more + 1):
                c = (c << 6) | (data[at[k] + j] & 0x3F)
            out[k] = c
    return out, at


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens, and how many start before each row.

    The pattern: a contraction; an optional space and a run of letters, of numbers or of
    other characters; a run of white space without its last character if a visible
    character follows; white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cp, at = code_points(data)
    n = len(cp)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)  # first characters of rows
    first[np.searchsorted(at, offsets[:-1])] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first[:n]
    blank = cp == 32
    space = kind == SPACE
    start = change.copy()
    # A space before a visible run belongs to it; the last white space of a run stands alone.
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = ~space[1:] & ~first[1:n]
    start |= space & visible_next
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1] & ~space[1:] & ~first[1:n]
    start &= ~joined
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        pad = np.concatenate([cp, [0, 0, 0]])
        edge = np.concatenate([first, [True, True, True]])
        for tail in CONTRACTIONS:
            k = quote
            for j, ch in enumerate(tail, 1):
                k = k[(pad[k + j] == ord(ch)) & ~edge[k + j]]
            if len(k):
                start[k + 1] = False
                after = k + 1 + len(tail)
                start[after[after < n]] = True
    where = np.flatnonzero(start)
    starts = at[where]
    return starts, np.searchsorted(starts, offsets)


def token_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; the ranges cover ``data`` without gaps."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    inside = np.arange(len(data)) - np.repeat(starts, lengths)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * powers[inside]
    out = np.add.reduceat(mixed, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Merger:
    """Merge ranks and symbol ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters, extra = {b: chr(b) for b in plain}, 256
        for b in range(256):
            if b not in letters:
                letters[b], extra = chr(extra), extra + 1
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.uint32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # Open addressing over the pairs: a few gathers find the rank of many pairs.
        keys = (left << np.uint64(17)) | right
        bits = 19
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        slot_key = np.full(1 << bits, 2**63, np.uint64)
        slot_rank = np.full(1 << bits, NONE, np.int32)
        self.probes = 1
        rest, rank, at = keys, np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(rest):
            free = slot_rank[at] == NONE
            _, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[free[one]]
            slot_key[at[one]], slot_rank[at[one]] = rest[one], rank[one]
            left_over = np.ones(len(rest), bool)
            left_over[one] = False
            rest, rank, at = rest[left_over], rank[left_over], (at[left_over] + 1) & self.mask
            self.probes += bool(len(rest))
        self.slot_key, self.slot_rank, self.made = slot_key, slot_rank, made
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16 if made.max() < 65536 else np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(17)) | b
        at = self._slot(keys)
        out = np.where(self.slot_key[at] == keys, self.slot_rank[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.slot_rank[at] != NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (self._slot(keys[open_]) if _ == 0 else at) + 1 & self.mask
            hit = self.slot_key[at] == keys[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            go = ~hit & (self.slot_rank[at] != NONE)
            open_, at = open_[go], at[go]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all rows, one after another, and their number in each row."""
        n_rows = len(lengths)
        final_n = lengths.copy()
        rows = np.flatnonzero(lengths > 0)
        done_rows: list[np.ndarray] = []
        done_n: list[np.ndarray] = []
        done: list[np.ndarray] = []
        sym, lens = symbols, lengths[rows]

        def pair_ranks(s, ends):
            r = np.full(len(s), NONE, np.int32)
            if len(s) > 1:
                r[:-1] = self.ranks(s[:-1], s[1:])
            r[ends] = NONE
            return r

        rank = pair_ranks(sym, np.cumsum(lens) - 1) if len(rows) else None
        while len(rows):
            starts = np.cumsum(lens) - lens
            low = np.minimum.reduceat(rank, starts)
            open_ = low != NONE
            if not open_.all():
                keep = np.repeat(open_, lens)
                done_rows.append(rows[~open_])
                done_n.append(lens[~open_])
                done.append(sym[~keep])
                rows, lens, low = rows[open_], lens[open_], low[open_]
                sym, rank = sym[keep], rank[keep]
                if not len(rows):
                    break
                starts = np.cumsum(lens) - lens
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # x x x: every other place, from the left
                head = np.concatenate([[True], np.diff(at) != 1])
                offset = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[offset % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            lens = lens - np.add.reduceat(gone, starts, dtype=np.int64)
            moved = at - np.arange(len(at))
            keep = ~gone
            sym, rank = sym[keep], rank[keep]
            ends = np.zeros(len(sym), bool)
            ends[np.cumsum(lens) - 1] = True
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            inner = touched[~ends[touched]]
            rank[touched] = NONE
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        order_rows = np.concatenate(done_rows) if done_rows else np.zeros(0, np.int64)
        n = np.concatenate(done_n) if done_n else np.zeros(0, np.int64)
        flat = np.concatenate(done) if done else np.zeros(0, np.uint32)
        final_n[order_rows] = n
        back = np.argsort(order_rows, kind="stable")
        flat_starts = np.cumsum(n) - n
        assert n_rows == len(final_n)
        return flat[ragged(flat_starts[back], n[back])], final_n

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each pre-token's symbols in ``self.pool``."""
        lengths = np.diff(np.append(starts, len(data)))
        hashes = token_hashes(data, starts, lengths)
        code, distinct = pd.factorize(hashes)
        if len(self.known) > REMEMBERED:
            self.known, self.known_at, self.known_n = self.known[:0], self.known_at[:0], self.known_n[:0]
            self.pool = self.pool[:0]
        k = np.searchsorted(self.known, distinct)
        k_in = np.minimum(k, max(len(self.known) - 1, 0))
        new = (self.known[k_in] != distinct) if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            first = first[new]
            sym = self.of_byte[data[ragged(starts[first], lengths[first])]]
            flat, n = self.merge(sym, lengths[first])
            at = len(self.pool) + np.cumsum(n) - n
            self.pool = np.concatenate([self.pool, flat.astype(self.pool.dtype)])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.known_at = np.concatenate([self.known_at, at])[order]
            self.known_n = np.concatenate([self.known_n, n])[order]
            k = np.searchsorted(self.known, distinct)
        return self.known_at[k][code], self.known_n[k][code]

    def _split(self, data: np.ndarray, offsets: np.ndarray):
        """Cut rows at special strings: segments (bytes, offsets), row of each, and the id before it."""
        text = data.tobytes()
        marks = []
        for s, ident in self.special.items():
            raw, i = s.encode(), text.find(s.encode())
            while i >= 0:
                row = int(np.searchsorted(offsets, i, side="right")) - 1
                if i + len(raw) <= offsets[row + 1]:
                    marks.append((i, i + len(raw), ident))
                    i = text.find(raw, i + len(raw))
                else:
                    i = text.find(raw, i + 1)
        return sorted(marks)

    def encode(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids of all rows, one after another (None if not asked for), and their number in each row."""
        marks = self._split(data, offsets) if self.special else []
        if marks:
            # A special string is a segment of its own; a row is its segments in order.
            edges = np.unique(np.concatenate([offsets, [m[0] for m in marks], [m[1] for m in marks]]))
            special = {m[0]: m[2] for m in marks}
            keep = np.array([e not in special for e in edges[:-1]])
            part_lens = np.diff(edges)
            plain = data[ragged(edges[:-1][keep], part_lens[keep])]
            flat, n = self.encode_plain(plain, np.concatenate([[0], np.cumsum(part_lens[keep])]), ids)
            counts = np.ones(len(keep), np.int64)
            counts[keep] = n
            out = None
            if ids:
                out = np.empty(int(counts.sum()), self.pool.dtype)
                seg = np.cumsum(counts) - counts
                out[ragged(seg[keep], n)] = flat
                out[seg[~keep]] = [special[e] for e in edges[:-1][~keep]]
            total = np.concatenate([[0], np.cumsum(counts)])
            place = np.searchsorted(edges, offsets)
            return out, np.diff(total[place])
        return self.encode_plain(data, offsets, ids)

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray, ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        starts, before = pre_tokens(data, offsets)
        if not len(starts):
            return (self.pool[:0] if ids else None), np.zeros(len(offsets) - 1, np.int64)
        at, n = self.words(data, starts)
        total = np.concatenate([[0], np.cumsum(n)])
        return (self.pool[ragged(at, n)] if ids else None), np.diff(total[before])


@lru_cache(2)
def merger(path: str) -> Merger:
    """One table per Python worker and file."""
    return Merger(path)
