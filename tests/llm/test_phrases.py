"""Operator 13 against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from episodeflow.llm import phrase_mining
from episodeflow.llm.phrase_mining import Shard, Table, collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, support=10, longest=3, inside=50, ranks=2000):
    out, by_lang = [], {}
    for lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append((text or "").translate(UPPER))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        rest, top = [], Counter()
        for q, b in found.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    top[q[i: i + k]] = max(top[q[i: i + k]], b)
        for p, a in found.items():
            score, cut = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * top[p] < inside * a:
                rest.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rest)[:ranks], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    stock = ["of the", "new york city", "Émile said", "a b a b", "don't stop", "x", "y z", "漢字 語", "the the the"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.6 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        text = "".join(p.upper() + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "; ", " "]) if rng.random() < 0.1 else p + rng.choice([" ", " ", " ", ", ", "\r\n"]) for p in parts)
        rows.append((rng.choice(["en", "en", "fr", None, ""]), text))
    return rows


def got(spark, rows, parts=4, **more):
    out = collocations(spark.createDataFrame(rows, "lang string, text string").repartition(parts), **more)
    assert out.columns == NAMES
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("shard", [300, 4000, 1 << 23])
def test_shards_of_any_size(spark, monkeypatch, shard):
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", shard)
    rows = corpus(1)
    want = brute(rows)
    assert len(want) > 30 and got(spark, rows) == want


def test_longer_phrases_and_few_ranks(spark):
    rows = corpus(2)
    assert got(spark, rows, support=4, longest=4, inside=70, ranks=9) == brute(rows, 4, 4, 70, 9)


def test_ties_at_the_last_rank(spark):
    rows = [("en", f"p{i:03d} q{i:03d}. " * 10) for i in range(300)]
    assert got(spark, rows, ranks=100) == brute(rows, ranks=100)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in collocations(odd_docs, support=2).collect()) == brute(rows, 2)
    assert collocations(no_docs).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    kind = "lang string, k int, phrase string, n long"
    big = [("en", 1, "a", 3_000_000_000_000), ("en", 1, "b", 5_000_000_000_001), ("en", 2, "a b", 2_999_999_999_999), ("en", 0, "", 9_000_000_000_000)]
    monkeypatch.setattr(phrase_mining, "frequent", lambda *a: spark.createDataFrame(big, kind))
    row, = collocations(None).collect()
    assert row.score == 1000000 * 2_999_999_999_999 ** 2 // (3_000_000_000_000 * 5_000_000_000_001)


def test_the_table_has_all_candidates(spark):
    h = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    table = Table.of(spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long"), 3000)
    assert table.has(h).all() and table.has(~h).mean() < 0.1


def test_equal_hashes_are_told_apart():
    rng = np.random.default_rng(6)
    g = rng.integers(0, 50, 2000).astype(np.uint64)
    h = g % np.uint64(4)
    order, starts = phrase_mining.runs(h, g)
    assert dict(zip(g[order[starts]].tolist(), np.diff(np.append(starts, len(g))).tolist())) == dict(Counter(g.tolist()))


def test_phrases_of_a_shard():
    texts = ["A b, c", "", "  x\ty  z", "."]
    raw = [t.encode() for t in texts]
    shard = Shard(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    found = []
    for k, at, _ in shard.phrases(np.zeros(4, np.uint64), 3):
        data, off = shard.text(at, np.full(len(at), k))
        found += [(int(shard.row[a]), data[i:j].tobytes().decode()) for a, i, j in zip(at, off[:-1], off[1:])]
    assert sorted(found) == [(0, "a"), (0, "a b"), (0, "b"), (0, "c"), (2, "x"), (2, "x y"), (2, "x y z"), (2, "y"), (2, "y z"), (2, "z")]
