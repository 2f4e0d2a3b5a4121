"""Operator 3 against all pairs of sets."""

import random
import re

import numpy as np
import pytest

from episodeflow.llm import near_dedup
from episodeflow.llm.near_dedup import REGISTERS, joint_similarity, likely, near_duplicates, registers


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for v in where.values() for n, a in enumerate(v) for b in v[:n]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 85 * len(s | t):
            p, q = root(i), root(j)
            comp[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())


def test_documents(documents, doc_rows):
    assert result(documents) == brute(doc_rows)


@pytest.fixture(scope="module")
def families():
    """Families whose members lie on both sides of the threshold, chains, exact copies."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    out, i = [], 0
    for size, changes in ((40, 1), (60, 2), (60, 3), (30, 4)):
        base = [word() for _ in range(150)]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, changes)):
                w[rnd.randrange(len(w))] = word()
            out.append((i, " ".join(w)))
            i += 1
    chain = [word() for _ in range(120)]
    for _ in range(25):
        chain = chain[1:] + [word()] if rnd.random() < 0.5 else chain[2:] + [word(), word()]
        out.append((i, " ".join(chain)))
        i += 1
    out += [(i + k, out[k * 3][1].upper()) for k in range(20)]
    rnd.shuffle(out)
    return out


def test_families_in_blocks(spark, families, monkeypatch):
    want = brute(families)
    df = spark.createDataFrame(families, "doc_id long, text string")
    assert result(df) == want
    monkeypatch.setattr(near_dedup, "BLOCK", 7)  # large buckets are cut; the result stays
    assert result(df) == want


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got[1] == (6, 1, True) and got[2] == (6, 1, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[12] == (0, 12, True)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[9][1:] == (8, False) and got[None][1:] == (None, True)
    assert [r.component_id for r in rows if r.doc_id == 10] == [10, 10]
    assert near_duplicates(no_docs).collect() == []


def test_registers_are_mergeable_and_estimate():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for both in (2700, 1500, 300):
        u, v = values[: both + (3000 - both) // 2], np.concatenate([values[:both], values[both + (3000 - both) // 2:]])
        su, sv, su_v = (registers(x, np.array([0, len(x)]))[0] for x in (u, v, np.union1d(u, v)))
        assert (np.maximum(su, sv) == su_v).all()
        est = joint_similarity(np.array([(su > sv).sum()]), np.array([(su < sv).sum()]), np.array([float(len(u))]), np.array([float(len(v))]))[0]
        j = both / 3000
        assert abs(est - j) < 4.5 * np.sqrt(j * (1 - j) / REGISTERS)


def test_likely_is_the_estimate_against_a_goal():
    rng = np.random.default_rng(4)
    more, less = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    u, v = rng.integers(50, 200, 400).astype(float), rng.integers(50, 200, 400).astype(float)
    est = joint_similarity(more, less, u, v)
    for goal in (0.5, 0.61, 0.85):
        assert (likely(more, less, u, v, goal) == (est >= goal))[np.abs(est - goal) > 1e-3].all()
