"""Operator 11 against a brute-force version with the tokenizer libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodeflow.llm.token_alignment import alignment, common_ends, gallop, offsets_of, pieces
from episodeflow.llm.token_counts import tokenizer_path

pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = letters()


def bytes_b(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def tokens(libraries, text):
    a, b = libraries
    if not text:
        return None
    ea = a.encode(" " + text, add_special_tokens=False)
    ta = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
    tb = [(i, bytes_b(b.id_to_piece(i))) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb) else None


def ends(ts):
    out, at = [], 0
    for _, raw in ts:
        at += len(raw)
        out.append(at)
    return out


def brute(libraries, rows):
    """All columns of the contract, in pure Python."""
    links, out = {}, []
    for k, (_, text) in enumerate(rows):
        both = tokens(libraries, text)
        if both is None:
            links[k] = None
            continue
        ta, tb = both
        ea, eb = ends(ta), ends(tb)
        shared = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        pairs = []
        for e in shared:
            p, q = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(str(x) for x, _ in ta[i:p]) + "|" + ",".join(str(x) for x, _ in tb[j:q]))
            pairs.append((ta[p - 1][0], tb[q - 1][0]))
            i, j = p, q
        links[k] = len(ta), len(tb), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()
    counts = Counter(p for v in links.values() if v for p in v[2])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    for k, (i, _) in enumerate(rows):
        if links[k] is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, pairs, sha = links[k]
        out.append((i, n_a, n_b, len(pairs), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark, libraries, documents, doc_rows):
    assert result(alignment(documents.repartition(5))) == brute(libraries, doc_rows)


def test_small_blocks(spark, libraries, documents, doc_rows, monkeypatch):
    from episodeflow.llm import token_alignment
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 3000)
    assert result(token_alignment.alignment(documents)) == brute(libraries, doc_rows)


def test_odd_rows(spark, libraries, odd_docs, no_docs):
    want = brute(libraries, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    got = alignment(odd_docs)
    assert result(got) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert alignment(no_docs).collect() == []


def test_random_texts(spark, libraries):
    rng = random.Random(5)
    alphabet = ["a", "b", "Th", "é", "漢", "\n", "  ", " ", "\t", "'s", "😀", "x1", "▁", "<s>", "<0x41>", "<|endoftext|>", ".", "￿", "\x01", "İ", " "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    assert sum(tokens(libraries, t) is None for _, t in rows) > 20
    assert result(alignment(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(libraries, rows)


def test_byte_pieces_are_marked():
    p = pieces(tokenizer_path("piece_bpe_32k.model"))
    assert [bytes_b(p.model.id_to_piece(i)) for i in range(3, 2000)] == [p.bytes[s: s + n].tobytes() for s, n in zip(p.starts[3:2000], p.lengths[3:2000])]


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        long_ = np.sort(rng.choice(1000, rng.integers(0, 60), replace=False))
        values = rng.integers(-5, 1005, 20)
        guess = rng.integers(-3, 70, 20)
        n = np.full(20, len(long_))
        assert (gallop(values, long_, 0 * n, n, guess) == np.searchsorted(long_, values)).all()


def test_common_ends_of_ragged_rows():
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(90, rng.integers(0, 40), replace=False)), np.sort(rng.choice(90, rng.integers(0, 40), replace=False))) for _ in range(50)]
    a, b = (np.concatenate(x) for x in zip(*rows))
    at_a, at_b = (offsets_of(np.array([len(r[k]) for r in rows])) for k in (0, 1))
    i, j = common_ends(a, at_a, b, at_b)
    want = [(at_a[r] + int(np.searchsorted(x, e)), at_b[r] + int(np.searchsorted(y, e))) for r, (x, y) in enumerate(rows) for e in np.intersect1d(x, y)]
    assert list(zip(i.tolist(), j.tolist())) == want


def test_landed_rows_are_no_wider_than_a_text(spark, monkeypatch):
    from episodeflow.llm import token_alignment
    landed, land = [], token_alignment.land

    def spy(df, name, files=None):
        landed.append(land(df, name, files))
        return landed[-1]

    monkeypatch.setattr(token_alignment, "land", spy)
    rows = [(i, f"row {i} of the table, as short as all others") for i in range(2000)]
    out = alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert out.count() == 2000
    widest = [df.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] for df in landed]
    assert len(landed) == 2 and max(widest) < 1000  # one row of a block of 2000 texts had 250,000


@pytest.mark.parametrize("n_pairs", [0, 100, 1 << 16, 70_000])
def test_pair_numbers_of_a_block(n_pairs):
    import pyarrow as pa

    from episodeflow.llm.token_alignment import _finish, _packed, number_kind
    rng = np.random.default_rng(6)
    n_links = np.array([3, 0, 500, 1]) * (n_pairs > 0)
    link = rng.integers(0, max(n_pairs, 1), n_links.sum())
    if n_pairs:
        link[-1] = n_pairs - 1
    pair = np.sort(rng.choice(1 << 40, n_pairs, replace=False))
    count, best = rng.integers(1, 9, n_pairs), rng.random(n_pairs) < 0.5
    mixed = rng.permutation(n_pairs)
    stats = pa.table({"pair": pair[mixed], "count": count[mixed], "best": pa.array(best[mixed])})
    packed = _packed(link.astype(number_kind(n_pairs)), offsets_of(n_links))
    docs = pa.table({"id": [7, 7, None, 8], "n_a": n_links, "n_b": n_links, "n_links": n_links, "sha": ["a", "", "b", "c"], "link": packed})
    got = _finish(pa.int64())(docs, stats).to_pydict()
    each = np.split(link, np.cumsum(n_links)[:-1])
    assert got["id"] == [7, 7, None, 8] and got["groups_sha256"] == ["a", "", "b", "c"]
    assert got["count_sum"] == [int(count[x].sum()) for x in each]
    assert got["n_best"] == [int(best[x].sum()) for x in each]


def test_wide_arrow_types(spark, libraries):
    rows = [(None, "one"), ("x", "two three"), ("x", None)]
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert result(alignment(spark.createDataFrame(rows, "doc_id string, text string"))) == brute(libraries, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
