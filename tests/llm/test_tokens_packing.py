"""Operators 4 and 8 against the tokenizers library and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from episodeflow.llm.bpe import Merger
from episodeflow.llm.common import passes
from episodeflow.llm.retrieval_packing import END, Shard, Statistics, Tree, cell_tasks, neighbour_recall, pack, packed, row_tokens
from episodeflow.llm.retrieval_packing import shard_rows as r_shards
from episodeflow.llm.token_counts import token_counts, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_on_random_texts(library):
    rnd = random.Random(3)
    bits = ["a", "b", "'", "s", "t", "re", " ", "  ", "\n", "\t", "é", "ß", "漢", "🎉", "1", "٣", "½", "<|endoftext|>", "ll", "-", "don't", "'LL",
            "aaaa", "\r\n", "　", "x" * 50, " " * 7, "\x1c", "​", "'ve", "_", "́"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(3000)] + [None, "", "<|endoftext|>", "<|endoftext|><|endoftext|> a"]
    batch = pa.record_batch({"text": pa.array(texts)})
    merger = Merger(tokenizer_path())
    for size in (700, 1 << 21):
        got = []
        for _, data, offsets in passes(batch, "text", size):
            flat, n = merger.encode(data, offsets)
            got += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
        assert got == [ids_of(library, t) for t in texts]


def test_store_of_known_words_is_only_a_store(library, monkeypatch):
    monkeypatch.setattr("episodeflow.llm.bpe.REMEMBERED", 3)
    merger = Merger(tokenizer_path())
    for text in ["alpha beta gamma delta", "beta epsilon", "alpha zeta eta theta beta"]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert merger.encode(raw, np.array([0, len(raw)]))[0].tolist() == ids_of(library, text)


def test_counts_equal_the_library(documents, doc_rows, library):
    got = {r.doc_id: r for r in token_counts(documents).collect()}
    assert len(got) == len(doc_rows)
    for i, t in doc_rows:
        n = len(ids_of(library, t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)


def test_counts_of_odd_rows(odd_docs, no_docs, library):
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids_of(library, r.text))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd_docs).collect()) == want
    assert token_counts(no_docs).collect() == []


def check_pieces(rows, texts, library, window=2048):
    """Every document is cut into adjoining pieces, every sequence is gapless, checksums fit the ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids, at = [*ids_of(library, text), END], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at: at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    open_ = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        open_ += at < window
    return open_


def test_packing_round_trip(documents, doc_rows, library):
    assert check_pieces(packed(documents).collect(), doc_rows, library) <= 1


def test_packing_of_odd_rows(odd_docs, no_docs, library):
    texts = [(i, r.text) for i, r in enumerate(odd_docs.collect())]
    numbered = odd_docs.sparkSession.createDataFrame(texts, "doc_id long, text string")
    assert check_pieces(packed(numbered).collect(), texts, library) <= 1
    assert sum(r.length for r in packed(odd_docs).collect()) == sum(len(ids_of(library, t)) + 1 for _, t in texts)
    assert packed(no_docs).collect() == []


def test_several_shards(documents, doc_rows, library, monkeypatch):
    monkeypatch.setattr("episodeflow.llm.retrieval_packing.SHARD_TOKENS", 30_000)
    rows = packed(documents).collect()
    shards = len({r.sequence_id >> 32 for r in rows})
    assert shards > 3 and check_pieces(rows, doc_rows, library) <= shards


def test_neighbours_are_ranked_by_bm25():
    docs = [[5, 5, 6], [5, 7], [8, 9], [6, 6, 6, 5]]
    flat, at = np.concatenate([np.array(d) for d in docs]), np.cumsum([0] + [len(d) for d in docs])
    freq = np.zeros(1 << 17, np.int64)
    for d in docs:
        freq[list(set(d))] += 1
    shard, mean = Shard(flat, at, freq, len(docs), len(flat) / len(docs)), len(flat) / len(docs)

    def bm25(q, d):
        idf = lambda t: np.log1p((len(docs) - freq[t] + 0.5) / (freq[t] + 0.5))
        return sum(idf(t) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q))

    unused = np.array([False, True, True, True])
    want = sorted((i for i in (1, 2, 3) if bm25(docs[0], docs[i])), key=lambda i: -bm25(docs[0], docs[i]))
    assert shard.neighbours(0, unused).tolist() == want
    assert shard.neighbours(0, unused & (np.arange(4) != want[0])).tolist() == want[1:]


def test_windows_take_neighbours_first():
    docs = [[5] * 9, [6] * 9, [5] * 4 + [7], [6] * 4 + [8]]
    flat, at = np.concatenate([np.array(d) for d in docs]), np.cumsum([0] + [len(d) for d in docs])
    freq = np.zeros(1 << 17, np.int64)
    for d in docs:
        freq[list(set(d))] += 1
    order = list(dict.fromkeys(p[0] for p in pack(np.diff(at), Shard(flat, at, freq, 4, 7.0), 16)))
    assert order == [0, 2, 1, 3]


def test_row_tokens():
    row, token, times = row_tokens(np.array([3, 3, 1, 2, 2]), np.array([0, 3, 3, 5]))
    assert (row.tolist(), token.tolist(), times.tolist()) == ([0, 0, 2], [1, 3, 2], [1, 2, 2])


def test_a_long_seed_asks_for_all_its_tokens():
    """Neighbours that share only the 26th to 30th heaviest token of the seed are found."""
    docs = [list(range(10, 40)), [39], [38, 38], [50]]
    flat, at = np.concatenate([np.array(d) for d in docs]), np.cumsum([0] + [len(d) for d in docs])
    freq = np.full(1 << 17, 500)
    freq[10:35] = 2
    assert sorted(Shard(flat, at, freq, 1000, 10.0).neighbours(0, np.array([False, True, True, True])).tolist()) == [1, 2]


def test_neighbours_meet_over_shards(spark, library, monkeypatch):
    """Topics whose words do not overlap: a window holds documents of one topic, however many shards there are."""
    monkeypatch.setattr("episodeflow.llm.retrieval_packing.SHARD_TOKENS", 12_000)
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(800)]
    texts = [(i, " ".join(rnd.choices(words[i % 40 * 20: i % 40 * 20 + 20], k=60))) for i in range(320)]
    rows = packed(spark.createDataFrame(texts, "doc_id long, text string"), window=512).collect()
    shards = len({r.sequence_id >> 32 for r in rows})
    assert shards > 3 and check_pieces(rows, texts, library, 512) <= shards
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r.doc_id % 40)
    assert np.mean([len(set(x)) == 1 for x in by_sequence.values()]) > 0.7


def test_rows_go_down_the_tree_once(documents, doc_rows, library, monkeypatch):
    """Cells are counted on a share of the rows; whatever the estimate, a task's rows are cut into shards within the limit."""
    from episodeflow.llm import retrieval_packing as r
    seen = []
    real = r.row_cells
    monkeypatch.setattr(r, "row_cells", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    monkeypatch.setattr(r, "SHARD_TOKENS", 30_000)
    monkeypatch.setattr(r, "COUNTED", 1)
    rows = packed(documents).collect()
    assert seen[0] < len(doc_rows) and seen[1:] == [len(doc_rows)]
    assert check_pieces(rows, doc_rows, library) <= len({x.sequence_id >> 32 for x in rows})


def test_shards_of_a_task_go_on_in_the_open_window():
    assert [*r_shards(np.array([4, 4, 3, 20, 1]), 10)] == [(0, 2), (2, 3), (3, 4), (4, 5)] and not [*r_shards(np.zeros(0, int), 10)]
    lengths, at = np.array([5, 5]), np.array([0, 4, 8])
    freq = np.full(1 << 17, 1)
    shard = Shard(np.array([7] * 8), at, freq, 2, 4.0)
    assert [*pack(lengths, shard, 8, 3, 6)] == [(0, 0, 2, 3, 6), (0, 2, 3, 4, 0), (1, 0, 5, 4, 3)]


def test_centres_by_full_and_by_sparse_rows(monkeypatch):
    from episodeflow.llm import retrieval_packing as r
    rnd = np.random.default_rng(4)
    ids, at = rnd.integers(0, 90, 4000), np.concatenate([[0], np.sort(rnd.integers(0, 4000, 299)), [4000]])  # some rows are empty
    rows = Statistics(np.bincount(row_tokens(ids, at)[1], minlength=1 << 17), 300, 13.0).vectors(ids, at)
    centres = r.fit_centres(rows.take(np.arange(0, 300, 3)), 8)
    monkeypatch.setattr(r, "PASS_TERMS", 1000)
    full = centres.nearest(rows)
    monkeypatch.setattr(r, "DENSE", 0)
    monkeypatch.setattr(r, "PASS_TOKENS", 50)
    assert len(set(full.tolist())) > 3 and full.tolist() == centres.nearest(rows).tolist()


def test_used_documents_leave_the_postings(monkeypatch):
    """The same neighbours in the same order, ties too, as without leaving and with one sort."""
    from episodeflow.llm import retrieval_packing as r
    rnd = np.random.default_rng(3)
    ids, at = rnd.integers(0, 60, 3000), np.arange(0, 3001, 10)
    freq = np.bincount(row_tokens(ids, at)[1], minlength=1 << 17)
    lengths = np.diff(at) + 1
    pieces = [*pack(lengths, Shard(ids, at, freq, 300, 10.0), 32)]
    monkeypatch.setattr(r, "LEFT", 0.0)
    monkeypatch.setattr(r, "FIRST", 10_000)
    assert pieces == [*pack(lengths, Shard(ids, at, freq, 300, 10.0), 32)]


def test_copies_are_dealt_on_and_cells_share_tasks():
    assert cell_tasks({0: 3, 1: 4, 2: 25, 3: 1, 4: 9, 5: 1}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 4: (4, 1), 5: (5, 1)}
    ids = np.array([7, 8, 9] * 50)
    freq = np.full(1 << 17, 1)
    assert Tree(Statistics(freq, 50, 3.0).vectors(ids, np.arange(0, 151, 3)), 8.0).n_cells == 1


def test_neighbour_recall_counts_the_own_task():
    row, token, weight = np.array([0, 1, 2, 3]), np.array([5, 5, 6, 6]), np.ones(4)
    assert neighbour_recall(np.array([0, 0, 1, 1]), (row, token, weight), np.arange(4), 1) == 1.0
    assert neighbour_recall(np.array([0, 1, 0, 1]), (row, token, weight), np.arange(4), 1) == 0.0
