"""Operators 5 and 7: SQL twins at a small scale, brute force, and their laws."""

import zlib
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from episodeflow.llm import budget_mix, registry, rendezvous_shards
from episodeflow.llm.budget_mix import Mix, budgets, mixed, select
from episodeflow.llm.rendezvous_shards import shards

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(registry.SQL[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == want


def leaf_budgets(spark, leaves, mix):
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    return {(r.domain, r.lang, r.source): r.share for r in budgets(df, mix).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("a", "en", "x", 10), ("a", "en", "y", 1000), ("a", "de", "x", 1000), ("b", "en", "z", 1000)]
    mix = Mix(percent=20, epochs=1)  # 602 tokens: 301 a domain, 150 a language of a, 75 a source of (a, en)
    got = leaf_budgets(spark, leaves, mix)
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 140, ("a", "de", "x"): 150, ("b", "en", "z"): 301}


def test_a_shortage_that_no_sibling_takes_goes_up(spark):
    leaves = [("a", "en", "x", 10), ("a", "en", "y", 20), ("a", "de", "x", 30), ("b", "en", "z", 940)]
    got = leaf_budgets(spark, leaves, Mix(percent=50, epochs=1))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "de", "x"): 30, ("b", "en", "z"): 440}


def test_weights_and_zero_weight(spark):
    leaves = [("a", "en", "x", 1000), ("b", "en", "x", 1000), ("c", "en", "x", 1000)]
    got = leaf_budgets(spark, leaves, Mix(weights={"domain": {"a": 3, "c": 0}}, percent=20, epochs=1))
    assert got == {("a", "en", "x"): 450, ("b", "en", "x"): 150, ("c", "en", "x"): 0}
    assert sum(leaf_budgets(spark, leaves, Mix(percent=100, epochs=5)).values()) == 3000


def test_prefixes_and_epochs(spark, documents):
    mix = Mix(weights={"lang": {"fr": 9}}, percent=60, epochs=3, seed=4)
    words = {r.doc_id: len(r.text.split()) for r in documents.collect()}
    by_leaf = defaultdict(list)
    for r in select(documents, mix).collect():
        by_leaf[r.domain, r.lang, r.source, r.budget].append((r.doc_id, r.epoch))
        assert r.n_words == words[r.doc_id]
    leaf_of = defaultdict(list)
    for r in documents.collect():
        leaf_of["other", r.lang, r.source].append(r.doc_id)
    for (*leaf, budget), got in by_leaf.items():
        want, left, epoch = [], budget, 0
        while True:
            order = sorted(leaf_of[tuple(leaf)], key=lambda i: md5(f"{mix.seed}:{epoch}:{i}".encode()).hexdigest())
            for i in order:
                if words[i] > left:
                    break
                want.append((i, epoch))
                left -= words[i]
            else:
                epoch += 1
                continue
            break
        assert sorted(got) == sorted(want)


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = select(odd_docs).collect()
    assert {r.lang for r in rows} <= {"", "en"} and {r.source for r in rows} <= {"", "src0"}
    assert select(no_docs).collect() == [] and mixed(no_docs).collect() == []
    whole = mixed(odd_docs, Mix(percent=100, epochs=1))
    assert whole.columns == odd_docs.columns
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, odd_docs.collect()))  # a repeated id is not multiplied


def test_rendezvous_law(spark, documents):
    rows = {r.doc_id: r for r in shards(documents, [1.0] * 24, 1.0).collect()}
    bigger = {r.doc_id: r.shard for r in shards(documents, [1.0] * 25).collect()}
    slots = defaultdict(list)
    for r in documents.collect():
        got, data = rows[r.doc_id], r.text.encode()
        assert (got.size, got.text_crc32, got.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert got.grown_shard == bigger[r.doc_id] and got.grown_shard in (got.shard, 24)
        slots[got.shard].append(got.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards_get_their_share(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    before = {r.doc_id: r for r in shards(df, [1.0, 2.0, 5.0], 2.0).collect()}
    n = Counter(r.shard for r in before.values())
    assert [round(n[s] / 2500, 1) for s in range(3)] == [1.0, 2.0, 5.0]
    moved = [r for r in before.values() if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {3} and 0.18 < len(moved) / 20_000 < 0.22


def test_shards_of_odd_rows(odd_docs, no_docs):
    rows = shards(odd_docs, [1.0] * 24, 1.0).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4, 12)} == {(8, 0)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards(no_docs, [1.0] * 24).collect() == []
