"""The pipeline's stages against brute force on their own inputs."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from episodeflow.llm.common import land
from test_near_dedup import brute
from test_tokens_packing import check_pieces, ids_of
from tokenizers import Tokenizer

from episodeflow.llm.token_counts import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in P.STAGES:
        frames.append(land(stage(spark, frames[-1], SF), f"test-{name}"))
    for f in frames[:-1]:
        assert f.columns == docs.columns
    ids = [[r.doc_id for r in f.collect()] for f in frames[:-1]]
    for before, after in zip(ids, ids[1:]):
        assert set(after) <= set(before) and len(set(after)) == len(after) > 0
    lang, quality, dedup, mix, pack = frames[1:]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & set(ids[0]) - set(ids[2])) <= 0.02 * len(good & set(ids[0]))  # clean documents stay
    rows = [(r.doc_id, r.text) for r in quality.collect()]
    assert sorted(ids[3]) == sorted(i for i, _, _, kept in brute(rows) if kept)
    words = sum(len(r.text.split()) for r in dedup.collect())
    assert sum(len(r.text.split()) for r in mix.collect()) <= words * P.MIX.percent // 100
    library = Tokenizer.from_file(tokenizer_path())
    assert check_pieces(pack.collect(), [(r.doc_id, r.text) for r in mix.collect()], library) <= 1
    assert ids_of(library, "") == []


def test_odd_rows_and_empty_input(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src0", 0), (2, "x" * 50_000, None, None, 1)], documents.schema)
    for name, docs in (("odd", documents.unionByName(odd)), ("none", documents.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert P.run(spark, f"{tmp_path}/odd").count() > 0
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_repeated_and_null_ids(spark):
    """Rows repeated with their id stay once after near_dedup; rows without an id are judged by their text and stay."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    good = documents.join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(40)
    null = good.orderBy("doc_id").limit(11).withColumn("doc_id", F.lit(None).cast("long")).select(documents.columns)
    junk = spark.createDataFrame([(None, "12 34 56 78", None, None, 11)], documents.schema)
    docs = land(documents.unionByName(good).unionByName(null).unionByName(null).unionByName(junk), "test-odd")
    frames = {}
    at = docs
    for name, stage in P.STAGES[:3]:
        at = frames[name] = land(stage(spark, at, SF), f"test-odd-{name}")
    texts = {r.text for r in null.collect()}
    for name in ("language", "quality"):
        assert sum(r.doc_id is None and r.text in texts for r in frames[name].collect()) >= 2 * 10
        assert not any(r.doc_id is None and r.text not in texts for r in frames[name].collect())
    after = [(r.doc_id, r.text) for r in frames["near_dedup"].collect()]
    assert len(after) == len(set(after)) and sum(i is None for i, _ in after) >= 10
    before = {(r.doc_id, r.text) for r in frames["quality"].collect()}
    want = {i for i, _, _, kept in brute(sorted((x for x in before if x[0] is not None))) if kept}
    assert {i for i, _ in after if i is not None} == want
