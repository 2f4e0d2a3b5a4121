"""Operators 1 and 9: held-out accuracy, hand-made cases, odd rows."""

import zlib

import numpy as np

from episodeflow.llm import language_id, quality_gam
from episodeflow.llm.language_id import identify
from episodeflow.llm.quality_gam import FEATURES, features, fit, quality

SF = "/root/testdata/sf0.01"


def bytes_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in tested]) >= 0.95


def test_labels_of_the_held_out_fold_have_no_influence(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0, 1 - quality, quality) AS quality")
    score = lambda lab: sorted((r.doc_id, r.score) for r in quality(docs, lab).collect())
    assert score(labels) == score(turned)


def test_features_do_not_depend_on_the_batch():
    texts = ["Hello there. One two two two!", "", "A | B | C\nA | B | C", " ", "ÀÉ ß漢", "same same same\nsame same same", "x"]
    whole = features(*bytes_of(texts))
    single = np.concatenate([features(*bytes_of([t])) for t in texts])
    assert whole.shape == (len(texts), len(FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole, single)
    at = {n: i for i, n in enumerate(FEATURES)}
    assert np.allclose([whole[2, at["distinct_lines"]], whole[5, at["distinct_words"]], whole[5, at["repeated_next"]]], [1 / 2, 1 / 6, 5 / 6])


def test_additive_and_pairwise_shapes_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((np.abs(x[:, 0] - 0.5) > 0.25) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = fit(x[:3000], y[:3000])
    assert (1, 2) in [tuple(sorted(p)) for p in model.pairs]
    main_only = quality_gam.Model(model.base, model.cuts, model.main, model.pair_cuts, [], [])
    acc = lambda m: ((m.score(x[3000:]) > 0.5) == y[3000:]).mean()
    assert acc(model) > acc(main_only) >= 0.6


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (7, None, 0), (8, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.filter("quality = 1")):
        rows = quality(odd_docs, lab).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4, 12)}) == 1
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert {r.score for r in quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality(no_docs, labels).collect() == []


def rows_for(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = identify(language_id.document_rows(docs)).collect()
    assert len(rows) == docs.count()
    assert np.mean([r.language == r.declared for r in rows]) > 0.97 and np.mean([r.accepted for r in rows]) > 0.99


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = language_id.page_rows(pages)
    assert rows.filter("declared is null or host is null or suffix is null").count() == 0
    got = identify(rows).collect()
    assert np.mean([r.language == r.declared for r in got]) > 0.95


def test_evidence_is_fused(spark):
    """Text that says nothing follows its declared language, then its host, then its site."""
    en, de = "the cat with the other thing and this", "der hund und die katze nicht schlecht"
    rows = [(i, f"{en} {i}", "en", "com", "a.english.com") for i in range(60)] + [(100 + i, f"{de} {i}", "de", "de", "b.german.de") for i in range(60)]
    unclear = "zzqx"
    rows += [(1000, unclear, "de", None, None), (1001, unclear, None, None, "b.german.de"), (1002, unclear, None, "de", "x.german.de"), (1003, unclear, "en", "com", "a.english.com"),
             (1004, de, "en", "com", "a.english.com"), (1005, None, "en", "com", "a.english.com"), (1006, "12 34", None, None, None), (None, en, None, None, "")]
    got = {r.id: r for r in identify(rows_for(spark, rows)).collect()}
    assert [got[i].language for i in (1000, 1001, 1002, 1003)] == ["de", "de", "de", "en"]
    assert [(got[i].language, got[i].accepted, got[i].confidence) for i in (1005, 1006)] == [(None, False, 0.0)] * 2
    assert got[None].language == "en"
    assert identify(rows_for(spark, rows).limit(0)).collect() == []
    assert {r.accepted for r in identify(rows_for(spark, [(1, en, None, None, None)])).collect()} == {False}


def test_language_of_odd_rows(odd_docs, no_docs):
    rows = identify(language_id.document_rows(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert {r.accepted for r in rows if r.id in (3, 4, 5, 12)} == {False} and {r.accepted for r in rows if r.id in (8, 9)} == {True}
    assert identify(language_id.document_rows(no_docs)).collect() == []


def test_other_languages_and_gibberish_are_rejected(spark):
    """A language left out of the candidates and random letters are not accepted, also below a host of one language; clean rows stay."""
    docs = language_id.document_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    rng = np.random.default_rng(4)
    garbage = [(10**9 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 300)), "en", None, "src0") for i in range(100)]
    garbage += [(2 * 10**9 + i, x * 3, "en", None, "src0") for i, x in enumerate(["Привет, как дела сегодня вечером?", "今日はとても良い天気ですね。", "Hyvää huomenta, mitä sinulle kuuluu tänään?"])]
    rows = [(r.id, r.text, None if r.declared == "es" else r.declared, None, r.host) for r in docs] + garbage
    got = {r.id: r.accepted for r in identify(rows_for(spark, rows)).collect()}
    left_out, clean = [r.id for r in docs if r.declared == "es"], [r.id for r in docs if r.declared not in (None, "es")]
    assert len(left_out) > 20
    assert np.mean([got[i] for i in left_out]) < 0.05 and np.mean([got[r[0]] for r in garbage]) < 0.02
    assert np.mean([got[i] for i in clean]) > 0.98


def test_rare_declared_languages_are_candidates(spark):
    """0.1 % of the rows are enough, and more rows of another language do not change that."""
    rng = np.random.default_rng(6)
    words = {"en": "the cat with other thing and this that house water", "cy": "mae ddim gyda rhywbeth chwarae ysgol llyfr gwybodaeth"}
    text = lambda lang: " ".join(rng.choice(words[lang].split(), 30))
    rows = [(i, text("en"), "en", None, "h") for i in range(8000)] + [(10_000 + i, text("cy"), "cy", None, "h") for i in range(8)]
    rows += [(20_000, text("cy"), None, None, "h")]
    got = {r.id: r for r in identify(rows_for(spark, rows)).collect()}
    assert {(got[i].language, got[i].accepted) for i in (*range(10_000, 10_008), 20_000)} == {("cy", True)}
    assert np.mean([got[i].language == "en" and got[i].accepted for i in range(8000)]) > 0.99
