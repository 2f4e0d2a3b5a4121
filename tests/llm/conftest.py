import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long_ = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same), (2, same), (3, None), (4, ""), (5, " \n\t "), (6, "short text"), (7, "Short  TEXT"), (8, long_), (9, long_), (None, same),
            (10, "naïve <|endoftext|> 漢字 don't 12½　x"), (10, "naïve <|endoftext|> 漢字 don't 12½　x"), (11, "a" * 30_000), (12, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, task string, score double, host string"
    out = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src0", None, 5, 6, "x", 0.5, "h") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, kind)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def has(path):
    return os.path.exists(path)
