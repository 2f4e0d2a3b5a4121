"""Operator 12 against a brute-force version."""

import hashlib
import random
import re

import pytest

from episodeflow.llm.decontaminate import decontaminated

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), size)
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k: k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k: k + n]))
                if own is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminated(d, b, **more)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def some_words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.mark.parametrize("vocab", [2, 400])
def test_planted_spans(spark, vocab):
    """Every span of ten words is found: at the ends, over each other, repeated; nine words are not."""
    rng = random.Random(vocab)
    items = [(i, " ".join(some_words(rng, rng.choice([1, 3, 7, 9, 10, 11, 30]) if vocab > 2 else rng.choice([10, 14]), vocab))) for i in range(12)]
    items += [(12, items[-1][1]), (None, " ".join(some_words(rng, 15, vocab))), (13, items[2][1])]
    docs = []
    for i in range(60):
        w = some_words(rng, rng.randrange(0, 60), vocab)
        for _ in range(rng.randrange(0, 3)):
            src = words(rng.choice(items)[1])
            n = rng.choice([3, 9, 10, 12])
            k = rng.randrange(0, max(1, len(src) - n + 1))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = src[k: k + n]
        docs.append((i, rng.choice([" ", ", ", " - "]).join(w)))
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_letters_and_separators(spark):
    item = "Ünïcode Straße 漢字 x1 two three four five six SEVEN eight É"
    docs = [(1, "pre " + item.replace(" ", "@[") + " post"), (2, item.translate(UPPER)), (3, item.replace("É", "é")), (4, item.replace("Ü", "ü")), (5, "İ" + item)]
    assert run(spark, docs, [(7, item), (10, item), (9, item)]) == brute(docs, [(7, item), (10, item), (9, item)])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "short text"), (5, rows[7][1][:9000]), (5, "12½"), (None, "a" * 30_000)]
    b = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, n int")
    got = sorted((tuple(r) for r in decontaminated(odd_docs, b).collect()), key=repr)
    assert got == brute(rows, items)
    assert decontaminated(no_docs, b).collect() == []
    none = decontaminated(odd_docs, b.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_one_passage_in_all_items_and_documents(spark):
    rng = random.Random(2)
    passage = " ".join(some_words(rng, 40, 1000))
    items = [(i, f"q{i} {passage} a{i}") for i in range(30)]
    docs = [(i, f"d{i % 7} {passage} {passage}") for i in range(50)]
    assert run(spark, docs, items) == brute(docs, items)


def test_no_python_in_the_plan(spark, odd_docs):
    b = spark.createDataFrame([(1, "short text")], "item_id long, text string")
    plan = decontaminated(odd_docs, b)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
