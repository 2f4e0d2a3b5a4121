"""Python text form against repr and json.dumps; parsers and JSON repair against literal cases and properties."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from episodeflow.functions import parsers as R
from episodeflow.functions.pytext import json_str, py_dict_list, py_list, py_str

ALPHABET = st.sampled_from(list("ab '\"\\\n\t\r é€ACTIONREASON:```json{},]\x00\x0b\x1c\x7f\x85\xa0\xad\u2028\ufeff;") + ["\U0001F600"])
TEXTS = st.text(alphabet=ALPHABET, max_size=40)


def _col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=30))
def test_py_str_equals_repr(spark, values):
    assert _col(spark, values, py_str) == [repr(v) for v in values]


def test_py_list_and_dicts(spark):
    df = spark.createDataFrame([(["a'b", 'c"d', None],)], "l array<string>")
    assert df.select(py_list(F.col("l"))).first()[0] == repr(["a'b", 'c"d', None])
    d = spark.sql("SELECT array(named_struct('observation', 'x\\ny', 'action', 'go'), "
                  "named_struct('observation', 'it''s', 'action', NULL)) AS h")
    want = repr([{"observation": "x\ny", "action": "go"}, {"observation": "it's", "action": None}])
    assert d.select(py_dict_list(F.col("h"), ["observation", "action"])).first()[0] == want
    e = spark.sql("SELECT CAST(array() AS array<string>) AS l, CAST(NULL AS array<string>) AS n")
    assert e.select(py_list(F.col("l")), py_list(F.col("n"))).first() == ("[]", "None")


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=20))
def test_json_str_equals_dumps(spark, values):
    assert _col(spark, values, json_str) == [json.dumps(v) for v in values]


# dialect, answer, reason, action
PARSED = [
    ("game", "no markers at all", "no markers at all", ""),
    ("game", "REASON: only a reason", "REASON: only a reason", ""),
    ("game", "REASON: a ACTION: b", "a", "b"),
    ("game", "REASON: r\nACTION: go north\nACTION: second", "r", "go north"),
    ("game", "REASON: r\nACTION:\n\n  Open Door 1!  \nmore", "r", "open door 1"),
    ("game", "CORRECTED_REASON: x\nCORRECTED_ACTION: Take Apple!", "x\nCORRECTED_", "take apple"),
    ("game", "REASON:\xa0\tpad\xa0\nACTION: Go\r\n", "pad", "go"),
    ("game", "ACTION:   \n", "ACTION:   \n", ""),
    ("game", "", "", ""),
    ("shop", "REASON: r\nACTION: Search[Red Shoe]", "r", "Search[Red Shoe]"),
    ("shop", "REASON: one\nREASON: two\nACTION: click[x]\nmore", "one\nREASON: two", "click[x]"),
    ("shell", "REASON: r\nACTION: ```bash\nls -la\ncd /\n```", "r", "ls -la\ncd /"),
    ("shell", "REASON: r\nACTION: ``` ls ```", "r", "ls"),
    ("shell", "REASON:\\nliteral newline\\nACTION: ls;rm", "literal newline", "ls;rm"),
    ("shell", "REASON: r\nACTION: ```sql\nSELECT 1", "r", "```sql"),
    ("sql", "REASON: r\nACTION: ```sql\nSELECT 1; SELECT 2\n```", "r", "SELECT 1;"),
    ("sql", "REASON: r\nACTION: ```SELECT a\nFROM t;```", "r", "a"),
    ("sql", "REASON: r\nACTION: SELECT a FROM t", "r", "SELECT a FROM t"),
    ("corrected", "CORRECTED_REASON: x\nCORRECTED_ACTION: Take Apple!", "x", "take apple"),
    ("corrected", "REASON: x\nACTION: y", "REASON: x\nACTION: y", ""),
]


def _parsed(spark, dialect, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r) for r in df.orderBy("i").select(*R.get_parser(dialect)(F.col("s"))).collect()]


def test_parsed_answers(spark):
    for dialect in R.PARSERS:
        mine = [row for row in PARSED if row[0] == dialect]
        assert _parsed(spark, dialect, [row[1] for row in mine]) == [row[2:] for row in mine], dialect


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab {}\"\t\xa0é;`\n"), max_size=30), min_size=1, max_size=20))
def test_parser_properties(spark, values):
    plain = _parsed(spark, "shop", values)
    assert plain == [(v, "") for v in values]  # no marker: the whole text is the reason
    lines = [" ".join(v.split()) or "x" for v in values]
    built = _parsed(spark, "shop", [f"REASON: {v}\nACTION: {v}\nACTION: other" for v in lines])
    assert built == [(v, v) for v in lines]  # what was put in comes out; the first action counts
    cut = _parsed(spark, "sql", [f"REASON: r\nACTION: {v}; second; third" for v in lines])
    assert all(a.count(";") == 1 and a.endswith(";") for (_, a), v in zip(cut, lines) if not {"`", ";"} & set(v))


# answer, block, repaired
JSON_BLOCKS = [
    ('x ```json\n{"a": 1,}\n``` y ```json\n{"b": 2}\n```', '{"a": 1,}', '{"a": 1}'),
    ('```json\n{"t": [1, 2, ],\n "n": "l"}\n```', '{"t": [1, 2, ],\n "n": "l"}', '{"t": [1, 2], "n": "l"}'),
    ('```json\n' + r'{"a": "q\"x\"", "b": "C:\d"}' + '\n```', r'{"a": "q\"x\"", "b": "C:\d"}', r"""{"a": "q'x'", "b": "C:\\d"}"""),
    ('```json\n{"a": NaN}\n```', '{"a": NaN}', '{"a": NaN}'),
    ('```json\n{"a": 1}```', None, None),
    ("no fence", None, None),
]


def test_json_block_and_repair(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(JSON_BLOCKS)], "i int, s string")
    rows = df.orderBy("i").select(R.json_block(F.col("s")), R.json_repair(R.json_block(F.col("s")))).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in JSON_BLOCKS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from('ab {}[]",:\t\n'), max_size=40), min_size=1, max_size=20))
def test_repair_is_idempotent_without_backslashes(spark, values):
    once = _col(spark, values, R.json_repair)
    assert [v for v in once if "\n" in v or "  " in v] == []
    whole = [v for v in once if not any(c in v for c in (",}", ", }", ",]", ", ]"))] or ["a"]
    assert _col(spark, whole, R.json_repair) == whole


def test_task_extract_and_path_key(spark):
    df = spark.createDataFrame([("intro\n\nYour task is to: put a mug in sink.\nmore",), ("Your task is to: x",),
                                ("a/json_2.1.1/train/pick_x/trial",)], "s string")
    got = df.select(R.task_extract(F.col("s")), R.path_key(F.col("s"))).collect()
    assert [g[0] for g in got] == ["put a mug in sink.", "", ""]
    assert [g[1] for g in got] == [None, None, "train/pick_x/trial"]


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=30))
def test_sql_builders_equal_repr(spark, values):
    from episodeflow.functions.pytext import py_dict_of, py_list_of, py_str_of
    df = spark.createDataFrame([(i, v, [v, "x"]) for i, v in enumerate(values)], "i int, s string, l array<string>")
    rows = df.orderBy("i").select(py_str_of("s"), py_list_of("l"), py_dict_of([("observation", "s"), ("action", "s")])).collect()
    assert [r[0] for r in rows] == [repr(v) for v in values]
    assert [r[1] for r in rows] == [repr([v, "x"]) for v in values]
    assert [r[2] for r in rows] == [repr({"observation": v, "action": v}) for v in values]
