"""Response jobs: parse, JSON extraction/repair/parse, each with a reject/status column.

``responses -> parsed (reason, action, status)``; everything is a projection,
so the job is a single map stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodeflow.functions import parsers as R


def parse_responses(df: DataFrame, dialect: str, text: str = "response") -> DataFrame:
    """R1-R5 as one bulk job; ``status`` tells ok / no_reason / no_action."""
    parse = R.get_parser(dialect)
    reason, action = parse(F.col(text))
    markers = (R.C_REASON, R.C_ACTION) if dialect == "corrected" else (R.REASON, R.ACTION)
    has_reason = F.col(text).contains(markers[0]) & (
        R._locate(markers[1], F.col(text), F.instr(F.col(text), markers[0]) + F.lit(len(markers[0]))) > 0)
    status = (F.when(action == "", F.lit("no_action"))
               .when(~has_reason, F.lit("no_reason"))
               .otherwise(F.lit("ok")))
    return df.withColumn("reason", reason).withColumn("action", action).withColumn("status", status)


def json_valid(s: Column) -> Column:
    """R8 validity: the text is one JSON object or array with nothing after it.

    Repeated keys and NaN are accepted, as Python's parser does: the text is
    read as the only element of an array, which also rules out a second value.
    """
    t = R.strip(s)
    one = F.concat(F.lit("["), t, F.lit("]"))
    read = lambda kind: F.coalesce(F.size(F.from_json(one, f"array<{kind}>")) == 1, F.lit(False))
    return F.coalesce(F.when(t.startswith("{") & t.endswith("}"), read("map<string,string>"))
                       .when(t.startswith("[") & t.endswith("]"), read("array<string>")), F.lit(False))


def json_answers(df: DataFrame, schema: str, text: str = "response") -> DataFrame:
    """R6 -> R7 -> R8: fenced block, repaired, parsed to ``schema``; status for rejects."""
    block = R.json_block(F.col(text))
    fixed = R.json_repair(block)
    ok = json_valid(fixed)
    return df.select(
        "*",
        F.when(ok, F.from_json(fixed, schema)).alias("answer"),
        F.when(block.isNull(), F.lit("no_block"))
         .when(~ok, F.lit("invalid_json")).otherwise(F.lit("ok")).alias("status"),
    )


def _last_keys(m: Column) -> Column:
    """A parsed object whose repeated keys keep their last value only."""
    pairs = F.map_entries(m)
    return F.map_from_entries(F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"])))


def trajectory_answers(df: DataFrame, text: str = "response") -> DataFrame:
    """The block must be an object whose ``trajectory`` is a list of objects.

    Whatever R8 accepts is parsed, repeated keys (the last one counts) and NaN too. A list of
    anything but objects or a missing key is a reject, not a list of nulls.
    """
    top = F.get(F.from_json(F.concat(F.lit("["), R.strip(F.col("_fixed")), F.lit("]")), "array<map<string,string>>"), 0)
    hits = F.filter(F.map_entries(F.col("_top")), lambda e: e["key"] == F.lit("trajectory"))
    rows = (df.withColumn("_block", R.json_block(F.col(text))).withColumn("_fixed", R.json_repair(F.col("_block")))
              .withColumn("_valid", json_valid(F.col("_fixed"))).withColumn("_top", F.when(F.col("_valid"), top))
              .withColumn("_parsed", F.from_json(F.get(hits, F.size(hits) - 1)["value"], "array<map<string,string>>")))
    listed = F.col("_parsed").isNotNull() & ~F.exists("_parsed", lambda m: m.isNull())
    return rows.select(
        *df.columns,
        F.when(listed, F.transform("_parsed", _last_keys)).alias("trajectory"),
        F.when(F.col("_block").isNull(), F.lit("no_block"))
         .when(~F.col("_valid"), F.lit("invalid_json"))
         .when(~F.coalesce(listed, F.lit(False)), F.lit("not_a_list_of_objects")).otherwise(F.lit("ok")).alias("status"),
    )
