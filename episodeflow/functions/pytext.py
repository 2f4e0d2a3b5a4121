"""Column builders for the Python text form of values (X2) and JSON dumps.

Templates print lists and dicts the way Python's ``repr`` does; these
builders produce the same text with native expressions only, so the job
stays inside whole-stage codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's repr escapes these three control characters by name.
_NAMED_ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
# Characters repr() shows as hex escapes: Unicode "Other" and "Separator" classes except the
# space and the three named escapes.
_NONPRINT = "[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cn}\\p{Cs}\\p{Zl}\\p{Zp}\\p{Zs}&&[^ \\t\\n\\r]]"


def _lit(s: str) -> Column:
    return F.lit(s)


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, _lit(a), _lit(b))


def _hex_escape(ch: Column) -> Column:
    cp = F.ascii(ch)
    h = F.lower(F.hex(cp))
    return (F.when(cp < 0x100, F.concat(_lit("\\x"), F.lpad(h, 2, "0")))
             .when(cp < 0x10000, F.concat(_lit("\\u"), F.lpad(h, 4, "0")))
             .otherwise(F.concat(_lit("\\U"), F.lpad(h, 8, "0"))))


def _fold_escapes(text: Column, source: Column, pattern: str, escape) -> Column:
    """Replace every distinct character of ``source`` matching ``pattern`` by ``escape(ch)``.

    Work is one ``replace`` per distinct rare character present (usually a
    handful), not per character of the text.
    """
    found = F.array_distinct(F.regexp_extract_all(source, _lit(pattern), 0))
    return F.aggregate(found, text, lambda acc, ch: F.replace(acc, ch, escape(ch)))


def py_str(c: Column) -> Column:
    """``repr(str)``; null prints as ``None``."""
    use_double = F.contains(c, _lit("'")) & ~F.contains(c, _lit('"'))
    esc = _replace(c, "\\", "\\\\")
    for raw, shown in _NAMED_ESCAPES:
        esc = _replace(esc, raw, shown)
    fast = F.when(use_double, esc).otherwise(_replace(esc, "'", "\\'"))
    # Rare path: non-printable characters become \xNN / \uNNNN / \UNNNNNNNN.
    body = F.when(c.rlike(_NONPRINT), _fold_escapes(fast, c, _NONPRINT, _hex_escape)).otherwise(fast)
    quote = F.when(use_double, _lit('"')).otherwise(_lit("'"))
    return F.when(c.isNull(), _lit("None")).otherwise(F.concat(quote, body, quote))


def py_dict(fields: Sequence[tuple[str, Column]]) -> Column:
    """``repr`` of a dict of string values, keys in the given order."""
    parts: list[Column] = [_lit("{")]
    for i, (k, v) in enumerate(fields):
        parts.append(_lit(("" if i == 0 else ", ") + repr(k) + ": "))
        parts.append(py_str(v))
    parts.append(_lit("}"))
    return F.concat(*parts)


def py_list(arr: Column, render=py_str) -> Column:
    """``repr`` of a list; ``render`` maps one element Column to its text."""
    body = F.array_join(F.transform(arr, render), ", ")
    return F.when(arr.isNull(), _lit("None")).otherwise(F.concat(_lit("["), body, _lit("]")))


def py_dict_list(arr: Column, keys: Sequence[str]) -> Column:
    """``repr`` of a list of dicts given as an array of structs."""
    return py_list(arr, lambda x: py_dict([(k, x[k]) for k in keys]))


def py_repr_variant(v: Column, depth: int = 4) -> Column:
    """``repr`` of any JSON value (variant): None, True, numbers, texts, lists, dicts.

    Lists and dicts nested deeper than ``depth`` are shown as JSON text; a
    dict's keys come in the variant's own (sorted) order.
    """
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    out = (F.when(kind == "VOID", _lit("None")).when(kind == "STRING", py_str(text))
            .when(kind == "BOOLEAN", F.initcap(text)))
    if depth:
        items = F.try_variant_get(v, "$", "array<variant>")
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        out = out.when(kind.startswith("ARRAY"), F.concat(
            _lit("["), F.array_join(F.transform(items, lambda x: py_repr_variant(x, depth - 1)), ", "), _lit("]")))
        out = out.when(kind.startswith("OBJECT"), F.concat(
            _lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(
                py_str(e["key"]), _lit(": "), py_repr_variant(e["value"], depth - 1))), ", "), _lit("}")))
    return F.when(v.isNull(), _lit("None")).otherwise(out.otherwise(F.when(
        kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v)).otherwise(text)))


def py_variant(v: Column) -> Column:
    """What a template prints for a JSON value: a text as it is, another value as its ``repr``; null stays null."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", py_repr_variant(v))


# --- X3: json.dumps(obj) with ", " / ": " separators and ASCII escapes -----

_JSON_NAMED = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
               ("\b", "\\b"), ("\f", "\\f")]


def _json_escape_char(ch: Column) -> Column:
    cp = F.ascii(ch)
    hex4 = lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")
    hi = F.floor((cp - 0x10000) / 0x400) + 0xD800
    lo = ((cp - 0x10000) % 0x400) + 0xDC00
    return (F.when(cp < 0x20, F.concat(_lit("\\u"), hex4(cp)))
             .when(cp < 0x7F, ch)
             .when(cp < 0x10000, F.concat(_lit("\\u"), hex4(cp)))
             .otherwise(F.concat(_lit("\\u"), hex4(hi), _lit("\\u"), hex4(lo))))


def json_str(c: Column) -> Column:
    """``json.dumps(str)`` (ensure_ascii); null prints as ``null``."""
    esc = c
    for raw, shown in _JSON_NAMED:
        esc = _replace(esc, raw, shown)
    # Rare path: other control characters and non-ASCII become \uNNNN (surrogate pairs above FFFF).
    rare = "[^\\x{20}-\\x{7e}]"
    esc = F.when(esc.rlike(rare), _fold_escapes(esc, esc, rare, _json_escape_char)).otherwise(esc)
    return F.when(c.isNull(), _lit("null")).otherwise(F.concat(_lit('"'), esc, _lit('"')))


def json_dict(fields: Sequence[tuple[str, Column]], kinds: dict[str, str] | None = None) -> Column:
    """``json.dumps`` of a dict; ``kinds[key]='raw'`` inserts an already-JSON value."""
    kinds = kinds or {}
    parts: list[Column] = [_lit("{")]
    for i, (k, v) in enumerate(fields):
        parts.append(_lit(("" if i == 0 else ", ") + '"' + k + '": '))
        parts.append(F.coalesce(v.cast("string"), _lit("null")) if kinds.get(k) == "raw" else json_str(v))
    parts.append(_lit("}"))
    return F.concat(*parts)


def json_list(arr: Column, render) -> Column:
    body = F.array_join(F.transform(arr, render), ", ")
    return F.when(arr.isNull(), _lit("null")).otherwise(F.concat(_lit("["), body, _lit("]")))


# --- The same builders as one SQL expression (for named columns) -------------
# Building a Column tree from Python costs one Py4J round trip per node (and
# lambdas cost more); a SQL string is parsed once on the JVM side. No
# backslash appears in a SQL literal (char(92) instead), so the text means
# the same under either setting of spark.sql.parser.escapedStringLiterals.

_BS = "char(92)"


def _sql_regex(pattern: str) -> str:
    parts = pattern.split("\\")
    return "concat(" + ", ".join(
        ([f"'{parts[0]}'"] if parts[0] else []) +
        [x for p in parts[1:] for x in (_BS, f"'{p}'") if x != "''"]) + ")"


_NONPRINT_SQL = _sql_regex(_NONPRINT)


def _hex_sql(ch: str) -> str:
    cp = f"ascii({ch})"
    h = f"lower(hex({cp}))"
    return (f"CASE WHEN {cp} < 256 THEN concat({_BS}, 'x', lpad({h}, 2, '0')) "
            f"WHEN {cp} < 65536 THEN concat({_BS}, 'u', lpad({h}, 4, '0')) "
            f"ELSE concat({_BS}, 'U', lpad({h}, 8, '0')) END")


def py_str_sql(x: str) -> str:
    """SQL text of ``py_str`` for the SQL expression ``x``."""
    esc = f"replace({x}, {_BS}, concat({_BS}, {_BS}))"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        esc = f"replace({esc}, char({code}), concat({_BS}, '{letter}'))"
    dq = f"(instr({x}, char(39)) > 0 AND instr({x}, char(34)) = 0)"
    fast = f"CASE WHEN {dq} THEN {esc} ELSE replace({esc}, char(39), concat({_BS}, char(39))) END"
    fold = (f"aggregate(array_distinct(regexp_extract_all({x}, {_NONPRINT_SQL}, 0)), {fast}, "
            f"(acc, ch) -> replace(acc, ch, {_hex_sql('ch')}))")
    body = f"CASE WHEN {x} RLIKE {_NONPRINT_SQL} THEN {fold} ELSE {fast} END"
    quote = f"CASE WHEN {dq} THEN char(34) ELSE char(39) END"
    return f"(CASE WHEN {x} IS NULL THEN 'None' ELSE concat({quote}, {body}, {quote}) END)"


def py_list_sql(arr: str, var: str = "e") -> str:
    body = f"array_join(transform({arr}, {var} -> {py_str_sql(var)}), ', ')"
    return f"(CASE WHEN {arr} IS NULL THEN 'None' ELSE concat('[', {body}, ']') END)"


def py_dict_sql(fields: Sequence[tuple[str, str]]) -> str:
    parts = ["'{'"]
    for i, (k, x) in enumerate(fields):
        parts.append("'" + ("" if i == 0 else ", ") + repr(k).replace("'", "''") + ": '")
        parts.append(py_str_sql(x))
    parts.append("'}'")
    return "concat(" + ", ".join(parts) + ")"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def py_str_of(name: str) -> Column:
    """``py_str`` of a named column, as one parsed SQL expression."""
    return F.expr(py_str_sql(_q(name)))


def py_list_of(name: str) -> Column:
    """``py_list`` of a named array<string> column, as one parsed SQL expression."""
    return F.expr(py_list_sql(_q(name)))


def py_dict_of(fields: Sequence[tuple[str, str]]) -> Column:
    """``py_dict`` of named columns (key, column name), as one parsed SQL expression."""
    return F.expr(py_dict_sql([(k, _q(c)) for k, c in fields]))
