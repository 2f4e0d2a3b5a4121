"""Answer parsers (R1-R11) as native Column builders, plus the named registry.

Every parser maps a text Column to ``(reason, action)`` Columns built from
``regexp_extract`` / ``replace`` / ``btrim``; nothing runs in Python per row.

Regex dialect: Python's ``\\s`` on text is the set of characters for which
``str.isspace()`` is true. Java's ``\\s`` is narrower, so the set is spelled
out as an explicit class, derived from that rule once at import time.
"""

from __future__ import annotations

import sys
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str methods and re module see it (derived by rule).
PY_WHITESPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]"


def strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


# Answer markers of the plain and corrected dialects.
REASON, ACTION = "REASON:", "ACTION:"
C_REASON, C_ACTION = "CORRECTED_REASON:", "CORRECTED_ACTION:"


def _locate(needle: str, text: Column, start: Column) -> Column:
    """1-based position of ``needle`` in ``text`` at or after ``start``; 0 if absent."""
    return F.call_function("locate", F.lit(needle), text, start)


def _between(text: Column, r: str, a: str) -> tuple[Column, Column]:
    """(found, text between the first ``r`` and the first ``a`` after it).

    The same span as the dot-all search ``r\\s*(.*?)\\s*a`` once stripped, found
    with ``instr``/``locate`` in one linear pass instead of a lazy regex.
    """
    p1 = F.instr(text, r)
    start = p1 + F.lit(len(r))
    p2 = _locate(a, text, start)
    return (p1 > 0) & (p2 > 0), F.substr(text, start, p2 - start)


def _reason(text: Column, r: str, a: str) -> Column:
    found, inner = _between(text, r, a)
    return F.when(found, strip(inner)).otherwise(text)


def _line_action(text: Column, a: str) -> Column:
    """First non-blank line after the first ``a`` (the span of ``a\\s*([^\\n]+)``), stripped.

    Whitespace-only text after the marker gives '' either way, so the first
    marker decides.
    """
    p = F.instr(text, a)
    rest = F.ltrim(F.substr(text, p + F.lit(len(a))), F.lit(PY_WHITESPACE))
    return F.when(p > 0, strip(F.substring_index(rest, "\n", 1))).otherwise(F.lit(""))


def _clean(action: Column) -> Column:
    return F.regexp_replace(F.lower(action), "[^a-z0-9 /]", "")


def parse_game(text: Column) -> tuple[Column, Column]:
    """Reason between the markers (else the whole text); first non-blank action line, cleaned."""
    return _reason(text, REASON, ACTION), _clean(_line_action(text, ACTION))


def parse_shop(text: Column) -> tuple[Column, Column]:
    """R2: as R1 without action clean-up."""
    return _reason(text, REASON, ACTION), _line_action(text, ACTION)


def parse_shell(text: Column) -> tuple[Column, Column]:
    """Literal backslash-n becomes a newline; a closed fenced block after ACTION: wins."""
    t = F.replace(text, F.lit("\\n"), F.lit("\n"))
    fence = f"(?s){ACTION}{WS}*```[a-zA-Z]*{WS}*(.*?){WS}*```"
    # The fence regex only runs on texts that contain a fence at all.
    hit = F.contains(t, F.lit("```")) & t.rlike(fence)
    action = F.when(hit, strip(F.regexp_extract(t, fence, 1))).otherwise(_line_action(t, ACTION))
    return _reason(t, REASON, ACTION), action


def parse_sql(text: Column) -> tuple[Column, Column]:
    """R3, first line only, cut after the first ';' (kept)."""
    reason, action = parse_shell(text)
    first = F.substring_index(action, "\n", 1)
    cut = F.when(F.contains(first, F.lit(";")),
                 F.concat(F.substring_index(first, ";", 1), F.lit(";"))).otherwise(first)
    return reason, cut


def parse_corrected(text: Column) -> tuple[Column, Column]:
    """CORRECTED_REASON / CORRECTED_ACTION with R1 clean-up."""
    return _reason(text, C_REASON, C_ACTION), _clean(_line_action(text, C_ACTION))


PARSERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "game": parse_game,
    "shop": parse_shop,
    "shell": parse_shell,
    "sql": parse_sql,
    "corrected": parse_corrected,
}


def get_parser(name: str) -> Callable[[Column], tuple[Column, Column]]:
    """Named parser registry; unknown names are an error."""
    try:
        return PARSERS[name]
    except KeyError:
        raise ValueError(f"unknown parser {name!r}; known: {sorted(PARSERS)}") from None


# --- R6/R7: fenced JSON block and repair --------------------------------------

def json_block(text: Column) -> Column:
    """First block between a json fence line and a closing fence line, else null.

    The first opening line and the first closing line after it, found with ``instr``/``locate``.
    """
    opening = "```json\n"
    p1 = F.instr(text, opening)
    start = p1 + F.lit(len(opening))
    p2 = _locate("\n```", text, start)
    return F.when((p1 > 0) & (p2 > 0), F.substr(text, start, p2 - start))


def json_repair(block: Column) -> Column:
    """Escaped quote -> ', double every backslash, squeeze whitespace, drop trailing commas.

    Whitespace runs become one space by mapping every whitespace character to
    a space (``translate``) and collapsing runs of spaces; after that the
    trailing-comma rules only ever see single spaces.
    """
    s = F.replace(block, F.lit('\\"'), F.lit("'"))
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.translate(s, PY_WHITESPACE, " " * len(PY_WHITESPACE))
    s = F.regexp_replace(s, " +", " ")
    s = F.regexp_replace(s, ", ?}", "}")
    s = F.regexp_replace(s, ", ?]", "]")
    return s


# --- R10/R11 ---------------------------------------------------------------

TASK_MARK = "\n\nYour task is to: "


def task_extract(obs: Column, marker: str = TASK_MARK) -> Column:
    """Rest of the line after the task marker, else ''."""
    return F.regexp_extract(obs, "\\Q" + marker + "\\E([^\\n]*)", 1)


GAME_MARK = "json_2.1.1/"


def path_key(path: Column, marker: str = GAME_MARK) -> Column:
    """Part of the path after the first marker, null if absent."""
    pos = F.instr(path, marker)
    return F.when(pos > 0, F.substr(path, pos + F.lit(len(marker))))
