"""Prompt, message and training-row jobs (P1-P12) as bulk projections.

A template is plain text with ``{slot}`` placeholders. It is split once on
the driver into literal pieces and slot names, and becomes one ``concat``
of literals and Columns, so rendering runs in whole-stage codegen.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeflow.functions.pytext import py_dict_list, py_list, py_list_of, py_str_of

# The answer layout the parsers expect.
OUTPUT_LAYOUT = "\nREASON:\n{reason}\nACTION:\n{action}\n"

DEFAULT_INPUT = (
    "You act in a text environment. Your task:\n{task}\n\n"
    "Earlier observations and actions:\n{history}\n\n"
    "Reminder, your task:\n{task}\n\n"
    "Current input:\n{{\n    \"observation\": {observation},\n"
    "    \"candidate_actions\": {candidates}\n}}\n\n"
    "Answer with REASON: and ACTION:."
)
# The teacher's variant: the same input with the privileged state of the task.
PRIVILEGED_INPUT = DEFAULT_INPUT.replace(
    "\n\nAnswer with", "\n\nPrivileged state (do not quote it):\n{privileged_state}\n\nAnswer with")


@dataclass(frozen=True)
class Template:
    """Input and output halves of one prompt template."""

    input: str = DEFAULT_INPUT
    output: str = OUTPUT_LAYOUT


def render(text: str, slots: Mapping[str, Column]) -> Column:
    """Template text -> one concat Column. Unknown slots are an error."""
    parts: list[Column] = []
    for literal, name, spec, conv in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in slots:
            raise KeyError(f"template slot {name!r} has no column")
        parts.append(slots[name])
    return F.concat(*parts) if parts else F.lit("")


def shown(c: Column) -> Column:
    """How a template prints a scalar: the text itself, ``None`` when null."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def prompt_slots(steps: DataFrame, history: str = "history",
                 candidates: str | None = "candidate_actions",
                 task: str | None = "task") -> dict[str, Column]:
    """P1 slot values (F10 defaults: no candidates -> "", no task -> "").

    Uses a pre-rendered ``history_text`` column when present (see
    ``steps.step_history_text``), else renders the ``history`` structs.
    """
    if candidates is None or candidates not in steps.columns:
        cands = F.lit("")
    else:
        c = F.col(candidates)
        cands = F.when(c.isNull(), F.lit("")).otherwise(py_list_of(candidates))
    hist = (F.col("history_text") if "history_text" in steps.columns
            else py_dict_list(F.col(history), ["observation", "action"]))
    return {
        "task": F.coalesce(F.col(task), F.lit("")) if task and task in steps.columns else F.lit(""),
        "history": hist,
        "observation": shown(F.col("observation")),
        "candidates": cands,
        # The state joined by ``correct.state_lookup``; without one the slot is empty.
        "privileged_state": F.coalesce(F.col("state"), F.lit("")) if "state" in steps.columns else F.lit(""),
    }


def prompt_build(steps: DataFrame, template: Template = Template(), out: str = "prompt") -> DataFrame:
    """Render the input half for every step (needs the W1 history column)."""
    return steps.withColumn(out, render(template.input, prompt_slots(steps)))


def response_text(reason: Column, action: Column, template: Template = Template()) -> Column:
    """Render the output half."""
    return render(template.output, {"reason": shown(reason), "action": shown(action)})


def message(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def sft_rows(steps: DataFrame, template: Template = Template(),
             reason: str = "reason", action: str = "action") -> DataFrame:
    """prompt/response message arrays."""
    return steps.select(
        "episode_id", "step",
        message("user", render(template.input, prompt_slots(steps))).alias("prompt"),
        message("assistant", response_text(F.col(reason), F.col(action), template)).alias("response"),
    )


def pref_rows(steps: DataFrame, template: Template = Template(),
              chosen=("corrected_reason", "corrected_action"),
              rejected=("reason", "action"), drop_equal: bool = False) -> DataFrame:
    """chosen = corrected answer, rejected = original answer.

    The reference keeps pairs whose two answers are equal; ``drop_equal``
    removes them.
    """
    ch = response_text(F.col(chosen[0]), F.col(chosen[1]), template)
    rj = response_text(F.col(rejected[0]), F.col(rejected[1]), template)
    rows = steps.select(
        "episode_id", "step",
        message("user", render(template.input, prompt_slots(steps))).alias("prompt"),
        message("assistant", ch).alias("chosen"),
        message("assistant", rj).alias("rejected"),
    )
    if drop_equal:
        rows = rows.where(F.col("chosen")[0]["content"] != F.col("rejected")[0]["content"])
    return rows


def teacher_request(steps: DataFrame, state: Column | None = None,
                    system_text: str = "You correct the steps of a student agent.",
                    user_template: str = "Trajectory:\n{trajectory}\n\nPrivileged state:\n{state}",
                    key: str = "episode_id",
                    fields: tuple[str, ...] = ("observation", "candidate_actions", "reason", "action")) -> DataFrame:
    """P5 (+F11, X2): one request per episode: system message + user message with the trajectory text.

    ``fields`` are the step's fields after its ``timestep``; the annotation
    job shows only observation and action. Each step's text is rendered on its own row; the per-episode list is a
    grouped ``collect_list`` of those strings, sorted by step.
    """
    shown_as = [py_list_of(f) if f == "candidate_actions" else py_str_of(f) for f in fields]
    item = F.concat(F.lit("{'timestep': "), F.col("step").cast("string"),
                    *[x for f, c in zip(fields, shown_as) for x in (F.lit(f", '{f}': "), c)], F.lit("}"))
    rows = steps.select(key, F.struct("step", item.alias("t")).alias("_i"),
                        *([state.alias("_st")] if state is not None else []))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias("_steps"),
                                    *([F.first("_st").alias("_state")] if state is not None else []))
    traj = F.concat(F.lit("["), F.array_join(F.col("_steps.t"), ", "), F.lit("]"))
    user = render(user_template, {
        "trajectory": traj,
        "state": shown(F.col("_state")) if state is not None else F.lit("None")})
    return grouped.select(
        key,
        F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")),
                F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))


def goal_state_text(goals: DataFrame) -> DataFrame:
    """Privileged state of a shop goal (price with two decimals)."""
    opts = (py_list(F.coalesce(F.col("goal_options"), F.array().cast("array<string>")))
            if "goal_options" in goals.columns else F.lit("[]"))
    example = F.col("name") if "name" in goals.columns else F.col("instruction")
    text = F.concat(
        F.lit("Instruction: "), shown(F.col("instruction")),
        F.lit("\nAttributes: "), py_list_of("attributes"),
        F.lit("\nPrice upper limit: "), F.format_string("%.2f", F.col("price_upper")),
        F.lit("\nOptions: "), opts,
        F.lit("\nExample product: "), shown(example),
    )
    return goals.select("idx", text.alias("state"))


def gold_state_text(records: DataFrame) -> DataFrame:
    """Privileged state of a shell task (gold command and its recorded output)."""
    text = F.concat(F.lit("Task: "), shown(F.col("task")),
                    F.lit("\nGold command: "), shown(F.col("gold")),
                    F.lit("\nGold output: "), shown(F.col("gold_observation")))
    return records.select("id", text.alias("state"))


# --- P8..P11: chat layout, completion span, truncation, packing ---------------

# The completion marker put before every assistant answer.
RESPONSE_MARKER = "<|response|> "


@dataclass(frozen=True)
class ChatLayout:
    """Per-role header and end text of a chat rendering (a parameter, not a tokenizer)."""

    header: str = "<|{role}|>\n"
    end: str = "\n<|end|>\n"


def chat_text(messages: Column, layout: ChatLayout = ChatLayout()) -> Column:
    """Concatenate messages by a chat layout."""
    pre, post = layout.header.split("{role}")

    def one(m: Column) -> Column:
        return F.concat(F.lit(pre), m["role"], F.lit(post), m["content"], F.lit(layout.end))

    return F.array_join(F.transform(messages, one), "")


def chat_render(rows: DataFrame, layout: ChatLayout = ChatLayout()) -> DataFrame:
    """P8 for SFT rows: prompt messages + marker + response messages."""
    resp = F.transform("response", lambda m: F.struct(
        m["role"].alias("role"), F.concat(F.lit(RESPONSE_MARKER), m["content"]).alias("content")))
    return rows.withColumn("text", F.concat(chat_text(F.col("prompt"), layout), chat_text(resp, layout)))


def pref_chat_render(rows: DataFrame, layout: ChatLayout = ChatLayout()) -> DataFrame:
    """P8 for preference rows: prompt, chosen and rejected each become their chat text."""
    return rows.withColumns({c: chat_text(F.col(c), layout) for c in ("prompt", "chosen", "rejected")})


def completion_span(text: Column, marker: str = RESPONSE_MARKER) -> tuple[Column, Column]:
    """(start, length) of the trained part: everything after the first marker; 0 if absent."""
    pos = F.instr(text, marker)
    start = F.when(pos > 0, pos + F.lit(len(marker))).otherwise(F.lit(0))
    n = F.when(pos > 0, F.length(text) - start + 1).otherwise(F.lit(0))
    return start.cast("long"), n.cast("long")


def left_truncate(text: Column, budget: int, unit: str = "chars", window_per_token: int = 32) -> Column:
    """P10: keep the tail of ``text`` within ``budget`` characters or whitespace tokens.

    For tokens only a suffix window of the text is split: when it holds
    more than ``budget`` tokens, the last ``budget`` of them are complete
    (only the window's first token can be cut), so the result is exact;
    otherwise the whole text is split. Long texts never become huge arrays.
    """
    n = int(budget)
    if unit == "chars":
        return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)
    sep = "[ \\t\\n\\r\\f]+"
    window = n * int(window_per_token)
    tail_toks = F.split(F.substring(text, -window, window), sep)
    use_tail = (F.length(text) > window) & (F.size(tail_toks) > n)
    toks = F.when(use_tail, tail_toks).otherwise(F.split(text, sep))
    kept = F.when(F.size(toks) > n, F.slice(toks, -n, n)).otherwise(toks)
    return F.array_join(kept, " ")


def pack_blocks(rows: DataFrame, length: Column, max_len: int, key: str,
                order: str, shard: str | None = None) -> DataFrame:
    """Consecutive rows fill blocks of ``max_len``: block = floor(running length / max_len).

    Running length is per shard (``shard`` column); without a shard the
    distributed prefix sum is used instead of a single-task window.
    """
    from episodeflow.plans.rank import prefix_sum

    with_len = rows.withColumn("_len", length.cast("long"))
    if shard is None:
        cum = prefix_sum(with_len, [order, key], "_len", "_cum")
    else:
        w = Window.partitionBy(shard).orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0)
        cum = with_len.withColumn("_cum", F.sum("_len").over(w))
    return cum.withColumn("block", F.floor((F.col("_cum") - F.col("_len")) / F.lit(max_len)).cast("long")) \
              .drop("_len")


def search_texts(goals: DataFrame) -> DataFrame:
    """Query, each 'attribute query', lower-cased instruction -> one row each."""
    q = F.col("query") if "query" in goals.columns else F.col("instruction")
    texts = F.concat(F.array(q),
                     F.transform("attributes", lambda a: F.concat(a, F.lit(" "), q)),
                     F.array(F.lower(F.col("instruction"))))
    return goals.select("idx", F.posexplode(texts).alias("pos", "search_text"))
