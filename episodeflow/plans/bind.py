"""Binding of the driver tables to the logical tables of the episode model.

Logical table            driver table   rule
-----------------------  -------------  ---------------------------------------------
text steps               conversations  episode = conv_id; a step is a ``user`` turn
                                        whose next turn is ``assistant``; observation =
                                        user text, reason = assistant text, action =
                                        first line of the assistant text; step = 0-based;
                                        the ``system`` turn text is the task
scored steps             events         episode = user_id; order (ts, event_id);
                                        observation = props, action = event_type,
                                        score = value
event candidates         events         sorted distinct event types of the user minus the
                                        one at index user_id % 5
is_corrected             conversations  null if conv_id % 3 = 0, false if
                                        (conv_id + turn) % 3 = 1, else true
corrected reason/action  conversations  reason/action of the next step, else its own
text candidates          conversations  previous step's action (if any) and this action
state                    supplier       id = string(s_suppkey), text = s_name (fewer suppliers
                                        than users: the rest are lookup misses)
summaries                orders         key = o_custkey, model = o_orderstatus,
                                        num_actions = count, score = floor(avg price /
                                        50000) / 10
category                 customer       c_mktsegment, HOUSEHOLD mapped to null
goals                    part           idx = p_partkey, instruction = p_name,
                                        attributes = [brand, type, size], price_upper =
                                        p_retailprice, category = p_type
datasets                 documents      directory = source, row = doc_id
usage                    conversations  prompt_tokens = len(user text),
                                        completion_tokens = len(assistant text), model by
                                        conv_id % 4 (one local, free; one without a price)
attempts                 events         attempt = number within (user_id, event_type),
                                        valid = value > 5
responses                events+docs    doc_id = event_id; 'REASON: ' + whole document text +
                                        '\\nACTION: ' + event type (variants by event_id)

All of these are plain projections, filters and windows partitioned by the
episode key, so one exchange on the key serves every window of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodeflow.sources.tables import read_table

NL = "\n"


def first_line(c: Column) -> Column:
    return F.substring_index(c, NL, 1)


def text_steps(conversations: DataFrame, skew_safe: bool = False) -> DataFrame:
    """conversations -> one row per (episode_id, step).

    Default: windows partitioned by the conversation (one exchange for all
    of them); right when conversations are bounded, as episodes are by the
    action caps. ``skew_safe=True`` gives the same rows from distributed
    ranks and equi-joins on (episode, position +- 1) only, for inputs where
    one conversation may hold a large share of all turns.
    """
    if skew_safe:
        return _text_steps_joins(conversations)
    by_conv = Window.partitionBy("conv_id").orderBy("turn")
    whole = by_conv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = conversations.select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(by_conv).alias("next_role"),
        F.lead("text").over(by_conv).alias("next_text"),
        F.max(F.when(F.col("role") == "system", F.col("text"))).over(whole).alias("task"),
    )
    pairs = turns.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    by_step = Window.partitionBy("episode_id").orderBy("step")
    steps = pairs.select(
        F.col("conv_id").alias("episode_id"),
        (F.row_number().over(by_conv) - 1).cast("int").alias("step"),
        "turn",
        "task",
        F.col("text").alias("observation"),
        F.col("next_text").alias("reason"),
        first_line(F.col("next_text")).alias("action"),
    )
    return _text_step_columns(steps,
                              F.lead("reason").over(by_step), F.lead("action").over(by_step),
                              F.lag("action").over(by_step))


def _text_step_columns(steps: DataFrame, next_reason: Column, next_action: Column,
                       prev_action: Column) -> DataFrame:
    is_corr = (F.when(F.col("episode_id") % 3 == 0, F.lit(None).cast("boolean"))
                .when((F.col("episode_id") + F.col("turn")) % 3 == 1, F.lit(False))
                .otherwise(F.lit(True)))
    # Candidates: the previous step's action (if any) and this step's action.
    cands = F.when(prev_action.isNull(), F.array("action")).otherwise(F.array(prev_action, F.col("action")))
    return steps.select(
        "episode_id", "step", "turn", "task", "observation", "reason", "action",
        is_corr.alias("is_corrected"),
        F.coalesce(next_reason, F.col("reason")).alias("corrected_reason"),
        F.coalesce(next_action, F.col("action")).alias("corrected_action"),
        cands.alias("candidate_actions"),
    )


def _text_steps_joins(conversations: DataFrame) -> DataFrame:
    from episodeflow.operators.steps import step_number

    turns = step_number(conversations.select("conv_id", "turn", "role", "text"),
                        "conv_id", ["turn"], "pos")
    nxt = turns.select(F.col("conv_id").alias("_c"), (F.col("pos") - 1).alias("_p"),
                       F.col("role").alias("next_role"), F.col("text").alias("next_text"))
    task = (conversations.where(F.col("role") == "system").groupBy("conv_id")
            .agg(F.max("text").alias("task")))
    pairs = (turns.join(nxt, (turns["conv_id"] == nxt["_c"]) & (turns["pos"] == nxt["_p"]))
                  .where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
                  .join(task, "conv_id", "left"))
    steps = step_number(pairs.select(
        F.col("conv_id").alias("episode_id"), "turn", "task",
        F.col("text").alias("observation"), F.col("next_text").alias("reason"),
        first_line(F.col("next_text")).alias("action")), "episode_id", ["turn"], "step")
    nb = steps.select(F.col("episode_id").alias("_e"), (F.col("step") - 1).alias("_s"),
                      F.col("reason").alias("_nr"), F.col("action").alias("_na"))
    pb = steps.select(F.col("episode_id").alias("_e2"), (F.col("step") + 1).alias("_s2"),
                      F.col("action").alias("_pa"))
    j = (steps.join(nb, (steps["episode_id"] == nb["_e"]) & (steps["step"] == nb["_s"]), "left")
              .join(pb, (steps["episode_id"] == pb["_e2"]) & (steps["step"] == pb["_s2"]), "left"))
    return _text_step_columns(j, F.col("_nr"), F.col("_na"), F.col("_pa"))


def scored_rows(events: DataFrame) -> DataFrame:
    """events as scored steps before they are numbered (order: ts, event_id)."""
    return events.select(
        F.col("user_id").alias("episode_id"), "event_id", "ts",
        F.col("props").alias("observation"),
        F.col("event_type").alias("action"),
        F.col("value").alias("score"),
    )


def scored_steps(events: DataFrame, skew_safe: bool = True) -> DataFrame:
    """events -> one row per (episode_id, step) with a score.

    Steps are numbered with the distributed per-group rank (W2), so a user
    with a very large share of the events is not sorted inside one task.
    """
    from episodeflow.operators.steps import step_number

    numbered = step_number(scored_rows(events), "episode_id", ["ts", "event_id"], "step", skew_safe=skew_safe)
    return numbered.select("episode_id", "step", "event_id", "ts", "observation", "action", "score")


def event_candidates(events: DataFrame) -> DataFrame:
    """Per user: sorted distinct event types without the one at index user_id % 5."""
    types = events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return types.select(
        F.col("user_id").alias("episode_id"),
        F.filter("types", lambda x, i: i != (F.col("user_id") % 5)).alias("candidate_actions"))


def state_table(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("state"))


def summaries(orders: DataFrame) -> DataFrame:
    return (orders.groupBy(F.col("o_custkey").alias("env_idx"), F.col("o_orderstatus").alias("model_id"))
                  .agg(F.count(F.lit(1)).alias("num_actions"),
                       (F.floor(F.avg("o_totalprice") / 50000) / 10).alias("score")))


def categories(customer: DataFrame) -> DataFrame:
    seg = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None)).otherwise(F.col("c_mktsegment"))
    return customer.select(F.col("c_custkey").alias("env_idx"), seg.alias("category"))


def goals(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("idx"),
        F.col("p_name").alias("instruction"),
        F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("attributes"),
        F.col("p_retailprice").alias("price_upper"),
        F.col("p_type").alias("category"),
    )


def datasets(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("source").alias("dir"), "doc_id", "text")


def usage(steps: DataFrame) -> DataFrame:
    """Text steps -> one usage row per model call (prompt = observation, completion = reason)."""
    kind = F.col("episode_id") % 4
    model = (F.when(kind == 0, F.lit("gpt-4o")).when(kind == 1, F.lit("gpt-4o-mini"))
              .when(kind == 2, F.lit("local-student")).otherwise(F.lit("new-model")))
    return steps.select(
        F.col("episode_id").alias("run_id"), "step",
        model.alias("model"),
        F.when(kind == 2, F.lit("local")).otherwise(F.lit("openai")).alias("provider"),
        F.length("observation").cast("long").alias("prompt_tokens"),
        F.length("reason").cast("long").alias("completion_tokens"),
    )


def attempts(events: DataFrame) -> DataFrame:
    """Attempts as rows: number within (user_id, event_type) by (ts, event_id), skew-safe."""
    from episodeflow.operators.steps import step_number

    ev = events.select(
        F.col("user_id").alias("request_id"),
        F.col("event_type").alias("kind"),
        "ts", "event_id",
        (F.col("value") > 5).alias("valid"),
        F.col("props").alias("text"),
    )
    numbered = step_number(ev, ["request_id", "kind"], ["ts", "event_id"], "_a")
    return numbered.select("request_id", "kind", (F.col("_a") + 1).alias("attempt"), "event_id", "valid", "text")


def responses(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Model answers: a whole document as the reasoning, the event type as the action."""
    # An event without a document of its number reasons with its own props.
    words = F.coalesce("text", "props")
    plain_action = F.concat(F.lit("ACTION: "), F.col("event_type"), F.lit("!"))
    fenced_action = F.concat(F.lit("ACTION: ```bash\n"), F.col("event_type"), F.lit("!\n```"))
    action = F.when(F.col("event_id") % 11 == 0, fenced_action).otherwise(plain_action)
    reason = F.when(F.col("event_id") % 7 == 0, words).otherwise(F.concat(F.lit("REASON: "), words))
    j = events.select("event_id", "event_type", "props").join(
        documents.select(F.col("doc_id").alias("event_id"), "text"), "event_id", "left")
    return j.select("event_id", F.concat(reason, F.lit("\n"), action).alias("response"))


class Tables:
    """Lazy access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def answers(steps: DataFrame) -> DataFrame:
    """Teacher answers per text step, with key-presence flags.

    Rules: episodes with episode_id % 13 = 5 have no answer; those with episode_id % 5 = 1 (and more than one step) lose
    their last answer (length mismatch); episode_id % 7 = 2 lacks
    ``corrected_action`` at step 0; ``original_reason`` is present on even
    steps and null there when (episode_id + step) % 4 = 0; the answer
    carries ``candidate_actions`` (first candidate only) on even episodes;
    ``is_corrected`` is present where the step has one.
    """
    last = F.max("step").over(Window.partitionBy("episode_id"))
    a = steps.withColumn("_last", last)
    a = a.where(F.col("episode_id") % 13 != 5)
    a = a.where(~((F.col("episode_id") % 5 == 1) & (F.col("step") == F.col("_last")) & (F.col("_last") > 0)))
    has_ca = ~((F.col("episode_id") % 7 == 2) & (F.col("step") == 0))
    has_or = F.col("step") % 2 == 0
    has_c = F.col("episode_id") % 2 == 0
    return a.select(
        "episode_id", "step",
        F.lit(True).alias("has_corrected_reason"), "corrected_reason",
        has_ca.alias("has_corrected_action"),
        F.when(has_ca, F.col("corrected_action")).alias("corrected_action"),
        F.lit(False).alias("has_original_observation"),
        F.lit(None).cast("string").alias("original_observation"),
        has_or.alias("has_original_reason"),
        F.when(has_or & ((F.col("episode_id") + F.col("step")) % 4 != 0), F.col("reason")).alias("original_reason"),
        F.lit(False).alias("has_original_action"),
        F.lit(None).cast("string").alias("original_action"),
        has_c.alias("has_candidate_actions"),
        F.when(has_c, F.concat("candidate_actions", F.array("corrected_action"))).alias("candidate_actions"),
        F.col("is_corrected").isNotNull().alias("has_is_corrected"),
        "is_corrected",
    )


_EPOCH_NTZ = "1970-01-01 00:00:00"


def seq_key(ts: Column, tiebreak: Column) -> Column:
    """The pair (ts, tiebreak) as one exact decimal with the same order.

    Microseconds since the epoch (no time zone involved) times 2e19 plus a
    long tiebreak: the gap exceeds the whole long range, and any Spark
    timestamp keeps the product below 1e38. As a ``max_by`` key it keeps the
    aggregate a hash aggregate (a struct key would force a sort aggregate).
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    dec = "decimal(38,0)"
    return micros.cast(dec) * F.lit("20000000000000000000").cast(dec) + tiebreak.cast(dec)


def scored_episodes(events: DataFrame) -> DataFrame:
    """A1 over events without numbering steps first.

    ``max_by(value, (ts, event_id))`` is the score of the last step; a pure
    hash aggregate combines partial results map-side, so a user with a huge
    share of the events is never sorted inside one task.
    """
    return events.groupBy(F.col("user_id").alias("episode_id")).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("value", seq_key(F.col("ts"), F.col("event_id"))).alias("last_score"))


def correction_responses(steps: DataFrame) -> DataFrame:
    """Fenced JSON answers of a teacher for text steps: ``episode_id, attempt, response``.

    Rules, by episode_id: % 13 = 5 has no answer; % 11 = 3 only cut-off JSON
    (three attempts); % 11 = 4 an answer without a block first, then a good
    one; % 11 = 5 no summary; % 5 = 1 (and more than one step) lacks the last
    step; % 7 = 2 lacks ``corrected_action`` at step 0; % 3 = 0 has that key
    with another value before it (the last one counts). ``original_reason`` is
    there on even steps, ``is_corrected`` where the step has one.
    """
    from episodeflow.functions.pytext import json_str

    def pair(k: str, v: Column) -> Column:
        return F.concat(F.lit(f'"{k}": '), v)

    e, s = F.col("episode_id"), F.col("step")
    parts = F.filter(F.array(
        pair("corrected_reason", json_str(F.col("corrected_reason"))),
        F.when((e % 3 == 0) & (s == 0), pair("corrected_action", F.lit('"zzz"'))),
        F.when(~((e % 7 == 2) & (s == 0)), pair("corrected_action", json_str(F.col("corrected_action")))),
        F.when(s % 2 == 0, pair("original_reason", json_str(F.col("reason")))),
        F.when(F.col("is_corrected").isNotNull(), pair("is_corrected", F.col("is_corrected").cast("string")))),
        lambda x: x.isNotNull())
    item = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    per = steps.select("episode_id", F.struct("step", item.alias("j")).alias("i")).groupBy("episode_id").agg(
        F.array_sort(F.collect_list("i")).alias("l"))
    items = F.when((e % 5 == 1) & (F.size("l") > 1), F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(1)))).otherwise(F.col("l"))
    body = F.concat(F.lit("{"), F.when(e % 11 != 5, F.concat(F.lit('"summary": "episode '), e.cast("string"), F.lit('", '))).otherwise(F.lit("")),
                    F.lit('"trajectory": ['), F.array_join(F.transform(items, lambda x: x["j"]), ", "),
                    F.when(e % 11 == 3, F.lit("")).otherwise(F.lit("]}")))
    fenced = F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```"))
    out = per.where(e % 13 != 5).withColumn("attempt", F.explode(
        F.when(e % 11 == 3, F.sequence(F.lit(1), F.lit(3))).when(e % 11 == 4, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return out.select("episode_id", "attempt", F.when((e % 11 == 4) & (F.col("attempt") == 1), F.lit("I cannot.")).otherwise(fenced).alias("response"))
