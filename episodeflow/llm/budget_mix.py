"""Operator 5: mixing sources to target weights by hierarchical budgeting. Native.

The tree is domain, language, source; its leaves are the sources of a language in a domain. A token
budget goes down the tree by weight. A node that has fewer tokens than its share (``epochs`` passes
over all its leaves) takes what it has; its shortage goes to its siblings by weight. A parent never
gets more than its leaves hold, so a shortage leaves the parent only when no sibling can take it.
Each leaf then selects a prefix of its documents, in an order seeded anew for each epoch: whole
epochs first, then the documents whose running token total stays within the rest of the budget.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. All arithmetic is on integers. Only sums of the leaves and
of ``CELLS`` hash ranges a leaf are aggregated; running totals of rows are only taken inside the one
hash range where a leaf's budget ends, so a hot source is never in one task.

Defined results: null language or source counts as ''; a source without a domain belongs to
``other``; values without a weight have weight 1, a weight of 0 selects nothing; a null or empty
text has no tokens and is selected with its place in the order; a null id orders as ''; repeated
rows are ordered by the rest of their columns and equal ones may share a place; an empty table gives
an empty result; columns of the input with the names of the result are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodeflow.llm.common import land

CELL_DIGITS = 3
CELLS = 16**CELL_DIGITS
LEVELS = ("domain", "lang", "source")
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by value of each level, and how much to select."""

    domain_of: dict[str, str] = field(default_factory=dict)
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    #: Share of the available tokens (one epoch) that makes the budget, in hundredths.
    percent: int = 70
    epochs: int = 2
    seed: int = 11


#: The production mix: the hot source is a domain of its own that is weighed down.
PRODUCTION = Mix(
    domain_of={"src0": "crawl", **{f"src{i}": "web" for i in range(1, 12)}, **{f"src{i}": "curated" for i in range(12, 20)}},
    weights={"domain": {"crawl": 20, "web": 45, "curated": 35}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}})


def _pick(values: dict, column: Column, default) -> Column:
    out = None
    for k, v in sorted(values.items()):
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent columns, name, budget of the parent, weight, cap) with each node's own ``share``.

    Siblings whose cap is below their part of what is left are saturated first, in order of cap
    over weight; the others divide the rest by weight, rounded down.
    """
    live = F.col("weight") > 0
    nodes = nodes.withColumn("ratio", F.when(live, F.col("cap") / F.col("weight"))).withColumn("w", F.when(live, F.col("weight")).otherwise(0).cast("decimal(38,0)"))
    order = Window.partitionBy(*parent).orderBy(F.col("ratio").asc_nulls_last(), name) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").asc_nulls_last(), name)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    cap = F.when(live, F.col("cap")).otherwise(0).cast("decimal(38,0)")
    nodes = (nodes.withColumn("held", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
             .withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)"))
             .withColumn("left", F.greatest(F.col("budget").cast("decimal(38,0)") - F.col("held"), F.lit(0).cast("decimal(38,0)"))))
    full = live & (F.expr("try_multiply(left, w)") >= F.expr("try_multiply(cast(cap as decimal(38,0)), open_w)"))
    nodes = nodes.withColumn("full", full)
    first_open = F.min(F.when(live & ~F.col("full"), F.struct(F.col("ratio"), F.col(name).alias("n"), "left", "open_w"))).over(whole)
    nodes = nodes.withColumn("rest", first_open)
    share = F.when(~live, F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(div(rest.left * w, rest.open_w) as bigint)"))
    return nodes.withColumn("share", share.cast("long")).drop("ratio", "w", "held", "open_w", "left", "full", "rest", "budget", "weight", "cap")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``domain, lang, source, share`` from ``domain, lang, source, tokens`` (one row for each leaf)."""
    caps = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    total = int(leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.percent // 100
    level = None
    for i, name in enumerate(LEVELS):
        parent = list(LEVELS[:i])
        nodes = caps.groupBy(*parent, name).agg(F.sum("cap").alias("cap")).withColumn("weight", _pick(mix.weights.get(name, {}), F.col(name), 1))
        nodes = nodes.join(level.withColumnRenamed("share", "budget"), parent) if parent else nodes.withColumn("budget", F.lit(total))
        level = _share(nodes, parent, name)
    return level


def keyed(docs: DataFrame, mix: Mix, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    return docs.select(F.col(id_col).alias("id"), lang.alias("lang"), source.alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
                       ).withColumn("domain", _pick(mix.domain_of, F.col("source"), "other"))


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def select(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col, domain, lang, source, epoch, n_words, budget``: a row for each time a document is selected."""
    leaf = list(LEVELS)
    rows = land(keyed(docs, mix, id_col, text_col, lang_col, source_col), "mix-rows")
    leaves = rows.groupBy(*leaf).agg(F.sum("n_words").alias("tokens"))
    plan = budgets(leaves, mix).join(leaves, leaf).select(*leaf, F.col("share").alias("budget"), F.expr("if(tokens > 0, share div tokens, 0)").cast("int").alias("passes"),
                                                          F.expr("if(tokens > 0, share % tokens, 0)").alias("rest"))
    plan = land(plan, "mix-plan", 1)  # one row for each leaf
    rows = rows.join(plan, leaf)
    whole = rows.filter("passes > 0").withColumn("epoch", F.explode(F.expr("sequence(0, passes - 1)"))).select("id", *leaf, "epoch", "n_words", "budget")
    part = rows.filter("rest > 0").withColumn("epoch", F.col("passes")).withColumn("hash", order_hash(mix.seed, F.col("epoch"), F.col("id"))).withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    sums = part.groupBy(*leaf, "cell", "rest").agg(F.sum("n_words").alias("n"))
    ends = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy("cell"))).withColumn("before", F.col("upto") - F.col("n"))
    ends = ends.filter(F.col("before") <= F.col("rest")).select(*leaf, "cell", "before", (F.col("upto") <= F.col("rest")).alias("inside"))
    part = part.join(ends, [*leaf, "cell"])
    running = Window.partitionBy(*leaf, "cell").orderBy("hash", "id", "n_words").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = part.filter("not inside").withColumn("upto", F.col("before") + F.sum("n_words").over(running)).filter(F.col("upto") <= F.col("rest"))
    cols = ["id", *leaf, "epoch", "n_words", "budget"]
    return whole.unionByName(part.filter("inside").select(*cols)).unionByName(edge.select(*cols)).withColumnRenamed("id", id_col)


def mixed(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id") -> DataFrame:
    """The selected rows of ``docs`` with the columns of ``docs``, a row for each epoch that selects its id."""
    chosen = select(docs, mix, id_col).groupBy(F.col(id_col).alias("_id")).agg(F.countDistinct("epoch").cast("int").alias("_times"))
    rows = docs.join(chosen, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.drop("_id", "_times", "_time")


def _case(values: dict, column: str, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + column + "".join(f" WHEN {lit(k)} THEN {lit(v)}" for k, v in sorted(values.items())) + f" ELSE {lit(default)} END" if values else lit(default)


def sql(mix: Mix = PRODUCTION, docs: str = "documents") -> str:
    """DuckDB SQL of ``select``: water-filling by recursion over saturated siblings."""
    out = f"""WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_words FROM {docs}),
rows_ AS (SELECT *, {_case(mix.domain_of, 'source', 'other')} AS domain FROM r),
leaves AS (SELECT domain, lang, source, sum(n_words)::BIGINT AS tokens FROM rows_ GROUP BY ALL),
level0 AS (SELECT sum(tokens)::HUGEINT * {mix.percent} // 100 AS share FROM leaves)"""
    for i, name in enumerate(LEVELS):
        cols = ", ".join(LEVELS[: i + 1])
        parent = ", ".join(LEVELS[:i])
        over = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN level{i} USING ({parent})" if parent else f"CROSS JOIN level{i}"
        out += f""",
n{i} AS (SELECT {cols}, sum(tokens)::HUGEINT * {mix.epochs} AS cap, {_case(mix.weights.get(name, {}), name, 1)}::HUGEINT AS w FROM leaves GROUP BY {cols}),
o{i} AS (SELECT n{i}.*, share AS budget, CASE WHEN w > 0 THEN cap::DOUBLE / w END AS ratio FROM n{i} {join}),
h{i} AS (SELECT *, coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({over} ORDER BY ratio NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS held,
  (sum(w) OVER ({over} ORDER BY ratio NULLS LAST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open_w FROM o{i}),
f{i} AS (SELECT *, greatest(budget - held, 0) AS left_, w > 0 AND greatest(budget - held, 0) * w >= cap * open_w AS is_full FROM h{i}),
g{i} AS (SELECT *, min(CASE WHEN w > 0 AND NOT is_full THEN {{'a': ratio, 'b': {name}, 'l': left_, 'o': open_w}} END) OVER ({over}) AS rest FROM f{i}),
level{i + 1} AS (SELECT {cols}, CASE WHEN w = 0 THEN 0 WHEN is_full THEN cap ELSE rest.l * w // rest.o END AS share FROM g{i})"""
    return out + f""",
plan AS (SELECT domain, lang, source, share::BIGINT AS budget, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END::INT AS passes, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END::BIGINT AS rest
  FROM level3 JOIN leaves USING (domain, lang, source)),
j AS (SELECT * FROM rows_ JOIN plan USING (domain, lang, source)),
part AS (SELECT *, sum(n_words) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}:' || passes || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_words) AS upto FROM j WHERE rest > 0)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_words, budget FROM j, unnest(range(passes)) t(epoch)
UNION ALL SELECT doc_id, domain, lang, source, passes, n_words, budget FROM part WHERE upto <= rest"""
