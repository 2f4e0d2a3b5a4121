"""Operator 12: benchmark decontamination by winnowing, in DataFrame functions only.

1. Words are runs of digits, letters and other non-ASCII characters, A-Z lower-cased. A window is
   ``window`` consecutive words of a benchmark item; an item of fewer words is one window.
2. Winnowing: of every ``window - gram + 1`` consecutive ``gram``-word hashes the least is kept, so
   each span of ``window`` words has exactly one fingerprint, the same in a document and an item.
   A window of fewer words has the hash of all of them; documents supply such hashes only for the
   lengths that the benchmark has.
3. Distinct fingerprints of each document meet those of the benchmark in a semi-join. Texts are
   known by two 64-bit hashes, so copies of a text are examined once.
4. In the texts with a hit, spans at matching fingerprints are extended to the whole window, and the
   words themselves are compared with the distinct windows of the benchmark.
5. Hit words are the union of the matching spans. Windows that lie in the same items share one list
   of items, so a passage of many items is not multiplied by its windows.

The benchmark's tables are joined, never collected; Spark broadcasts them only below its threshold.

Defined results: a null or blank text has no words and is not contaminated; a null item text has no
windows; an item with a null id marks words but is not listed; repeated items count once, repeated
documents are each returned; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeflow.llm.common import land

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]


def lowered(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _upto(count: Column) -> Column:
    """0 .. count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def span(start: Column, n: Column | int, most: int) -> Column:
    """The ``n`` (at most ``most``) words from ``start`` (0 first) as text; ``slice`` would copy all words for each span."""
    return F.concat_ws(" ", *[F.get("words", start + j) if isinstance(n, int) else F.when(n > j, F.get("words", start + j)) for j in range(most)])


def short_hash(n: int, text: Column) -> Column:
    return F.xxhash64(F.lit(n), text)


def short_spans(n: int):
    return lambda start: short_hash(n, span(start, n, n))


def winnowed(rows: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """``rows`` (with ``words``) and ``spans``: the fingerprint of every span, one array for each length."""
    out = rows.withColumn("grams", F.transform(_upto(F.size("words") - (gram - 1)), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(gram)])))
    spans = []
    for n in lengths:
        if n == window:
            keep = window - gram + 1
            spans.append(F.transform(_upto(F.size("grams") - (keep - 1)), lambda i: F.least(*[F.get("grams", i + j) for j in range(keep)]) if keep > 1 else F.get("grams", i)))
        else:
            spans.append(F.transform(_upto(F.size("words") - (n - 1)), short_spans(n)))
    return out.withColumn("spans", F.array(*spans).cast("array<array<bigint>>")).drop("grams")


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Landed ``window, n, fp, same`` (one row a distinct window) and ``same, item``; and the lengths of windows."""
    rows = (items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("words")).filter(F.size("words") > 0)
            .withColumn("n", F.least(F.size("words"), F.lit(window))))
    pairs = land(rows.withColumn("window", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda i: span(i, F.col("n"), window))))
                 .select("window", "n", "item").distinct(), "benchmark-pairs")
    wide = "decimal(38,0)"
    same = F.struct(F.count("item").alias("items"), F.coalesce(F.sum(F.xxhash64("item").cast(wide)), F.lit(0).cast(wide)).alias("a"),
                    F.coalesce(F.sum(F.xxhash64(F.lit(1), "item").cast(wide)), F.lit(0).cast(wide)).alias("b"))
    sets = pairs.groupBy("window", "n").agg(same.alias("set"))
    first = sets.groupBy("set").agg(F.min("window").alias("same"))
    distinct = sets.join(first, "set").withColumn("words", F.split("window", " ", -1))
    lengths = sorted(r.n for r in pairs.select("n").distinct().collect())  # at most ``window`` numbers
    long_ = winnowed(distinct.filter(F.col("n") == window), [window], window, gram).withColumn("fp", F.get(F.get("spans", F.lit(0)), F.lit(0)))
    short = distinct.filter(F.col("n") < window).withColumn("fp", short_hash(F.col("n"), F.col("window")))
    out = land(long_.select("window", "n", "fp", "same").unionByName(short.select("window", "n", "fp", "same")), "benchmark-windows")
    named = land(out.select("same").distinct().join(pairs.filter("item is not null").select(F.col("window").alias("same"), "item"), "same"), "benchmark-items")
    return out, named, lengths


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` of each document."""
    windows, named, lengths = benchmark_windows(items, item_col, item_text_col, window, gram)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    fingerprints = windows.select("fp").distinct()

    # Texts with a fingerprint of the benchmark. (The outer forms of the generators keep the optimizer from filtering by their
    # arrays below the projections that make them, where nested transforms would run once for each element.)
    kept = winnowed(rows.select(*_KEY, words(F.col("text")).alias("words")), lengths, window, gram)
    kept = kept.select(*_KEY, F.explode_outer(F.array_distinct(F.flatten("spans"))).alias("fp"))
    met = land(kept.join(fingerprints, "fp", "left_semi").select(*_KEY).distinct(), "met-texts")
    texts = land(rows.join(met, _KEY, "left_semi").dropDuplicates(_KEY).select(*_KEY, words(F.col("text")).alias("words")), "met-words")

    # Their spans at such fingerprints, word by word.
    spans = winnowed(texts, lengths, window, gram).select(*_KEY, F.posexplode_outer("spans").alias("length", "fps"))
    n = F.element_at(F.array(*[F.lit(x) for x in lengths or [0]]), F.col("length") + 1)
    spans = spans.select(*_KEY, n.alias("n"), F.posexplode_outer("fps").alias("start", "fp")).join(fingerprints, "fp", "left_semi")
    spans = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("start", "n")).alias("at"))  # no more than the text has words, for each length
    spans = (texts.join(spans, _KEY).withColumn("at", F.transform("at", lambda x: F.struct(x.start.alias("start"), x.n.alias("n"), span(x.start, x.n, window).alias("window"))))
             .select(*_KEY, F.inline_outer("at")))
    hits = land(spans.join(windows.select("window", "n", "same"), ["window", "n"]).select(*_KEY, "start", (F.col("start") + F.col("n")).alias("stop"), "same"), "hit-spans")

    before = Window.partitionBy(*_KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    n_hit = hits.select(*_KEY, covered.alias("n")).groupBy(*_KEY).agg(F.sum("n").alias("n_hit"))
    listed = (hits.select(*_KEY, "same").distinct().join(named, "same").select(*_KEY, "item").distinct()
              .groupBy(*_KEY).agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = n_hit.join(listed, _KEY, "left").select(*_KEY, "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    found = found.select(*_KEY, "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    sized = rows.select("id", *_KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return sized.join(found, _KEY, "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
item_starts AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM item_starts),
doc_starts AS (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
hits AS (SELECT s.row, s.i, s.n, v.item_id FROM doc_starts s JOIN windows v ON v.n = s.n AND v.t = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
hit_words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.row = d.row LEFT JOIN items i ON i.row = d.row
"""
