"""Operator 9: language identification by Bayesian evidence fusion.

log posterior(l) = tempered text log-likelihood + log P(declared | l) + log P(address suffix | l)
                   + log prior(l | host), normalised over the candidate languages and the class 'other'.

* Text: byte trigrams (A-Z lower-cased) hashed to ``BINS`` bins, one multinomial for each candidate
  language, fitted on at most ``SAMPLE`` declared rows of each language. Candidates are all
  declared values with about ``LEAST_ROWS`` different ids, whatever share of the rows they have;
  the model holds ``BINS`` numbers for each. Rows of rarer declared values have no model to win:
  they are judged by the others and 'other'.
  Trigrams of a text are not independent, so its log-likelihood is its mean over the trigrams,
  weighted by at most ``WEIGHT`` of them.
* Other: any other language or no language. It has the evidence of the best language besides the
  text, and of the text the likelihood of a row that lies ``FLOOR`` spreads below the median row of
  that language. A row's deviation is its mean log-likelihood less the one expected under the
  language's own trigrams, in standard errors of at most ``WEIGHT`` trigrams; median and spread
  (lower quartile) are taken over all rows declared in the language whose text agrees.
* Declared markup language and address suffix: confusion tables of declared value and suffix
  against the language of the text alone, counted over all rows, with add-``SMOOTH`` smoothing.
* Host prior: counts of the text's language over all rows, smoothed hierarchically from all rows
  to the site (last two host labels) to the host with ``STRENGTH`` pseudo-counts.

The text is scored in one pass; tables are grouped aggregates; hosts and declared values join back
as plain joins, which AQE splits when a host is hot.

Defined results: a null or blank text has no text evidence, language null and confidence 0, and is
rejected. Null or unknown declared value, suffix or host give no evidence. A null id stays null; a
repeated row gets a row each time; ties go to the alphabetically first language; without candidates
every row is rejected; an empty table gives an empty result; other columns are ignored.
A row that 'other' wins keeps its most likely candidate as language and is not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodeflow.llm.common import land, passes

BINS = 1 << 15
SAMPLE = 2_000
LEAST_ROWS = 5
WEIGHT = 60.0
SMOOTH = 1.0
STRENGTH = 20.0
#: Spreads below the median row of a language at which 'other' is as likely, and the least spread in standard errors.
FLOOR, LEAST_SPREAD = 12.0, 1.0
#: Posterior that the best language needs.
CONFIDENCE = 0.5


def trigram_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bins of the trigrams that hold a letter in their middle, and their row offsets."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    low[(data >= 9) & (data <= 13)] = 32
    wide = low.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    letter = ((low >= 97) & (low <= 122) | (low >= 128))[1:-1]
    whole = np.ones(len(data), bool)  # no trigram over the end of a row
    ends = offsets[1:-1]
    whole[ends[(ends > 0) & (ends <= len(data))] - 1] = False
    second = ends[ends > 1] - 2
    whole[second] = False
    at = np.flatnonzero(letter & whole[:-2])
    bins = ((code[at] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return bins, np.searchsorted(at, offsets)


def declared_sizes(rows: DataFrame, key: str = "id") -> dict[str, int]:
    """About how many different ids each declared value has."""
    known = rows.filter("declared is not null and declared <> ''").filter(F.col(key).isNotNull())
    return {r.declared: r.n for r in known.groupBy("declared").agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()}


def fit_text_model(rows: DataFrame, languages: list[str], sizes: dict[str, int], key: str = "id") -> np.ndarray:
    """Log-probability of each bin (rows) in each language (columns), from at most ``SAMPLE`` rows of each."""
    # Only rows whose hash is among the lowest of about 2 * SAMPLE ids of their language are ranked.
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, 2.0 * SAMPLE / max(sizes.get(lang, 0), 1)))])
    order = Window.partitionBy("declared").orderBy(F.xxhash64(key, F.lit(41)), key)
    chosen = (rows.filter(F.col("declared").isin(languages)).filter(F.col(key).isNotNull()).select(key, "declared")
              .filter(F.xxhash64(key, F.lit(41)) <= F.element_at(share, F.col("declared")) * 2.0**64 - 2.0**63).distinct()
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE).select(key, "declared"))
    texts = rows.select(key, "text").join(F.broadcast(chosen), key)  # at most SAMPLE rows of each candidate

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BINS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                bins, at = trigram_bins(data, offsets)
                lang = np.array([place[x] for x in part.column(part.schema.names.index("declared")).to_pylist()], np.int64)
                flat = np.repeat(lang, np.diff(at)) * BINS + bins
                total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["lang", "bin", "n"])

    counts = texts.select("declared", "text").mapInArrow(count, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((BINS, len(languages)))
    for r in counts.collect():  # at most BINS rows of each candidate
        table[r.bin, r.lang] += r.n
    # Smoothing is at most a tenth of a language's trigrams: a rare language is no class for everything.
    table += np.clip(0.1 * table.sum(0) / BINS, 1e-4, 0.5)
    return np.log(table / table.sum(0)).astype(np.float32)


def spread_of(model: np.ndarray) -> np.ndarray:
    """Variance of the log-probability of one trigram of each language."""
    p = np.exp(model.astype(np.float64))
    return np.maximum((p * model * model).sum(0) - (p * model).sum(0) ** 2, 1e-3)


def text_likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` without text, with ``n`` (trigrams), ``ll`` (tempered log-likelihood of each language) and ``dev`` (its deviation)."""
    keep = [c for c in rows.columns if c != "text"]
    width = model.shape[1]
    expected = (np.exp(model.astype(np.float64)) * model).sum(0)
    variance = spread_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                bins, at = trigram_bins(data, offsets)
                n = np.diff(at)
                total = np.zeros((len(n), width))
                full = n > 0
                if full.any():
                    total[full] = np.add.reduceat(model[bins], at[:-1][full], axis=0, dtype=np.float64)
                weight = np.minimum(n, WEIGHT)[:, None]
                total *= weight / np.maximum(n, 1)[:, None]
                # (mean - expected) * sqrt(weight / variance)
                deviation = (total - weight * expected) / np.sqrt(np.maximum(weight, 1) * variance)
                total -= total.max(1, keepdims=True) if width else 0
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(x.ravel())) for x in (total, deviation)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(c)) for c in keep] + [pa.array(n), *lists], keep + ["n", "ll", "dev"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(keep).schema) + ", n long, ll array<double>, dev array<double>"
    return rows.select(*keep, "text").mapInArrow(run, schema)


def identify(rows: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """``rows`` has id, text, declared, suffix, host (the last three may be null) and any carried columns.

    Returns the carried columns and id with ``language, confidence, declared, accepted``.
    """
    sizes = declared_sizes(rows)
    languages = sorted(x for x, n in sizes.items() if n >= LEAST_ROWS) if languages is None else sorted(languages)
    carried = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host")]
    if not languages:
        return rows.select(*carried, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(False).alias("accepted"))
    model = fit_text_model(rows, languages, sizes)
    scored = land(text_likelihoods(rows, model).withColumn(
        "best", F.when(F.col("n") > 0, F.array_position("ll", F.array_max("ll")).cast("int") - 1)), "likelihoods")
    langs = F.array(*[F.lit(i) for i in range(len(languages))])
    seen = scored.filter("best is not null")

    def table(by: str) -> DataFrame:
        """For each value of ``by`` the counts of the languages as an array."""
        return seen.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.sum((F.col("best") == i).cast("long")).alias(f"n{i}") for i in range(len(languages))])

    def counts(df: DataFrame, name: str, *by) -> DataFrame:
        return df.select(*by, F.array(*[F.col(f"n{i}").cast("double") for i in range(len(languages))]).alias(name))

    total = seen.groupBy("best").agg(F.count("*").alias("n")).collect()  # one row for each candidate
    size = {r.best: r.n for r in total}
    all_n = sum(size.values())
    overall = [(size.get(i, 0) + SMOOTH) / (all_n + SMOOTH * len(languages)) for i in range(len(languages))]
    base = F.array(*[F.lit(x) for x in overall])
    of_lang = F.array(*[F.lit(float(size.get(i, 0))) for i in range(len(languages))])

    def reliability(by: str) -> DataFrame:
        """log P(value | language), up to a constant of the value."""
        return counts(table(by), "c", by).select(by, F.transform(langs, lambda i: F.log(
            (F.get("c", i) + SMOOTH * F.get(base, i)) / (F.get(of_lang, i) + SMOOTH))).alias(f"log_{by}"))

    site = F.when(F.col("host") != "", F.substring_index("host", ".", -2))
    sites = counts(table("host").withColumn("site", site).groupBy("site").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]), "s", "site")
    sites = sites.select("site", F.transform(langs, lambda i: (F.get("s", i) + STRENGTH * F.get(base, i)) / (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) + STRENGTH)).alias("site_prior"))
    hosts = counts(table("host"), "h", "host").withColumn("site", site).join(sites, "site", "left")
    hosts = hosts.select("host", F.transform(langs, lambda i: F.log(
        (F.get("h", i) + STRENGTH * F.get(F.coalesce("site_prior", base), i)) / (F.aggregate("h", F.lit(0.0), lambda a, x: a + x) + STRENGTH))).alias("log_host"))

    # Deviation of each language at which 'other' is as likely as the language.
    own = seen.withColumn("d", F.element_at("dev", F.col("best") + 1)).filter(F.col("declared") == F.element_at(F.array(*[F.lit(x) for x in languages]), F.col("best") + 1))
    quartiles = {r.best: r.q for r in own.groupBy("best").agg(F.percentile_approx("d", [0.25, 0.5]).alias("q")).collect()}  # one row for each candidate
    middle = [quartiles.get(i, (0.0, 0.0)) for i in range(len(languages))]
    floor = F.array(*[F.lit(float(m - FLOOR * max((m - low) / 0.6745, LEAST_SPREAD))) for low, m in middle])
    scale = F.array(*[F.lit(float(x)) for x in np.sqrt(spread_of(model))])

    nothing = F.array_repeat(F.lit(0.0), len(languages))
    fused = (scored.join(hosts, "host", "left").join(reliability("declared"), "declared", "left").join(reliability("suffix"), "suffix", "left")
             .withColumn("lp", F.transform(langs, lambda i: F.get("ll", i) + F.get(F.coalesce("log_host", F.transform(base, lambda x: F.log(x))), i)
                                           + F.get(F.coalesce("log_declared", nothing), i) + F.get(F.coalesce("log_suffix", nothing), i)))
             .withColumn("top", F.array_max("lp")).withColumn("at", F.array_position("lp", F.col("top")).cast("int") - 1)
             # log-likelihood of 'other' less that of the best language
             .withColumn("other", (F.get(floor, F.col("at")) - F.get("dev", F.col("at"))) * F.get(scale, F.col("at")) * F.sqrt(F.least(F.col("n").cast("double"), F.lit(WEIGHT))))
             .withColumn("confidence", F.when(F.col("n") > 0, 1.0 / (F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))) + F.exp(F.least(F.lit(500.0), F.col("other"))))).otherwise(0.0))
             .withColumn("language", F.when(F.col("n") > 0, F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("lp", F.col("top")).cast("int")))))
    return fused.select(*carried, "language", "confidence", "declared", (F.col("confidence") >= CONFIDENCE).alias("accepted"))


def document_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents: the lang column is the declared language, the source stands for the host, no suffix."""
    return docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages: declared in the html element, suffix and host from the address, text of the article or of the page."""
    from episodeflow.llm.wrapper_extract import host_of

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    body = F.regexp_extract(html, r"(?is)<article\b[^>]*>.*</article>", 0)
    plain = F.regexp_replace(F.regexp_replace(F.when(body != "", body).otherwise(html), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    host = host_of(F.col("url").cast("string"))
    return pages.select(F.col(id_col).alias("id"), plain.alias("text"), F.when(declared != "", declared).alias("declared"),
                        F.when(host.contains("."), F.substring_index(host, ".", -1)).alias("suffix"), F.when(host != "", host).alias("host"))
