"""File sources of the episode model.

Every reader takes an explicit schema (no inference pass over the data),
keeps the file key from ``_metadata``, and returns a reject table for rows
whose key or shape is unusable instead of failing the job.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.functions.pytext import py_variant

STEP = T.StructType([
    T.StructField("observation", T.StringType()),
    T.StructField("candidate_actions", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_corrected", T.BooleanType()),
    T.StructField("original_observation", T.StringType()),
    T.StructField("original_reason", T.StringType()),
    T.StructField("original_action", T.StringType()),
    T.StructField("corrected_reason", T.StringType()),
    T.StructField("corrected_action", T.StringType()),
    T.StructField("timestep", T.LongType()),
])
EPISODE = T.StructType([
    T.StructField("env_idx", T.LongType()),
    T.StructField("gamefile", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("trajectory", T.ArrayType(STEP)),
])
# As read from a file: a step's fields may be of any JSON type (a score may be true, an
# observation a list of rows, candidate actions an empty text).
EPISODE_FILE = T.StructType([T.StructField(f.name, T.ArrayType(T.VariantType()) if f.name == "trajectory" else f.dataType)
                             for f in EPISODE.fields])
SUMMARY = T.StructType([
    T.StructField("env_idx", T.LongType()),
    T.StructField("gamefile", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("num_actions", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])
DEMO = T.StructType([
    T.StructField("states", T.ArrayType(T.StringType())),
    T.StructField("available_actions", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("action_idxs", T.ArrayType(T.IntegerType())),
])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SFT_ROW = T.StructType([T.StructField("prompt", T.ArrayType(MESSAGE)),
                        T.StructField("response", T.ArrayType(MESSAGE))])
PREF_ROW = T.StructType([T.StructField("prompt", T.ArrayType(MESSAGE)),
                         T.StructField("chosen", T.ArrayType(MESSAGE)),
                         T.StructField("rejected", T.ArrayType(MESSAGE))])
DETAIL = T.StructType([T.StructField("info", T.StructType([T.StructField("verbose", T.StructType([
    T.StructField(n, T.DoubleType()) for n in ("r_type", "r_att", "r_price", "r_option")]))]))])


#: Scan partitions that one task takes.
SCAN_PARTITIONS = 64


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, "^(.*)\\.[^.]*$", 1)


def decoded_path(path: Column) -> Column:
    """A file path as the user wrote it: ``_metadata.file_path`` is URI-encoded (``+`` is not an escape there)."""
    plain = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    return plain


def _field(v: Column, f: T.StructField) -> Column:
    """One step field from its JSON value; a value of another type is null, except as noted."""
    at = f"$.{f.name}"
    kind = f.dataType.simpleString()
    if f.name == "score":  # true counts 1, false 0
        return F.coalesce(F.try_variant_get(v, at, "double"), F.try_variant_get(v, at, "boolean").cast("double"))
    if f.name in ("observation", "original_observation"):  # a text, or any value as Python text
        return py_variant(F.try_variant_get(v, at, "variant"))
    return F.try_variant_get(v, at, kind)


def typed_steps(trajectory: Column) -> Column:
    """Array of variant steps -> array of ``STEP`` structs."""
    return F.transform(trajectory, lambda v: F.struct(*[_field(v, f).alias(f.name) for f in STEP.fields]))


def packed_scan(files: DataFrame) -> DataFrame:
    """A scan of many small files in fewer tasks: Spark packs files as if each were large, a few to a scan partition."""
    n = files.rdd.getNumPartitions()
    return files.coalesce(max(n // SCAN_PARTITIONS, min(n, files.sparkSession.sparkContext.defaultParallelism), 1))


def scan_episode_dir(spark: SparkSession, path: str, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every ``*.json`` file of a folder is one episode, named by its file stem.

    Returns (episodes with ``episode_name`` and, for a numeric stem,
    ``episode_id``; rejects). Unreadable files (all fields null) and files
    without ``trajectory`` (F3) are rejects; ``numbered`` (jobs that sort by
    the number, O1) also rejects other stems. An empty trajectory is an
    episode without steps.
    """
    raw = (spark.read.schema(EPISODE_FILE).option("multiLine", True).option("pathGlobFilter", "*.json")
                .option("mode", "PERMISSIVE").json(path)
                .withColumn("file_name", F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))))
    eps = (packed_scan(raw).withColumn("episode_name", _stem(F.col("file_name")))
              .withColumn("episode_id", F.col("episode_name").try_cast("long")))
    why = F.when(F.col("trajectory").isNull(), F.lit("no trajectory"))
    if numbered:
        why = F.when(F.col("episode_id").isNull(), F.lit("non-numeric file stem")).otherwise(why)
    # Judged by the steps as read: a task plans the expressions of typed steps anew wherever they stand, in a filter too.
    judged = eps.withColumn("reject_reason", why).withColumn("trajectory", typed_steps(F.col("trajectory")))
    return (judged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            judged.where(F.col("reject_reason").isNotNull()))


def episode_steps(eps: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row per step (``posexplode`` numbers steps from 0)."""
    keep = [c for c in eps.columns if c not in ("trajectory",)]
    # For the plain form Spark filters by the size of the typed steps first, and plans their expressions for each scan partition.
    steps = eps.select(*keep, F.posexplode_outer("trajectory").alias("step", "s")).where(F.col("step").isNotNull())
    return steps.select(*keep, F.col("step").cast("int").alias("step"), "s.*")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = DEMO) -> DataFrame:
    """JSON lines (one record per line; splittable)."""
    return spark.read.schema(schema).json(path)


_CELLS = 12


def _by_header(raw: DataFrame) -> DataFrame:
    """CSV rows (text cells and their file) -> ``SUMMARY`` columns, bound by each file's own header.

    Families differ in their columns, and one scan may hold many runs; a
    column that a file lacks is null.
    """
    cells = F.array(*[F.trim(F.col(f"c{i}")) for i in range(_CELLS)])
    rows = raw.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"))
    is_header = F.array_contains("cells", "env_idx") & F.array_contains("cells", "model_id")
    headers = rows.where(is_header).groupBy("path").agg(F.min("cells").alias("header"))
    at = lambda f: F.get("cells", F.array_position("header", F.lit(f.name)).cast("int") - 1).try_cast(f.dataType)
    return (rows.where(~F.coalesce(is_header, F.lit(False))).join(headers, "path")
                .select("path", *[at(f).alias(f.name) for f in SUMMARY.fields]))


def _raw_csv(spark: SparkSession) -> "object":
    return spark.read.schema(", ".join(f"c{i} string" for i in range(_CELLS)))


def scan_summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: summary CSV with header, of any family (columns are bound by name)."""
    return _by_header(_raw_csv(spark).csv(path)).drop("path")


def discover_summaries(spark: SparkSession, root: str, name: str = "summary.csv") -> DataFrame:
    """S4 (S3 for many runs): every ``summary.csv`` below ``root``, with its folder as ``run_dir``."""
    raw = _raw_csv(spark).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
    return (_by_header(raw).withColumn("run_dir", F.regexp_replace(decoded_path(F.col("path")), "/[^/]*$", "")).drop("path"))


def scan_state_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file ``{id: text}`` -> rows (id, state).

    One file is one task here; ``json_ranges.scan_map`` reads a large one in many.
    """
    txt = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return txt.select(F.explode(m).alias("id", "state"))


def scan_training_set(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = SFT_ROW,
                      split: str | None = None) -> DataFrame:
    """A JSON array file per split -> one row per element.

    ``path`` is a file, or with ``split`` a data folder or a list of them
    (``<folder>/<split>.json``); a list also adds the folder as ``data_dir``.
    One array file is one task here; ``json_ranges.scan_array`` reads a large one in many.
    """
    if split is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    dirs = [path] if isinstance(path, str) else list(path)
    rows = spark.read.schema(schema).option("multiLine", True).json([f"{d.rstrip('/')}/{split}.json" for d in dirs])
    if isinstance(path, str):
        return rows
    return rows.withColumn("data_dir", F.regexp_replace(decoded_path(F.col("_metadata.file_path")), "/[^/]*$", ""))


def scan_iterations(spark: SparkSession, root: str, max_iter: int, schema: T.StructType = SFT_ROW,
                    fmt: str = "json", split: str = "train") -> DataFrame:
    """One split of all ``iter<k>`` data sets below ``root`` with k <= max_iter, one read.

    Folders written by ``sinks.write_rows(partition_by=['iter'])`` are
    ``iter=<k>``; then the predicate prunes partitions before any file is
    opened (and a ``split`` column selects the split, if there is one).
    Plain ``iter<k>/<split>.json`` files are matched by name.
    """
    if fmt == "parquet":
        df = spark.read.parquet(root).where(F.col("iter") <= max_iter)
        return df.where(F.col("split") == split) if "split" in df.columns else df
    df = (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
               .option("pathGlobFilter", f"{split}.json").json(root))
    it = F.regexp_extract(F.col("_metadata.file_path"), "/iter=?(\\d+)/[^/]*$", 1).try_cast("int")
    return df.withColumn("iter", it).where(F.col("iter") <= max_iter)


SCORES = ("r_type", "r_att", "r_price", "r_option")


def scan_eval_details(spark: SparkSession, root: str) -> DataFrame:
    """Detail files ``<run>/<model>/<env_idx>.json`` of any number of runs below ``root``.

    The model id may contain '/', so a path alone does not say where the run
    ends: ``detail_path`` is the key, and ``detail_key`` gives it for a
    summary row (J4). ``model_id`` is the path between ``root`` and the file,
    right when ``root`` is one run.
    """
    df = (spark.read.schema(DETAIL).option("multiLine", True).option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.json").json(root))
    path = decoded_path(F.col("_metadata.file_path"))
    plain_root = os.path.normpath("/" + root.split(":", 1)[-1].lstrip("/")) if "://" in root or root.startswith("file:") else root.rstrip("/")
    rel = F.substring_index(path, plain_root + "/", -1)
    return df.select(
        path.alias("detail_path"),
        F.regexp_extract(rel, "^(.*)/[^/]*$", 1).alias("model_id"),
        _stem(F.substring_index(path, "/", -1)).try_cast("long").alias("env_idx"),
        *[F.coalesce(F.col(f"info.verbose.{n}"), F.lit(0.0)).alias(n) for n in SCORES])


def detail_key(run_dir: Column, model_id: Column, env_idx: Column) -> Column:
    """The path of a summary row's detail file."""
    return F.concat(run_dir, F.lit("/"), model_id, F.lit("/"), env_idx.cast("string"), F.lit(".json"))
