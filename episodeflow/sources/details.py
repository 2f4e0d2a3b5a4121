"""S8 and J4 on files, in two phases: which detail files exist, then the contents of those that a summary row names.

Run folders hold far more files than a report needs (models that are not compared, logs, older episodes).
The first phase lists them from file metadata alone (``binaryFile`` without its content column, so no file
is opened) and joins the paths with the summary rows. The second opens the matched files only, dealt to
tasks by their bytes. A file that two summary rows name is opened once.
"""

from __future__ import annotations

import uuid
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.session import scratch_path, ship_package
from episodeflow.sources.files import DETAIL, SCORES, detail_key, packed_scan
from episodeflow.sources.named_files import file_system

#: Bytes of detail files a task reads, and what opening a file counts.
TASK_BYTES = 64 << 20
OPEN_BYTES = 64 << 10
#: Bytes of text in one Arrow batch of a task.
BATCH_BYTES = 8 << 20

_TEXTS = pa.schema([("uri", pa.string()), ("text", pa.string())])


def listed_files(spark: SparkSession, root: str | Sequence[str], glob: str = "*.json") -> DataFrame:
    """Files below ``root`` from metadata alone: ``detail_path`` (plain), ``uri``, ``length``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    return packed_scan(raw.select(plain.alias("detail_path"), F.col("path").alias("uri"), "length"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the files of a task; null for a file that is gone or is no UTF-8."""
    uris: list[str] = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = file_system(uri if "://" in uri or not uri.startswith("file:") else "/" + uri[5:].lstrip("/"))
            try:
                with fs.open_input_stream(path) as f:
                    text = f.read().decode("utf-8-sig")
            except (FileNotFoundError, UnicodeDecodeError):
                text = None
            uris.append(uri)
            texts.append(text)
            held += len(text or "")
            if held >= BATCH_BYTES:
                yield pa.record_batch([uris, texts], schema=_TEXTS)
                uris, texts, held = [], [], 0
    yield pa.record_batch([pa.array(uris, pa.string()), pa.array(texts, pa.string())], schema=_TEXTS)


def wanted_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The listed ``files`` whose path is in ``wanted``.

    Not a semi-join: Spark moves one below the packed scan partitions, and each of them then counts a table of paths.
    """
    return files.join(wanted.select("detail_path").distinct(), "detail_path")


def matched_texts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(detail_path, text) of the listed ``files`` whose path is in ``wanted``; only these are opened."""
    spark = files.sparkSession
    path = scratch_path(spark, f"matched/{uuid.uuid4().hex}")
    wanted_files(wanted, files).write.parquet(path)
    matched = spark.read.schema(files.schema).parquet(path)
    total = matched.agg(F.sum(F.col("length") + OPEN_BYTES)).first()[0] or 0
    ship_package(spark)
    dealt = matched.select("uri").repartition(int(total // TASK_BYTES) + 1, F.xxhash64("uri"))
    return dealt.mapInArrow(_read, "uri string, text string").join(matched, "uri").select("detail_path", "text")


def detail_scan(sm: DataFrame, root: str | Sequence[str], run_dir: str = "run_dir") -> DataFrame:
    """Summary rows with the scores of their detail file ``<run>/<model>/<env_idx>.json`` below ``root``.

    ``detail_status`` is ``read``, ``missing`` (no such file, or one of no bytes, which Spark does not
    list; also a null run, model or index) or ``unreadable`` (no UTF-8, no JSON object, or a score that is no number). A score that is missing,
    null or unreadable counts 0; every summary row is returned once. Repeated rows share a file. Model
    ids may hold '/'. Columns of ``sm`` named like the new ones are an error.
    """
    clash = {*SCORES, "detail_path", "detail_status"} & set(sm.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are already there")
    spark = sm.sparkSession
    keyed = sm.withColumn("detail_path", detail_key(F.col(run_dir), F.col("model_id"), F.col("env_idx")))
    texts = matched_texts(keyed.where(F.col("detail_path").isNotNull()), listed_files(spark, root))
    schema = T.StructType([*DETAIL.fields, T.StructField("_bad", T.StringType())])
    parsed = texts.withColumn("d", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_bad"}))
    object_like = F.ltrim(F.translate("text", "\t\r\n", "   ")).startswith("{")
    good = F.coalesce(object_like, F.lit(False)) & F.col("d").isNotNull() & F.col("d._bad").isNull()
    scores = parsed.select("detail_path", F.when(good, F.lit("read")).otherwise(F.lit("unreadable")).alias("detail_status"),
                           *[F.when(good, F.col(f"d.info.verbose.{n}")).alias(n) for n in SCORES])
    out = keyed.join(scores, "detail_path", "left")
    return out.select(*sm.columns, F.coalesce("detail_status", F.lit("missing")).alias("detail_status"),
                      *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in SCORES])
