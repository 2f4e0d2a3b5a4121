"""A stored map of states, updated by key without rewriting what a run does not touch.

The map is a Parquet folder with one partition ``bucket=<n>`` for each hash bucket of the key. A run
reduces its rows to the last one of a key, reads only the buckets in which those keys fall, and replaces
these buckets. The last row is the one with the highest ``seq`` whichever run brought it, so runs may
come in any order, be repeated, or bring old rows again: the map is that of one fold over all rows.

A run works in two steps. Its merged buckets are first written next to the map (``<path>-runs/<run>``),
then they replace the map's buckets by dynamic partition overwrite, and the run is marked as applied. A run
that is called again goes on where it ended: an applied one does nothing, one that had its buckets
written only replaces them again, which mends a bucket that was lost half-way. One run writes at a time,
and a run that failed is called again before the next; a run that finds another one unfinished is an error.

Null keys are one key. A null state is a state like any other. A null in ``seq`` comes before all values;
of rows with equal ``seq`` the greater state wins (null is the least), then the greater run id.
"""

from __future__ import annotations

import re
from typing import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeflow.sources.named_files import file_system

#: Hash buckets of a new map; a bucket is what a run that touches it rewrites, in one task.
BUCKETS = 64


def _exists(path: str) -> bool:
    fs, plain = file_system(path)
    return fs.get_file_info(plain).type != pafs.FileType.NotFound


def _mark(path: str, text: str = "") -> None:
    fs, plain = file_system(path)
    fs.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(plain) as f:
        f.write(text.encode())


def _bucket_count(runs: str, asked: int) -> int:
    """The number of buckets the map was begun with; it never changes."""
    note = f"{runs}/_buckets"
    if not _exists(note):
        _mark(note, str(asked))
        return asked
    fs, plain = file_system(note)
    with fs.open_input_stream(plain) as f:
        return int(f.read())


def _unfinished(runs: str, run: str) -> list[str]:
    fs, plain = file_system(runs)
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(plain, allow_not_found=True))]
    done = {n[len("_applied-"):] for n in names if n.startswith("_applied-")}
    return sorted(n for n in names if not n.startswith("_") and n not in done and n != run)


def read_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The map as it is: the columns of ``schema`` (key, state, seq, run)."""
    fs, plain = file_system(path)
    fs.create_dir(plain, recursive=True)
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def upsert_states(rows: DataFrame, path: str, run: str, key: str, text: str, seq: Sequence[str], buckets: int = BUCKETS) -> int:
    """Bring ``rows`` into the map at ``path`` as the run ``run``; returns the number of buckets rewritten.

    ``run`` is made of letters, digits, '.' and '-'. A hot key is reduced before the shuffle; in the map keys
    are unique, so buckets are even.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.\-]*", run):
        raise ValueError(f"run id {run!r}")
    spark = rows.sparkSession
    runs = f"{path.rstrip('/')}-runs"
    if _exists(f"{runs}/_applied-{run}"):
        return 0
    if other := _unfinished(runs, run):
        raise ValueError(f"runs {other} are not applied yet: call them again first")
    n = _bucket_count(runs, buckets)
    fields = [key, *seq, text, "run"]
    last = F.max(F.struct(*seq, text, "run")).alias("w")
    kept = [F.col(f"w.`{c}`").alias(c) for c in fields[1:]]
    staged = f"{runs}/{run}"
    layout = rows.select(key, *seq, text, F.lit(run).alias("run")).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout)
    if not _exists(f"{staged}/_SUCCESS"):
        new = rows.select(key, *seq, text).withColumn("run", F.lit(run)).groupBy(key).agg(last).select(key, *kept)
        new = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most n numbers
        old = read_states(spark, path, ddl).where(F.col("bucket").isin(touched) if touched else F.lit(False))
        both = old.select(*fields, "bucket").unionByName(new.select(*fields, "bucket"))
        merged = both.groupBy("bucket", key).agg(last).select(key, *kept, "bucket")
        merged.repartition(min(n, max(len(touched), 1)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    ready = spark.read.schema(f"{ddl}, bucket int").parquet(staged)
    fs, plain = file_system(staged)
    count = sum(i.base_name.startswith("bucket=") for i in fs.get_file_info(pafs.FileSelector(plain)))
    (ready.repartition(min(n, max(count, 1)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("bucket").parquet(path))
    _mark(f"{runs}/_applied-{run}")
    fs.delete_dir(plain)  # the buckets of this run are in the map now
    return count
