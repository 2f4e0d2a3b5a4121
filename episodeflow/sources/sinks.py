"""Sinks of the episode model.

Writes are partitioned Parquet (or JSON for export) done by the executors;
nothing is coalesced into one file by default, so a write never funnels
the data set through one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.session import ship_package
from episodeflow.sources.named_files import NamedFiles


def write_rows(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
               mode: str = "overwrite") -> None:
    """Partitioned write (e.g. by family, iter, split)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)


def write_splits(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """train/test rows, one folder per split."""
    write_rows(rows, path, ["split"], fmt)


def write_named(rows: DataFrame, path: str, name: str, text: str, mode: str = "overwrite", folders: bool = False) -> None:
    """``text`` of each row as a file called ``name`` (see ``named_files``); rows are dealt by name.

    With ``folders`` a name may be a path below ``path``.
    """
    spark = rows.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    rows.select(F.col(name).alias("name"), F.col(text).alias("text")).repartition("name").write.format("named_files").option("folders", str(folders).lower()).mode(mode).save(path)


def write_episodes(eps: DataFrame, path: str, name: str = "episode_name", mode: str = "overwrite", pretty: bool = False) -> None:
    """One JSON file ``<name>.json`` an episode, all its other columns as fields (nulls too)."""
    fields = F.struct(*[c for c in eps.columns if c != name])
    text = F.to_json(fields, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    write_named(eps.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("name"), text.alias("text")), path, "name", "text", mode)


def state_last_wins(rows: DataFrame, key: str, text: str, seq: Sequence[str]) -> DataFrame:
    """Keyed state map; on repeated ids the last write (highest ``seq``) wins.

    With a single primitive ``seq`` column this is a hash aggregate; several
    columns are compared as a struct (a sort aggregate).
    """
    order = F.col(seq[0]) if len(seq) == 1 else F.struct(*seq)
    return rows.groupBy(key).agg(F.max_by(F.col(text), order).alias(text))


def append_summary(rows: DataFrame, path: str) -> None:
    """Append new summary rows (no read-and-rewrite of what is there)."""
    rows.write.mode("append").parquet(path)


def iso_text(ts: Column) -> Column:
    """``datetime.isoformat()``: microseconds only when not zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def encode_values(df: DataFrame) -> DataFrame:
    """Decimals -> double, timestamps -> ISO text, other types unchanged.

    Types the encoder does not know (binary, map, interval) are an error, as
    in the reference.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_text(c).alias(f.name))
        elif isinstance(t, T.DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(t, (T.BinaryType, T.MapType)) or type(t).__name__.endswith("IntervalType"):
            raise TypeError(f"Object of type {t.simpleString()} is not JSON serializable")
        else:
            out.append(c)
    return df.select(*out)


def to_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text: strings as they are, structured values as JSON."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")
