"""Files that hold one JSON array or object, read by many tasks each.

Such a file has no line breaks to cut at, so it is cut at byte ranges in two passes. The first counts, for
every range by itself, its unescaped quotes and its change of depth, once for a start outside a text and
once for a start inside one; running sums over a file's ranges (one small row each) then say whether a
range starts inside a text and how deep. The second pass cuts the elements. An element belongs to the range
that holds the bracket or comma before it, and its task reads on past the range until it ends. A file of
one range needs the second pass only.

A backslash escapes the next byte only inside a text, where all that matters is whether the run of
backslashes before a quote is odd; the bytes before a range are looked at for that.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodeflow.session import ship_package
from episodeflow.sources.details import BATCH_BYTES, listed_files
from episodeflow.sources.named_files import file_system

#: Bytes of a file that one range holds.
RANGE_BYTES = 32 << 20
#: Bytes looked at in one vectorised step.
BLOCK = 1 << 20

_DEEPER = np.zeros(256, np.int8)
_DEEPER[[ord("["), ord("{")]] = 1
_DEEPER[[ord("]"), ord("}")]] = -1
_MARK = _DEEPER != 0
_MARK[ord(",")] = True

COUNTED = "uri string, start long, quotes long, outside long, inside long"
CUT = "uri string, at long, element string, problem string"


def _open(uri: str):
    fs, path = file_system("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)
    return fs.open_input_file(path)


def _first_byte(f) -> bytes:
    """The first byte of a file that is no white space (nor a mark of byte order)."""
    f.seek(0)
    head = f.read(64).removeprefix(b"\xef\xbb\xbf").lstrip()
    while not head and (more := f.read(BLOCK)):
        head = more.lstrip()
    return head[:1]


def _run_before(f, start: int) -> int:
    """Length of the run of backslashes that ends before ``start``."""
    run, step = 0, 256
    while start > 0:
        low = max(0, start - step)
        f.seek(low)
        part = f.read(start - low)
        tail = len(part) - len(part.rstrip(b"\\"))
        run += tail
        if tail < len(part):
            break
        start, step = low, BLOCK
    return run


def _blocks(f, start: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """From ``start`` to the end of the file: (offset, bytes, unescaped quotes, brackets and commas) of each block."""
    run = _run_before(f, start)
    f.seek(start)
    while data := f.read(BLOCK):
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == 34)
        if len(quotes):
            if run or (b == 92).any():
                last = np.maximum.accumulate(np.where(b != 92, np.arange(len(b)), -1))
                before = np.where(quotes > 0, last[quotes - 1], -1)
                length = quotes - 1 - before + np.where(before < 0, run, 0)
                quotes = quotes[length % 2 == 0]
        tail = len(data) - len(data.rstrip(b"\\"))
        run = tail + (run if tail == len(data) else 0)
        yield start, data, quotes, np.flatnonzero(_MARK[b])
        start += len(data)


def _count(uri: str, start: int, end: int) -> tuple[str, int, int, int, int]:
    n = outside = inside = 0
    with _open(uri) as f:
        for at, data, quotes, marks in _blocks(f, start):
            if at + len(data) > end:  # the last block of the range
                quotes, marks = quotes[quotes < end - at], marks[marks < end - at]
            change = _DEEPER[np.frombuffer(data, np.uint8)[marks]]
            even = (np.searchsorted(quotes, marks) + n) % 2 == 0
            outside += int(change[even].sum())
            inside += int(change[~even].sum())
            n += len(quotes)
            if at + len(data) >= end:
                break
    return uri, start, n, outside, inside


def _cut(uri: str, start: int, end: int, in_text: int, depth: int, opening: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(offset, element or None, problem or None) of the elements whose bracket or comma lies in the range."""
    with _open(uri) as f:
        if _first_byte(f) != opening.encode():
            if start == 0:
                yield 0, None, f"does not begin with {opening}"
            return
        held: list[bytes] = []
        since = -1  # offset of the open element, -1: none
        closed = False
        for at, data, quotes, marks in _blocks(f, start):
            b = np.frombuffer(data, np.uint8)
            marks = marks[(np.searchsorted(quotes, marks) + in_text) % 2 == 0]
            in_text = (in_text + len(quotes)) % 2
            change = _DEEPER[b[marks]].astype(np.int64)
            after = depth + np.cumsum(change)
            # The bracket that opens the file, commas at depth 1, the bracket that closes it.
            edges = ((after == 1) & (change == 0)) | ((after == 1) & (change == 1)) | ((after == 0) & (change == -1))
            depth = int(after[-1]) if len(after) else depth
            begin = 0
            for i, closing in zip(marks[edges].tolist(), (change[edges] == -1).tolist()):
                if since >= 0:
                    held.append(data[begin:i])
                    yield from _element(since, held)
                    held, since = [], -1
                if closing or at + i >= end:
                    closed = True
                    break
                since, begin = at + i + 1, i + 1
            if closed or (since < 0 and at + len(data) >= end):
                return
            if since >= 0:
                held.append(data[begin:])
        if since >= 0:
            yield since, None, "cut short"


def _element(at: int, held: list[bytes]) -> Iterator[tuple[int, str | None, str | None]]:
    raw = b"".join(held).strip()
    if raw:  # an empty array, or a comma before its end, holds no element
        try:
            yield at, raw.decode(), None
        except UnicodeDecodeError:
            yield at, None, "no UTF-8"


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["uri", "start", "quotes", "outside", "inside"]
    for batch in batches:
        rows = [_count(*r.values()) for r in batch.select(["uri", "start", "end"]).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def _cutter(opening: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("uri", pa.string()), ("at", pa.int64()), ("element", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for at, element, problem in _cut(r["uri"], r["start"], r["end"], r["in_text"], r["depth"], opening):
                    rows.append({"uri": r["uri"], "at": at, "element": element, "problem": problem})
                    size += len(element or "") + 64
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of the listed files: ``uri, start, end, in_text, depth`` (state at the start)."""
    cut = files.select("uri", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    cut = cut.withColumn("end", F.least(F.col("start") + size, "length"))
    whole = cut.where(F.col("length") <= size).select("uri", "start", "end", F.lit(0).alias("in_text"), F.lit(0).cast("long").alias("depth"))
    long = cut.where(F.col("length") > size).select("uri", "start", "end")
    counted = spread(long, size).mapInArrow(_counter, COUNTED)
    # One small row a range: a file's rows are its bytes / ``size``.
    before = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = counted.withColumn("in_text", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    told = told.withColumn("change", F.when(F.col("in_text") == 0, F.col("outside")).otherwise(F.col("inside")))
    told = told.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    ends = told.withColumn("end", F.col("start") + size)  # a range may say more than the file holds
    return whole.unionByName(ends.select("uri", "start", "end", "in_text", "depth"))


def spread(rows: DataFrame, size: int) -> DataFrame:
    """Ranges dealt to tasks one by one, as many tasks as the session shuffles to."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(n, F.xxhash64("uri", "start"))


def elements(spark: SparkSession, path: str | list[str], opening: str = "[", glob: str = "*.json", size: int = RANGE_BYTES) -> DataFrame:
    """Top-level elements of every file: ``uri``, ``at`` (byte offset, so their order), ``element``, ``problem``.

    Of an array (``opening`` ``[``) an element is a value; of an object (``{``) it is ``"key": value``. A
    file that does not begin with ``opening`` gives one row with a problem, a file that is cut short its
    whole elements and a problem for the last. A comma before the closing bracket is allowed; what follows
    that bracket is not looked at. Files of no bytes hold no element.
    """
    ship_package(spark)
    return spread(ranges(listed_files(spark, path, glob), size), size).mapInArrow(_cutter(opening), CUT)


def _with_rejects(cut: DataFrame, schema: T.DataType, text: F.Column) -> tuple[DataFrame, DataFrame]:
    parsed = cut.withColumn("value", F.when(F.col("problem").isNull(), F.from_json(text, schema)))
    why = F.coalesce("problem", F.when(F.col("value").isNull(), F.lit("not as the schema says")))
    judged = parsed.withColumn("problem", why)
    file = F.regexp_replace("uri", "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/").alias("file")
    return (judged.where("problem IS NULL").select(file, "at", "value"),
            judged.where("problem IS NOT NULL").select(file, "at", "element", "problem"))


def scan_array(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str = "*.json",
               size: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of array files (``file``, ``at``, fields of ``schema``) and rejects (``file, at, element, problem``)."""
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    cut = elements(spark, path, "[", glob, size)
    value = F.from_json("element", bad, {"columnNameOfCorruptRecord": "_bad"})
    cut = cut.withColumn("problem", F.coalesce("problem", F.when(value["_bad"].isNotNull() | ~F.col("element").startswith("{"), F.lit("not as the schema says"))))
    good, rejects = _with_rejects(cut, schema, F.col("element"))
    return good.select("file", "at", "value.*"), rejects


def scan_map(spark: SparkSession, path: str | list[str], glob: str = "*.json", size: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows ``file, id, state`` of object files ``{id: text}`` and rejects; of a repeated id the last counts."""
    cut = elements(spark, path, "{", glob, size)
    good, rejects = _with_rejects(cut, T.MapType(T.StringType(), T.StringType()), F.concat(F.lit("{"), "element", F.lit("}")))
    rows = good.select("file", "at", F.explode("value").alias("id", "state"))
    return rows.groupBy("file", "id").agg(F.max_by("state", "at").alias("state")), rejects
