"""Operator 7: sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard with the largest
``weight / -ln(u)``. Only the key and the shards decide, so one more shard takes records only into
itself, in proportion to its weight. Native: hashes and the choice are column expressions.

Slots number a shard's records from 0 without gaps, in the order of the key's hash. They come from
counts of (shard, bucket) cells, ``BUCKETS`` hash ranges a shard: an offset for each cell (at most
shards * BUCKETS rows) plus a row number inside the cell, so no window holds a whole shard.

Defined results: a null key counts as the empty key; a null text has no bytes (size 8, checksum 0);
repeated rows get a slot each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodeflow.llm.common import land

#: Hash ranges a shard, as leading hexadecimal digits of the key's hash.
BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS
#: Hexadecimal digits of a hash that make the number u.
U_DIGITS = 13


def pull(key: Column, shard: Column, weight: Column) -> Column:
    """How strongly a shard pulls a key."""
    digits = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary")), 1, U_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**U_DIGITS)
    return weight / -F.log(u)


def strongest(key: Column, weights: list[float]) -> Column:
    """Struct (pull, -shard) of the shard that a key goes to; ties to the smaller shard."""
    of = F.array(*[F.lit(float(w)) for w in weights])
    pulls = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(pull(key, s, F.get(of, s)).alias("pull"), (-s).alias("neg")))
    return F.array_max(pulls)


def shards(docs: DataFrame, weights: list[float], grown_weight: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` (with one more shard of ``grown_weight``, else null)."""
    data = F.coalesce(F.encode(F.col(text_col).cast("string"), "UTF-8"), F.lit(b""))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumn("best", strongest(key, weights)).withColumn("shard", -F.col("best.neg"))
    if grown_weight is None:
        grown = F.lit(None).cast("int")
    else:
        grown = F.when(pull(key, F.lit(len(weights)), F.lit(float(grown_weight))) > F.col("best.pull"), len(weights)).otherwise(F.col("shard"))
    rows = land(rows.withColumn("grown_shard", grown).withColumn("hash", F.md5(key.cast("binary"))).drop("best"), "shards")

    cell = F.substring("hash", 1, BUCKET_DIGITS)
    cells = rows.groupBy("shard", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "cell").orderBy("hash", "id", "text_crc32", "size")
    placed = rows.withColumn("cell", cell).withColumn("rank", F.row_number().over(order))
    return placed.join(F.broadcast(cells), ["shard", "cell"]).select(  # at most shards * BUCKETS rows
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")


N_SHARDS = 24
SQL = f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
lut AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
bytes AS (SELECT r, doc_id, key, octet_length(b) + 8 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT) AS x FROM d),
s AS (SELECT r, doc_id, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda a, v: xor(a >> 8, t[1 + (xor(a, v) & 255)])), 4294967295) AS text_crc32 FROM bytes, lut),
p AS (SELECT r, n, 1.0::DOUBLE / -ln((('0x' || substr(md5(key || ':' || n), 1, {U_DIGITS}))::BIGINT::DOUBLE + 0.5) / {float(16**U_DIGITS)}) AS pull FROM d, range({N_SHARDS + 1}) t(n)),
g AS (SELECT r, arg_max(n, pull) FILTER (n < {N_SHARDS}) AS shard, arg_max(n, pull) AS grown_shard FROM p GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, text_crc32, size) - 1 AS slot,
  grown_shard::INT AS grown_shard FROM s JOIN g USING (r)
"""
