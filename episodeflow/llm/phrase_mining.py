"""Operator 13: phrase collocations by SON partitioning.

1. The bytes of each language are summed. A shard is a run of texts of one task of at most
   ``SHARD_BYTES`` bytes (or one longer text).
2. Each shard is mined completely, with numpy inside a task, phrases of 1 word, then of 2, up to
   ``longest``: all phrases whose two parts of one word less are candidates of the level before, with at least the support lowered by the shard's share of the language's bytes, rounded up (1 in
   languages of more than a shard's bytes). A phrase with the full support reaches that in at least one shard. Phrases are 64-bit hashes of
   (lang, words) here; equal hashes of different phrases can only add candidates.
3. The union over the shards: a candidate is a phrase whose local counts, plus the most that the
   shards which did not report it can hold, reach the support. Where the lowered support is 1, all
   phrases are handed on and this bound does the pruning.
4. All candidates are counted exactly over all texts, by their words. Tasks know candidates, here and
   from level to level, by a bit table (two bits each, at most ``FILTER_BITS`` bits, so of bounded
   size); what it lets through wrongly is counted and falls at the support.
5. Scores, the rule on longer candidates and the ranks are joins and grouped aggregates.

Counts of a shard are merged before the shuffle, so a phrase or language in a third of all rows
is one row a shard.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows and ids
count once each row; ties follow the contract (score, count, phrase); an empty table gives an empty
result; a language without a phrase that qualifies has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodeflow.llm.common import land, parts, passes, ragged, text_bytes
from episodeflow.llm.shingles import mix

SHARD_BYTES = 4 << 20
#: Bytes of words hashed at once.
HASH_BYTES = 1 << 19
SECTIONS = 64
#: Bits of the candidates' table: 16 for each candidate, at most these.
FILTER_BITS = 1 << 28
#: Parts of a language that are ranked by themselves first.
SALTS = 256
#: Rows of an Arrow batch that a task hands on.
OUT_ROWS = 1 << 18
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_PLACE = np.uint64(0xA0761D6478BD642F)

#: The bytes that end a piece, and those between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2


def byte_hashes(data: np.ndarray, lengths: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hash of each of the adjoining byte ranges of ``data`` (an empty range has one too)."""
    out = lengths.astype(np.uint64) * seed
    full = np.flatnonzero(lengths)
    n = lengths[full]
    ends = np.cumsum(n)
    powers = np.cumprod(np.full(int(n.max(initial=0)), seed, np.uint64))
    row = 0
    while row < len(full):
        begin = int(ends[row] - n[row])
        stop = max(row + 1, int(np.searchsorted(ends, begin + HASH_BYTES, side="right")))
        starts = ends[row:stop] - n[row:stop] - begin
        inside = np.arange(int(ends[stop - 1]) - begin) - np.repeat(starts, n[row:stop])
        out[full[row:stop]] += np.add.reduceat((data[begin: ends[stop - 1]].astype(np.uint64) + np.uint64(1)) * powers[inside], starts)
        row = stop
    return mix(out)


class Shard:
    """Words of a run of texts, and its phrases as hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        solid = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.begin = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))) if len(data) else np.zeros(0, np.int64)
        end = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) if len(data) else np.zeros(0, np.int64)
        self.length = end + 1 - self.begin
        self.row = np.searchsorted(offsets, self.begin, side="right") - 1
        self.data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        self._solid = self.data[solid]
        ends = np.cumsum(kind == 2, dtype=np.int32)[self.begin]
        #: Does the next word go on in the same piece?
        self.joined = np.zeros(len(self.begin), bool)
        if len(self.begin):
            self.joined[:-1] = (ends[1:] == ends[:-1]) & (self.row[1:] == self.row[:-1])

    def phrases(self, lang: np.ndarray, longest: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: first words and hashes (with the row's ``lang`` hash) of all phrases."""
        word = byte_hashes(self._solid, self.length, _SEEDS[seed])
        at = np.arange(len(word))
        acc = lang[self.row] + word
        for k in range(1, longest + 1):
            if k > 1:
                go = self.joined[at + k - 2]
                at = at[go]
                acc = acc[go] * _PLACE + word[at + k - 1]
            yield k, at, mix(acc + np.uint64(k))

    def text(self, first: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of phrases of ``k`` words, joined by spaces."""
        words = ragged(first, k)
        n = self.length[words]
        last = np.zeros(len(words), bool)
        last[np.cumsum(k) - 1] = True
        room = n + ~last
        at = np.cumsum(room) - room
        out = np.full(int(room.sum()), 32, np.uint8)
        out[ragged(at, n)] = self.data[ragged(self.begin[words], n)]
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(room, np.cumsum(k) - k))]) if len(k) else np.zeros(1, np.int64)
        return out, offsets


def lang_hashes(col: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(col)
    return byte_hashes(data, np.diff(offsets), _SEEDS[1])


def lowered_support(support: int, own: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``support`` times the share ``own / whole``, rounded up, at least 1."""
    return np.maximum(1, -(-support * own // np.maximum(whole, 1)))


def mined(rows: DataFrame, support: int, k: int, before: Table | None) -> DataFrame:
    """``h, v, spare`` of each shard's frequent phrases of ``k`` words: v is the count less what an unreported phrase can have there.

    ``before`` holds the candidates of k - 1 words. ``spare`` is the most that all shards together can
    hold of a phrase they do not report. It is 0 in a language of more bytes than a shard, whose
    support is lowered to 1 in every shard at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text", SHARD_BYTES):
                shard = Shard(data, offsets)
                lang, total = lang_hashes(part.column(0)), part.column(2).to_numpy(zero_copy_only=False)
                few = total <= SHARD_BYTES
                need = np.ones(len(lang), np.int64)
                if few.any():
                    _, code = np.unique(lang, return_inverse=True)
                    own = np.bincount(code, np.diff(offsets)).astype(np.int64)[code]
                    need = np.where(few, lowered_support(support, own, total), 1)
                ok = np.ones(len(shard.begin) + 1, bool)
                for n, at, h in shard.phrases(lang, k):
                    if n == k - 1:
                        ok[:] = False
                        ok[at] = before.has(h)
                    elif n == k and k > 1:
                        go = ok[at] & ok[at + 1]
                        at, h = at[go], h[go]
                if few.any():
                    h, first, n = np.unique(h, return_index=True, return_counts=True)
                    row = shard.row[at[first]]
                    least, spare = need[row], np.where(few[row], support - 1, 0)
                    keep = n >= least
                    h, v, spare = h[keep], (n - least + 1)[keep], spare[keep]
                else:
                    h, v = np.unique(h, return_counts=True)
                    spare = np.zeros(len(h), np.int64)
                for a in range(0, len(h), OUT_ROWS):
                    b = a + OUT_ROWS
                    yield pa.RecordBatch.from_arrays([pa.array(h[a:b].view(np.int64)), pa.array(v[a:b].astype(np.int32)), pa.array(spare[a:b].astype(np.int32))], ["h", "v", "spare"])

    return rows.mapInArrow(run, "h long, v int, spare int")


class Table:
    """Bits of candidate hashes: two for each, in the section of its highest bits."""

    def __init__(self, bits: np.ndarray, section_bits: int):
        self.bits, self.section_bits = bits, section_bits

    @staticmethod
    def places(h: np.ndarray, section_bits: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64(section_bits - 1)
        return (h & low).astype(np.int64), ((h >> np.uint64(29)) & low).astype(np.int64)

    @classmethod
    def of(cls, candidates: DataFrame, n: int) -> Table:
        size = 1 << 13
        while size * SECTIONS < min(16 * n, FILTER_BITS):
            size *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                section = (h >> np.uint64(58)).astype(np.int64)
                for s in np.unique(section).tolist():
                    bits = held.setdefault(s, np.zeros(size, bool))
                    for place in cls.places(h[section == s], size):
                        bits[place] = True
            for s, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(bits).tobytes()])], ["section", "bits"])

        found = candidates.repartition(SECTIONS, F.shiftrightunsigned("h", 58)).mapInArrow(run, "section long, bits binary").collect()  # at most SECTIONS rows
        out = np.zeros(SECTIONS * size // 8, np.uint8)
        for r in found:
            out[r.section * size // 8: (r.section + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
        return cls(out, size)

    def has(self, h: np.ndarray) -> np.ndarray:
        base = (h >> np.uint64(58)).astype(np.int64) * self.section_bits
        out = np.ones(len(h), bool)
        for place in self.places(h, self.section_bits):
            at = base + place
            out &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out


def runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs (h, g) lie together, and where each run of them starts."""
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    if (~new[1:] & (g[order][1:] != g[order][:-1])).any():  # one hash, two phrases
        order = np.lexsort((g, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
    return order, np.flatnonzero(new)


def counted(rows: DataFrame, table: Table, longest: int) -> DataFrame:
    """``lang, k, phrase, n`` of each shard: counts of the phrases that the table holds; k = 0: all words."""
    names = ["lang", "k", "phrase", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text", SHARD_BYTES):
                shard = Shard(data, offsets)
                col = part.column(0)
                lang = lang_hashes(col)
                words = np.bincount(shard.row, minlength=len(col))
                per = pa.table({"lang": col, "n": pa.array(words)}).group_by("lang").aggregate([("n", "sum")])
                m = per.num_rows
                yield pa.RecordBatch.from_arrays([per["lang"].combine_chunks(), pa.array([0] * m, pa.int32()), pa.array([""] * m), per["n_sum"].combine_chunks()], names)
                for (k, at, h), (_, _, g) in zip(shard.phrases(lang, longest), shard.phrases(lang, longest, 1)):
                    keep = table.has(h)
                    at, h, g = at[keep], h[keep], g[keep]
                    if not len(at):
                        continue
                    order, starts = runs(h, g)
                    n, first = np.diff(np.append(starts, len(order))), at[order[starts]]
                    for a in range(0, len(first), OUT_ROWS):
                        some = first[a: a + OUT_ROWS]
                        raw, off = shard.text(some, np.full(len(some), k))
                        phrase = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                        yield pa.RecordBatch.from_arrays([col.take(pa.array(shard.row[some])), pa.array(np.full(len(some), k, np.int32)), phrase, pa.array(n[a: a + OUT_ROWS])], names)

    return rows.mapInArrow(run, "lang string, k int, phrase string, n long")


def frequent(docs: DataFrame, text_col: str, lang_col: str, support: int, longest: int) -> DataFrame:
    """``lang, k, phrase, n``: exact counts of all phrases with the support, and of all words (k = 0); landed."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    totals = land(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total")), "lang-bytes", 1)
    sized = rows.join(totals, "lang").select("lang", "text", "total")
    levels: list[DataFrame] = []
    table = None
    for k in range(1, longest + 1):
        union = mined(sized, support, k, table).groupBy("h").agg(F.sum("v").alias("v"), F.max("spare").alias("spare"))
        levels.append(land(union.filter(F.col("v") + F.col("spare") >= support).select("h"), f"phrase-candidates-{k}"))
        table = Table.of(levels[-1], levels[-1].count())
    found = reduce(DataFrame.unionByName, levels)
    table = Table.of(found, found.count())
    exact = counted(rows, table, longest).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return land(exact.filter(f"k = 0 or n >= {int(support)}"), "phrases")


_WIDE = "cast({} as decimal(15,0))"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 10, longest: int = 3, inside: int = 50, ranks: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``ranks`` phrases of 2 to ``longest`` words.

    A phrase inside a longer candidate that has at least ``inside`` per cent of its count is dropped.
    Products of counts are decimals of 38 digits, exact for counts below 10 ** 15.
    """
    exact = frequent(docs, text_col, lang_col, support, longest)
    counts = exact.filter("k > 0")
    cuts = (counts.filter("k > 1").withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
            .select("lang", "phrase", "k", F.col("n").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"),
                    F.expr("substring_index(phrase, ' ', cut - k)").alias("tail")))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
            .join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"]))
    score = F.expr(f"({_WIDE.format(1000000)} * {_WIDE.format('a')} * {_WIDE.format('a')}) div ({_WIDE.format('l')} * {_WIDE.format('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    within = (counts.filter("k > 2").withColumn("words", F.split("phrase", " ", -1))
              .select("lang", "n", F.explode(F.expr(
                  "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    left = (best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    # The best of each of SALTS parts of a language, then the best of those.
    some = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= ranks)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= ranks)
    words = exact.filter("k = 0").select("lang", F.col("n").alias("n"))
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, h.n AS l, t.n AS r, 1000000::HUGEINT * c.a * c.a // (h.n::HUGEINT * t.n) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(n) AS n FROM (
    SELECT lang, n, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase FROM f WHERE k = 3
    UNION ALL SELECT lang, n, array_to_string(string_split(phrase, ' ')[2:3], ' ') FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.n IS NULL OR 100 * o.n < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
