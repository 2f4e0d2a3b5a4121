"""Operator 8: lexical retrieval packing.

1. Whole texts become token ids once (``bpe.Merger``), landed as packed 16-bit ids; the same pass
   counts in how many documents each token occurs. These document frequencies over all documents
   are one row a token, so at most the vocabulary's size reaches the driver.
2. Documents are dealt by content to index shards of at most ``SHARD_TOKENS`` tokens (only one row
   can be longer): a tree of centres, fitted on a bounded sample (``PER_SHARD`` documents a shard),
   splits the vectors of BM25 weights by cosine until a cell is half a shard. The sizes of the cells
   are counted on ``COUNTED`` documents a shard and all long ones, cells that follow each other share
   a task, and a cell over the limit (copies, mostly) is dealt on by a hash. Then every document goes
   down the tree, once, to its task.
3. Each task cuts its rows into shards of at most ``SHARD_TOKENS`` tokens (one, mostly), builds the
   inverted index of each (BM25 weights from the global statistics) and packs its documents: a seed document opens a window, all its tokens retrieve unused neighbours,
   best first, which fill the window greedily. The document that does not fit is cut; its rest opens
   the next window as seed.
4. Only the last window of a task is padded: its next shard goes on in the open window.

A document in another shard is never a neighbour. With one shard nothing is missed; with more, the
neighbours that lie on the other side of a cell's border are (``neighbour_recall`` measures them;
figures in the README). A shard's memory is bounded by ``SHARD_TOKENS`` plus its longest document;
sample, tree and cell sizes on the driver grow with the number of shards. Documents without a match
follow in seeded order, so every document is packed whole.

Defined results: a null or empty text is the end id alone; a null id is packed like any other; equal
ids or texts are packed once each row; ties in score go to the earlier document in seeded order; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeflow.llm.bpe import merger
from episodeflow.llm.common import land, passes, ragged
from episodeflow.llm.near_dedup import task_groups
from episodeflow.llm.token_counts import tokenizer_path

WINDOW, END = 2048, 1
SHARD_TOKENS = 6_000_000
#: Centres a node of the tree has at most, documents of the sample for each shard, fitting rounds of a node.
FAN, PER_SHARD, ROUNDS = 32, 32, 5
#: Documents a shard whose cells are counted to deal the cells to tasks; fewer documents are counted all.
COUNTED = 512
#: A document of this part of a shard is long: it is always counted.
LONG = 128
#: Documents of the sample that one node's centres are fitted on.
NODE_SAMPLE = 512
#: Used documents leave a shard's postings when less than this share, and at least so many documents, are left (speed only).
LEFT, LEAST_LEFT = 0.85, 64
#: Neighbours that are sorted at once (speed only).
FIRST = 32
#: BM25 parameters.
K1, B = 1.2, 0.75
_SPAN = 1 << 32


def row_tokens(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and times of each distinct token of each row, in order."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    key = np.sort((rows << 17) | ids)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    return key[new] >> 17, key[new] & 0x1FFFF, times


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``id, ids, n`` of each row (ids as 16-bit words), and rows with ``token_docs`` set: a task's document frequencies."""
    size = 1 << 17

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = merger(path), np.zeros(size, np.int64)
        names = ["id", "ids", "n", "token_docs"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for part, data, offsets in passes(batch, "text"):
                ids, n = table.encode(data, offsets)
                at = np.concatenate([[0], np.cumsum(n)])
                seen += np.bincount(row_tokens(ids.astype(np.int64), at)[1], minlength=size)
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * 2).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array(n), pa.nulls(len(n), pa.binary())], names)
        if kind is not None:
            last = int(seen.nonzero()[0].max(initial=0)) + 1
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([b""]), pa.array([0]), pa.array([seen[:last].astype("<i8").tobytes()])], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, n long, token_docs binary")


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many documents each token occurs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, "<i8")
                if len(x) > len(total):
                    total = np.concatenate([total, np.zeros(len(x) - len(total), np.int64)])
                total[: len(x)] += x
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(total[t])], ["token", "docs"])

    counts = rows.filter("token_docs is not null").select("token_docs").mapInArrow(spread, "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs"))
    out = np.zeros(1 << 17, np.int64)
    for r in counts.collect():  # one row for each token of the vocabulary
        out[r.token] = r.docs
    return out


class Statistics:
    """Document frequencies, number and mean length of all documents."""

    def __init__(self, doc_freq: np.ndarray, n_docs: int, mean_length: float):
        self.idf = np.log1p((n_docs - doc_freq + 0.5) / (doc_freq + 0.5))
        self.mean_length = max(mean_length, 1e-9)

    def weights(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, token and BM25 weight of each distinct token of each row."""
        row, token, times = row_tokens(ids.astype(np.int64), offsets)
        length = np.diff(offsets)[row]
        return row, token, (self.idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean_length))).astype(np.float32)

    def vectors(self, ids: np.ndarray, offsets: np.ndarray) -> Vectors:
        """Unit vectors of the rows' weights."""
        row, token, weight = self.weights(ids, offsets)
        size = np.sqrt(np.bincount(row, weight.astype(np.float64) ** 2, len(offsets) - 1))
        return Vectors(np.searchsorted(row, np.arange(len(offsets))), token, (weight / size[row]).astype(np.float32))


class Vectors:
    """Sparse rows."""

    def __init__(self, at: np.ndarray, token: np.ndarray, weight: np.ndarray):
        self.at, self.token, self.weight = at, token, weight

    def take(self, rows: np.ndarray) -> Vectors:
        n = self.at[rows + 1] - self.at[rows]
        k = ragged(self.at[rows], n)
        return Vectors(np.concatenate([[0], np.cumsum(n)]), self.token[k], self.weight[k])

    def __len__(self) -> int:
        return len(self.at) - 1


class Centres:
    """Centres of one node: its terms in order and, sparse, a weight of each term and centre."""

    def __init__(self, table: np.ndarray, terms: np.ndarray):
        i, j = np.nonzero(table)
        self.terms, self.i, self.j, self.weight, self.n = terms.astype(np.int32), i.astype(np.int32), j.astype(np.int16), table[i, j].astype(np.float32), table.shape[1]

    def nearest(self, rows: Vectors) -> np.ndarray:
        """Centre of the largest cosine for each row, the first one of equals."""
        table = np.zeros((len(self.terms), self.n), np.float32)
        table[self.i, self.j] = self.weight
        place = np.full(1 << 17, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        k = place[rows.token]
        known = np.flatnonzero(k >= 0)  # other tokens weigh nothing here
        k, weight, at = k[known], rows.weight[known, None], np.searchsorted(known, rows.at)
        out = np.zeros(len(rows), np.int64)
        if len(known) * DENSE >= len(rows) * len(self.terms):  # full rows of terms are cheaper
            own, step = np.repeat(np.arange(len(rows)), np.diff(at)), max(1, PASS_TERMS // max(len(self.terms), 1))
            for begin in range(0, len(rows), step):
                a, b = at[begin], at[min(begin + step, len(rows))]
                full = np.zeros((min(step, len(rows) - begin), len(self.terms)), np.float32)
                full[own[a:b] - begin, k[a:b]] = weight[a:b, 0]
                out[begin: begin + step] = (full @ table).argmax(1)
            return out
        begin = 0
        while begin < len(rows):  # about PASS_TOKENS tokens at once
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + PASS_TOKENS, side="right")) - 1)
            a, b = at[begin], at[end]
            own = at[begin:end] - a
            full = np.flatnonzero(np.diff(at[begin: end + 1]))
            if len(full):
                share = table[k[a:b]]
                share *= weight[a:b]
                out[begin + full] = np.add.reduceat(share, own[full], axis=0).argmax(1)
            begin = end
        return out


#: So many that what they gather stays in a core's cache.
PASS_TOKENS = 1 << 13
#: Rows that hold at least one of so many terms are multiplied as full rows, about so many numbers at once.
DENSE, PASS_TERMS = 16, 1 << 18


def fit_centres(rows: Vectors, n: int) -> Centres | None:
    """At most ``n`` centres of the rows by spherical k-means, similar ones next to each other; None if rows do not differ."""
    terms, column = np.unique(rows.token, return_inverse=True)
    x = np.zeros((len(rows), len(terms)), np.float32)
    x[np.repeat(np.arange(len(rows)), np.diff(rows.at)), column] = rows.weight
    centres = np.unique(x[:n], axis=0)
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        centres = np.stack([x[near == k].sum(0) for k in np.unique(near)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    if len(centres) < 2:
        return None
    like, order = centres @ centres.T, [0]
    left = np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, like[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return Centres(centres[order].T, terms)


class Tree:
    """Nodes of centres; a cell is a centre without a node below, numbered from left to right."""

    def __init__(self, sample: Vectors, cells: float):
        """Splits until about ``cells`` cells of equal share would be left."""
        self.nodes: list[Centres] = []
        self.below: list[list[int]] = []  # node of each centre, or -1 - cell
        self.n_cells = 0
        self.root = self._grow(sample, np.arange(len(sample)), len(sample) / max(cells, 1.0))

    def _grow(self, sample: Vectors, rows: np.ndarray, share: float) -> int:
        centres = None
        if len(rows) > max(share, 1):
            some = rows[:: -(-len(rows) // NODE_SAMPLE)]
            centres = fit_centres(sample.take(some), int(np.clip(np.ceil(len(rows) / share), 2, FAN)))
        near = centres.nearest(sample.take(rows)) if centres is not None else np.zeros(0, np.int64)
        if not len(near) or np.bincount(near).max() == len(rows):
            self.n_cells += 1
            return -self.n_cells
        node = len(self.nodes)
        self.nodes.append(centres)
        self.below.append([])
        for k in range(centres.n):
            self.below[node].append(self._grow(sample, rows[near == k], share))
        return node

    def cell(self, rows: Vectors) -> np.ndarray:
        where = np.full(len(rows), self.root, np.int64)
        while (inner := np.unique(where[where >= 0])).size:
            for node in inner.tolist():
                own = np.flatnonzero(where == node)
                where[own] = np.array(self.below[node])[self.nodes[node].nearest(rows.take(own))]
        return -1 - where


def cell_tasks(sizes: dict[int, int], limit: int) -> dict[int, tuple[int, int]]:
    """First task and number of tasks of each cell: cells in order share a task, a cell over the limit has several."""
    tasks, task, held = {}, 0, 0
    for cell in sorted(sizes):
        n = -(-sizes[cell] // limit)
        if held and held + sizes[cell] > limit:
            task, held = task + 1, 0
        tasks[cell] = task, n
        if n > 1:
            task, held = task + n, 0
        else:
            held += sizes[cell]
    return tasks


def row_cells(rows: DataFrame, tree: Tree, statistics: Statistics) -> DataFrame:
    """``rows`` (id, ids, n) with their ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "ids"):
                cell = tree.cell(statistics.vectors(data.view("<u2") if data.flags.aligned else np.frombuffer(data.tobytes(), "<u2"), offsets // 2))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], [*part.schema.names, "cell"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long")


def dealt(rows: DataFrame, statistics: Statistics, n_docs: int, size: int, limit: int) -> tuple[DataFrame, int]:
    """``rows`` (id, ids, n) with their ``task`` by content, and the number of tasks; ``size`` is the sum of n + 1."""
    n_shards = max(1, -(-size // limit))
    if n_shards == 1:
        return rows.withColumn("task", F.lit(0)), 1
    # Copies are one row of the sample; a null id and repeated ids are dealt by their ids of tokens as well.
    mixed = F.xxhash64("id", F.xxhash64("ids"))
    rate = min(1.0, n_shards * PER_SHARD / n_docs)
    sample = rows.filter(F.pmod(F.xxhash64(mixed, F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("ids").distinct().orderBy(F.xxhash64("ids")).collect()
    raw = [bytes(r.ids) for r in sample]
    vectors = statistics.vectors(np.frombuffer(b"".join(raw), "<u2"), np.concatenate([[0], np.cumsum([len(r) // 2 for r in raw], dtype=np.int64)]).astype(np.int64))
    tree = Tree(vectors, 2.0 * size / limit)
    # A cell's size from its long rows and a share of the others: all rows go down the tree once, where they are dealt.
    share = min(1.0, n_shards * COUNTED / n_docs)
    some = (F.col("n") * LONG >= limit) | (F.pmod(F.xxhash64(mixed, F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = F.sum((F.col("n") + 1) / F.when(F.col("n") * LONG >= limit, 1.0).otherwise(share))
    counted = row_cells(rows.filter(some), tree, statistics).groupBy("cell").agg(counts.alias("size")).collect()  # one row for each cell
    sizes = dict.fromkeys(range(tree.n_cells), 1) | {r.cell: max(1, round(r["size"])) for r in counted}
    tasks = cell_tasks(sizes, limit)
    table = rows.sparkSession.createDataFrame([(c, *t) for c, t in tasks.items()], "cell long, first int, parts int")
    out = row_cells(rows, tree, statistics).join(F.broadcast(table), "cell").withColumn("task", (F.col("first") + F.pmod(F.xxhash64(mixed, F.lit(11)), F.col("parts"))).cast("int"))
    return out.drop("cell", "first", "parts"), max(a + n for a, n in tasks.values())


class Shard:
    """Inverted index of one shard's documents (token ids with the end id left out)."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, doc_freq: np.ndarray, n_docs: int, mean_length: float):
        self.n = len(offsets) - 1
        row, token, weight = Statistics(doc_freq, n_docs, mean_length).weights(ids, offsets)
        self.of_doc = np.searchsorted(row, np.arange(self.n + 1))
        self.doc_token = token
        order = np.argsort(token, kind="stable")
        self.posting_doc, self.posting_weight = row[order].astype(np.int32), weight[order]
        self.terms, self.term_at = np.unique(token[order], return_index=True)
        self.term_at = np.append(self.term_at, len(token))
        # Postings of terms in at least one of eight documents are also rows over all documents.
        common = np.flatnonzero(np.diff(self.term_at) * 8 >= self.n)
        self.common = np.full(len(self.terms), -1)
        self.common[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for r, k in enumerate(common.tolist()):
            a, b = self.term_at[k], self.term_at[k + 1]
            self.rows[r, self.posting_doc[a:b]] = self.posting_weight[a:b]
        self.docs = np.arange(self.n)  # document of each number in the postings

    def _leave(self, left: np.ndarray) -> None:
        """Takes the documents that are used out of the postings; the others keep their order."""
        place, keep = np.cumsum(left) - 1, left[self.posting_doc]
        self.term_at = np.concatenate([[0], np.cumsum(keep)])[self.term_at]
        self.posting_doc, self.posting_weight = place[self.posting_doc[keep]].astype(np.int32), self.posting_weight[keep]
        self.rows = np.compress(left, self.rows, axis=1)
        self.docs = self.docs[left]

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``doc``, best BM25 score first; a document once used is not asked for again."""
        return np.concatenate([np.zeros(0, np.int64), *self.best(doc, unused)])

    def best(self, doc: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """``neighbours`` in two parts: the first few, mostly enough for a window, are sorted alone."""
        left = unused[self.docs]
        if LEAST_LEFT <= (n := int(left.sum())) < LEFT * len(left):
            self._leave(left)
            left = np.ones(n, bool)
        k = np.searchsorted(self.terms, self.doc_token[self.of_doc[doc]: self.of_doc[doc + 1]])
        rare = k[self.common[k] < 0]
        at = ragged(self.term_at[rare], self.term_at[rare + 1] - self.term_at[rare])
        score = self.rows[self.common[k[self.common[k] >= 0]]].sum(0) + np.bincount(self.posting_doc[at], self.posting_weight[at], len(self.docs))
        found = np.flatnonzero((score > 0) & left)
        docs, score = self.docs[found], score[found]
        first = score >= (np.partition(score, len(score) - FIRST)[len(score) - FIRST] if len(score) > FIRST else 0)
        for part in (first, ~first):
            yield docs[part][np.argsort(-score[part], kind="stable")]


def shard_rows(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` tokens; a longer row is a range of its own."""
    at, begin = np.concatenate([[0], np.cumsum(lengths)]), 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield begin, end
        begin = end


def pack(lengths: np.ndarray, shard: Shard, window: int, sequence: int = 0, offset: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset): every document whole, cut only at window ends."""
    unused = np.ones(len(lengths), bool)
    following = 0
    rest: tuple[int, int] | None = None  # document and start of its unpacked part
    while True:
        if rest is None:
            while following < len(lengths) and not unused[following]:
                following += 1
            if following == len(lengths):
                return
            rest = following, 0
            unused[following] = False
        seed = rest[0]
        queue: Iterator[int] | None = None
        while True:  # fill the window, then go on with the document that was cut
            doc, start = rest
            n = min(int(lengths[doc]) - start, window - offset)
            yield doc, start, n, sequence, offset
            offset += n
            rest = (doc, start + n) if start + n < lengths[doc] else None
            if offset == window:
                sequence, offset = sequence + 1, 0
                break
            if queue is None:
                queue = (d for part in shard.best(seed, unused) for d in part.tolist())
            doc = next(queue, None)
            if doc is None:
                break  # no neighbour left: the next document in order goes on in the open window
            unused[doc] = False
            rest = doc, 0


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece."""
    rows = land(tokenized(docs, id_col, text_col, path or tokenizer_path()), "token-ids")
    n_docs, n_tokens = rows.filter("token_docs is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    doc_freq = document_frequencies(rows)
    mean_length = n_tokens / max(n_docs, 1)
    kind = rows.schema["id"].dataType.simpleString()
    limit = SHARD_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in task_groups(batches):
            n = t["n"].to_numpy()
            ids = np.frombuffer(b"".join(t["ids"].to_pylist()), "<u2")
            at = np.concatenate([[0], np.cumsum(n)])
            pieces: list[tuple[int, int, int, int, int]] = []
            for begin, end in shard_rows(n + 1, limit):
                shard = Shard(ids[at[begin]: at[end]], at[begin: end + 1] - at[begin], doc_freq, n_docs, mean_length)
                filled = pieces[-1][4] + pieces[-1][2] if pieces else 0
                place = (pieces[-1][3] + filled // window, filled % window) if pieces else (0, 0)
                pieces += [(begin + d, *piece) for d, *piece in pack(n[begin:end] + 1, shard, window, *place)]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            crc = []
            for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist()):
                own = ids[at[d] + s: min(at[d] + s + k, at[d + 1])].astype("<u4")
                raw = own.tobytes()
                crc.append(zlib.crc32(raw if len(own) == k else raw + END.to_bytes(4, "little")))
            yield pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc] + 1),
                 pa.array(sequence + t["task"][0].as_py() * _SPAN), pa.array(offset)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    shards, n_shards = dealt(rows.filter("token_docs is null").select("id", "ids", "n"), Statistics(doc_freq, n_docs, mean_length), n_docs, n_tokens + n_docs, limit)
    shards = shards.withColumn("seed", F.xxhash64("id", F.lit(3))).select("task", "seed", "id", "ids", "n")
    out = (shards.repartitionById(n_shards, "task").sortWithinPartitions("task", "seed", "id").select("task", "id", "ids", "n")
           .mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
    return out.withColumnRenamed("id", id_col)


def neighbour_recall(task: np.ndarray, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, k: int = 10) -> float:
    """Share of the ``k`` best BM25 neighbours over all documents (row, token, weight) that lie in the query's own task."""
    row, token, weight = vectors
    at = np.searchsorted(row, np.arange(len(task) + 1))
    hits = []
    for q in queries.tolist():
        asked = np.zeros(1 << 17, bool)
        asked[token[at[q]: at[q + 1]]] = True
        score = np.bincount(row, np.where(asked[token], weight, 0), len(task))
        score[q] = -1
        hits.append(np.mean(task[np.argsort(-score, kind="stable")[:k]] == task[q]))
    return float(np.mean(hits))
