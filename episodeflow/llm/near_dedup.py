"""Operator 3: near-duplicate removal with SetSketch registers.

1. One pass makes a sketch of each document's 5-word shingle set: ``REGISTERS`` registers,
   register i holding floor(1 - log_b(min_i)) of the smallest exponentially spaced hash of the
   set, truncated to 16 bits. The registers of a union are the maxima of the registers.
2. Documents with equal word sequences form a class; only its representative goes on.
3. Four registers are a band. Representatives that share a band are mates. Each is first
   linked with its most popular mate (one pair each), and components are found.
4. Mates that still lie in different components are compared in blocks inside tasks: the
   joint maximum-likelihood similarity of two sketches drops hopeless pairs, the others are
   confirmed on their full shingle sets, until both lie in one component.
5. Components of all confirmed links give the result.

A pair at the threshold of 0.85 misses all 20 bands with probability 4e-7, and the likelihood
filter keeps pairs down to six standard errors below the threshold. No partner or bucket cap:
a large bucket is cut into blocks, and members of its largest component are only compared
with the others.

Defined results: a null or blank text has 0 shingles and stays alone; a null id takes no part
and gets a null component; ids are taken as unique, a repeated id is judged row by row; ties
do not exist (components are sets); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeflow.llm.common import land, parts, passes
from episodeflow.llm.components import components
from episodeflow.llm.shingles import distinct_in_rows, shingle_hashes

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and truncation of the registers.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard errors below the threshold that the likelihood filter still lets through.
MARGIN = 6.0
#: Representatives of one bucket that a task compares with as many others.
BLOCK = 192
_MULTIPLIERS = (np.random.default_rng(20240229).integers(0, 2**62, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of each row's hashes; repeats do not matter. Empty rows: zeros."""
    n = len(offsets) - 1
    low = np.full((n, REGISTERS), np.uint64(2**64 - 1))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    # Rows are taken in runs whose hashes fit the cache.
    row = 0
    while row < len(full):
        stop = int(np.searchsorted(offsets[full], offsets[full[row]] + 60_000, side="left"))
        part = full[row: max(stop, row + 1)]
        begin, end = offsets[part[0]], offsets[part[-1] + 1]
        chunk, at = values[begin:end], offsets[part] - begin
        for i in range(REGISTERS):
            low[part, i] = np.minimum.reduceat(chunk * _MULTIPLIERS[i], at)
        row += len(part)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE if n else low.astype(np.float64)
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(smallest) / np.log(BASE))
    out = np.clip(np.nan_to_num(k, nan=0.0, posinf=TOP, neginf=0.0), 0, TOP).astype(np.uint16)
    out[offsets[1:] == offsets[:-1]] = 0
    return out


def joint_similarity(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from counts of greater and smaller registers.

    With u, v the shares of the two cardinalities, a register of U is greater with probability
    p(u - vJ) and smaller with p(v - uJ), p(x) = -log_b(1 - x (b - 1) / b).
    """
    u = n_u / (n_u + n_v)
    v = 1.0 - u
    same = REGISTERS - more - less
    c = (BASE - 1.0) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, None) * c) / np.log(BASE)

    def score(j):
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1.0 - a - b, 1e-12, None))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(28):  # the likelihood is concave
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = score(a) < score(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def likely(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, goal: float) -> np.ndarray:
    """Is the maximum-likelihood similarity at least ``goal``?

    The likelihood is concave, so it is if its slope at ``goal`` is not negative.
    """
    u = n_u / (n_u + n_v)
    v = 1.0 - u
    c = (BASE - 1.0) / BASE
    a, b = np.clip(u - v * goal, 1e-12, None), np.clip(v - u * goal, 1e-12, None)
    pa_, pb = -np.log1p(-a * c) / np.log(BASE), -np.log1p(-b * c) / np.log(BASE)
    da, db = c / (np.log(BASE) * (1 - a * c)), c / (np.log(BASE) * (1 - b * c))
    slope = (REGISTERS - more - less) * (v * da + u * db) / np.clip(1 - pa_ - pb, 1e-12, None) - more * v * da / pa_ - less * u * db / pb
    return (slope >= 0) & (np.minimum(u / v, v / u) >= goal)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, c1, c2, sig``: distinct shingles, hashes of the word sequence, registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in passes(batch, "text"):
                values, at, c1, c2 = shingle_hashes(data, offsets)
                distinct, where = distinct_in_rows(values, at)
                sig = registers(distinct, where)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(where)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                     pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "n", "c1", "c2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, c1 long, c2 long, sig binary")


def shared_counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of both shingle sets and of their intersection, of columns text_a and text_b."""
    sets = []
    for column in ("text_a", "text_b"):
        (_, data, offsets), = passes(batch.select([column]), column, 1 << 62)
        sets.append(distinct_in_rows(*shingle_hashes(data, offsets)[:2]))
    (va, oa), (vb, ob) = sets
    n = np.diff(oa), np.diff(ob)
    rows = np.concatenate([np.repeat(np.arange(len(k)), k) for k in n])
    values = np.concatenate([va, vb])
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    twice = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    return n[0], n[1], np.bincount(r[1:][twice], minlength=batch.num_rows)


def confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` whose full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in passes(batch, "text_a", 1 << 20):
                na, nb, both = shared_counts(part)
                yield part.select(["a", "b"]).filter(pa.array((den * both >= num * (na + nb - both)) & (na > 0)))

    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def task_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal ``task``, which lie next to each other, as one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column(batch.schema.names.index("task")).to_numpy(zero_copy_only=False)
        if not len(task):
            continue
        cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
        edges = [0, *cuts.tolist(), len(task)]
        for begin, end in zip(edges[:-1], edges[1:]):
            if held and held[0].column("task")[0].as_py() != task[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def promising(t: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a task worth confirming, those with most equal registers first.

    A pair counts in the first band it shares, if its components differ, at least one side is
    outside the bucket's main component, and size and likelihood allow the threshold.
    """
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    n, comp = t["n"].to_numpy(), t["comp"].to_numpy()
    band, block, main = t["band"][0].as_py(), t["block"].to_numpy(), t["main"].to_numpy()
    ids = t["rep"].to_numpy()
    one = bool((block == block[0]).all() and (main == main[0]).all())
    side = (block != block[0]) | (main != main[0])
    left, right = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(~side), np.flatnonzero(side))
    goal = num / den
    least = goal - MARGIN * np.sqrt(goal * (1 - goal) / REGISTERS)
    found = []
    step = max(1, 40_000 // max(len(right), 1))
    for at in range(0, len(left), step):
        x, y = left[at: at + step, None], right[None, :]
        ok = (comp[x] != comp[y]) & (ids[x] != ids[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        if one:
            ok &= x < y
        i, j = np.nonzero(ok)
        i, j = i + at, j
        i, j = left[i], right[j]
        if not len(i):
            continue
        equal = sig[i] == sig[j]
        first = equal.reshape(len(i), BANDS, ROWS).all(-1).argmax(-1) == band
        i, j, equal = i[first], j[first], equal[first]
        same = equal.sum(-1)
        more = (sig[i] > sig[j]).sum(-1)
        good = likely(more, REGISTERS - same - more, n[i].astype(float), n[j].astype(float), least)
        found.append((i[good], j[good], same[good]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    a, b, same = (np.concatenate(x) for x in zip(*found))
    best = np.argsort(-same, kind="stable")
    return a[best], b[best]


def _needed(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in task_groups(batches):
            a, b = promising(t, num, den)
            if len(a):
                yield from t.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()
    return run


def _confirm_blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in task_groups(batches):
            a, b = promising(t, num, den)
            if not len(a):
                continue
            sets = []  # of the task's rows; one pass of texts at a time
            for batch in t.select(["text"]).to_batches():
                for _, data, offsets in passes(batch, "text"):
                    values, at = distinct_in_rows(*shingle_hashes(data, offsets)[:2])
                    sets += [values[i:j] for i, j in zip(at[:-1], at[1:])]
            comp, ids = t["comp"].to_pylist(), t["rep"].to_pylist()
            parent = {c: c for c in comp}

            def root(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = []
            for i, j in zip(a.tolist(), b.tolist()):
                p, q = root(comp[i]), root(comp[j])
                if p == q:
                    continue
                x, y = sets[i], sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    parent[p] = q
                    links.append((ids[i], ids[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similar: tuple[int, int] = (85, 100)) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of each row; linked from ``similar[0] / similar[1]`` on."""
    num, den = similar
    sketch = land(sketches(docs, id_col, text_col), "sketches")
    n_docs = sketch.count()
    reps = land(sketch.filter("n > 0 and id is not null").groupBy("c1", "c2")
                .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes", parts(n_docs, 25_000))

    # Mates: representatives that share a band with another one.
    bands = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select(
        "rep", "band", F.expr(f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})").alias("key"))
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    mates = land(bands.join(sizes, ["band", "key"]), "mates", parts(n_docs, 15_000))
    fame = mates.groupBy("rep").agg(F.sum("size").alias("fame"))
    known = mates.join(fame, "rep")
    leaders = known.groupBy("band", "key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("neg"))).alias("top"))
    stars = (mates.join(leaders, ["band", "key"]).filter("rep <> -top.neg").groupBy("rep").agg(F.max("top").alias("top"))
             .select((-F.col("top.neg")).alias("a"), F.col("rep").alias("b")))
    texts = land(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
                 .join(fame.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), "mate-texts", parts(n_docs, 10_000))  # one plan at every size
    links = land(confirmed(stars, texts, num, den), "star-links", parts(n_docs, 10_000))
    comp = components(links)

    # Buckets that still hold several components, in blocks against blocks.
    rows = (mates.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
            .select("rep", "band", "key", F.coalesce("component", "rep").alias("comp")))
    counts = rows.groupBy("band", "key", "comp").agg(F.count("*").alias("k"))
    split = counts.groupBy("band", "key").agg(F.count("*").alias("comps"), F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("top")).filter("comps > 1")
    rows = (rows.join(split, ["band", "key"]).join(reps.select("rep", "n", "sig"), "rep")
            .withColumn("main", (F.col("comp") == F.col("top.comp")) & (F.col("top.k") > 1))
            .withColumn("mains", F.when(F.col("top.k") > 1, F.ceil(F.col("top.k") / BLOCK)).otherwise(0).cast("int"))
            .withColumn("others", F.ceil((F.col("size") - F.when(F.col("top.k") > 1, F.col("top.k")).otherwise(0)) / BLOCK).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")))
    whole = F.col("size") <= BLOCK  # a small bucket is one task
    meets = F.when(whole, F.array(F.lit("all"))).when(F.col("main"), F.expr("transform(sequence(0, others - 1), o -> concat(o, 'm', block))")).otherwise(F.concat(
        F.expr("transform(sequence(0, others - 1), o -> concat(least(o, block), 'o', greatest(o, block)))"),
        F.expr("transform(if(mains > 0, sequence(0, mains - 1), array()), m -> concat(block, 'm', m))")))
    rows = (rows.withColumn("meet", F.explode(meets))
            .select(F.concat_ws("|", F.col("band").cast("string"), F.hex("key"), "meet").alias("task"), "band", "rep", "comp", "n", "sig",
                    F.when(whole, 0).otherwise(F.col("block")).alias("block"), F.when(whole, False).otherwise(F.col("main")).alias("main")))
    kind = "task string, band int, rep long, comp long, n long, sig binary, block int, main boolean"
    needed = land(rows.repartition("task").sortWithinPartitions("task").mapInArrow(_needed(num, den), kind), "needed")
    more = (needed.join(texts.withColumnRenamed("id", "rep"), "rep").repartition("task").sortWithinPartitions("task")
            .mapInArrow(_confirm_blocks(num, den), "a long, b long"))
    comp = components(links.unionByName(more), most=links.count() + needed.count())

    found = reps.select("c1", "c2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    lone = sketch.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    linked = sketch.filter("n > 0 and id is not null").join(found, ["c1", "c2"]).select("id", "n", "component")
    return linked.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                                           F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
