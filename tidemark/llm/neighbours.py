"""Most similar vectors for every vector, by collision counting.

Each table sorts all vectors by a key of sign bits, in which near vectors share
a long prefix; the sorted array is cut into ranges that lie on different
executors. Around each vector a window opens in the array. Within it, collisions
are counted over all sign bits of that table, KEY_BITS in the sort key and
MORE_BITS besides: two vectors collide in a bit with probability 1 - angle / pi.
Each table has bits of its own, so a pair that misses the collision threshold in
one can reach it in another. Tables and threshold follow from the least cosine
asked for. Vectors that reach the threshold are verified with the exact cosine.

Windows expand by virtual rehashing: where a window is full of collisions, its
vector goes into the next round with twice the radius, which in a sorted array
of bit keys is one bit less in common, without a new array. A window that is
still full in the last round lies in a group of so many near vectors that these
are searched exactly, block by block.

Windows begin bounded by rank, not by distance: in 96 dimensions a window wide
enough to hold near vectors of one projection alone holds about a third of all
vectors, so counting over whole projections is quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Bits of a table's sort key, below the table's number, and bits that are only counted.
KEY_BITS, MORE_BITS = 54, 64
#: A window reaches so many places to either side at first, and at most.
REACH, WIDEST = 24, 192
#: Neighbouring places that link full windows to groups; vectors in a block of a group.
LINK, BLOCK = 2, 2048
#: Tables are as many as give a pair of the cosine asked for the recall wanted.
DESIGN_COSINE, DESIGN_RECALL = 0.92, 0.99
#: Share of the pairs within reach that a table's collision threshold lets through.
KEPT = 0.99


def tables_for(n: int, reach: int = REACH, cosine: float = DESIGN_COSINE, recall: float = DESIGN_RECALL) -> int:
    """Tables needed for n vectors: in one, a pair is within reach if it shares
    the first log2(n / 2 reach) bits, each of which it does with probability
    1 - angle / pi, and then passes the threshold. Grows as n**0.2 at 0.92, as
    n**0.28 at 0.85."""
    bits = max(1.0, math.log2(max(2.0, n / (2 * reach))))
    hit = KEPT * (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def threshold_for(n: int, reach: int = REACH, cosine: float = DESIGN_COSINE) -> int:
    """The most collisions that KEPT of the pairs of this cosine have that are
    within reach, so share the first bits; of the others they share each with
    probability 1 - angle / pi."""
    shared = round(max(1.0, math.log2(max(2.0, n / (2 * reach)))))
    p, free = 1 - math.acos(cosine) / math.pi, KEY_BITS + MORE_BITS - shared
    below, c = 0.0, 0
    while (below := below + math.comb(free, c) * p**c * (1 - p) ** (free - c)) <= 1 - KEPT:
        c += 1
    return shared + c


def usable(v: Column, dim: int) -> Column:
    """dim elements, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return _unit64(x).astype(np.float32)


def _first(row: np.ndarray, name: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest of every row; of equal ones the first by name."""
    order = np.lexsort((name.astype(str), -np.round(cos, 9), row))
    row, name, cos = row[order], name[order], cos[order]
    start = np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], np.arange(len(row)), 0)) if len(row) else row
    keep = np.arange(len(row)) - start < k
    return row[keep], name[keep], cos[keep]


def _keys(batches: Iterator[pa.RecordBatch], dim: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(key, more, id) per vector and table: the table's number above the first
    sign bits, and the other sign bits."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, dim, KEY_BITS + MORE_BITS), np.float32)
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for lo in range(0, len(ids), 4096):
            x = _unit(_matrix(batch.column("v").slice(lo, 4096), dim))
            for t in range(tables):
                bits = np.packbits(x @ planes[t] > 0, axis=1)
                bits = np.pad(bits, ((0, 0), (0, 16 - bits.shape[1]))).view(">u8").astype(np.uint64)
                rest = np.uint64(64 - KEY_BITS)
                key = (bits[:, 0] >> rest).view(np.int64) + (np.int64(t) << KEY_BITS)
                more = (bits[:, 0] << np.uint64(KEY_BITS) | bits[:, 1] >> rest).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(more), pa.array(ids[lo : lo + len(x)])], ["key", "more", "id"])


def _collide(batches: Iterator[pa.RecordBatch], reach: int, threshold: int, widest: int = WIDEST) -> Iterator[pa.RecordBatch]:
    """Pairs of one sorted range that collide often enough, within the window of
    one of them in one table. Windows of radius r are full if r // 2 of their
    places collide; these double their radius, from reach on. (a, a) marks a
    window that is full at widest. Of pairs whose windows are both so only those
    at most LINK places apart come out, as dense() looks at all others.

    The first and last reach entries of the range come out too, with part (the
    number of the range) and place, for _across()."""
    part = TaskContext.get().partitionId()
    nothing = lambda n, t: pa.nulls(n, t)

    def edge(rows: tuple, at: np.ndarray, place: int) -> pa.RecordBatch:
        key, more, ids = (x[at] for x in rows)
        cols = [pa.array(ids), nothing(len(at), pa.int64()), pa.array(key), pa.array(more), pa.array(np.full(len(at), part, np.int32)), pa.array(place + at)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "more", "part", "place"])

    def pairs(rows: tuple, lo: int, hi: int) -> pa.RecordBatch:
        """Pairs whose first place lies in lo .. hi."""
        key, more, ids = rows
        table, n = key >> KEY_BITS, len(ids)
        around, hits = np.zeros(n, np.int16), []
        open_, radius, done = np.ones(n, bool), min(reach, widest), 0
        while True:
            for d in range(done + 1, min(radius, n - 1) + 1):
                i = np.flatnonzero(open_[: n - d] | open_[d:]) if done else slice(0, n - d)
                j = i + d if done else slice(d, n)
                apart = np.bitwise_count((key[i] ^ key[j]).view(np.uint64)) + np.bitwise_count((more[i] ^ more[j]).view(np.uint64))
                hit = np.flatnonzero((apart <= KEY_BITS + MORE_BITS - threshold) & (table[i] == table[j]))
                hit = i[hit] if done else hit
                around[hit] += 1
                around[hit + d] += 1
                hits.append((d, hit[(hit >= lo) & (hit < hi)]))
            full = open_ & (around >= max(1, radius // 2))
            if radius >= widest or not full.any():
                break
            open_, done, radius = full, radius, min(2 * radius, widest)
        marked = ids[lo:hi][full[lo:hi]]
        a, b = [marked], [marked]
        for d, hit in hits:
            if d > LINK:
                hit = hit[~(full[hit] & full[hit + d])]
            a.append(ids[hit]), b.append(ids[hit + d])
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        cols = [pa.array(pair[:, 0]), pa.array(pair[:, 1]), nothing(len(pair), pa.int64()), nothing(len(pair), pa.int64()), nothing(len(pair), pa.int32()), nothing(len(pair), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "more", "part", "place"])

    rows, lo, gone, headed = None, 0, 0, 0
    for batch in batches:
        new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "more", "id"))
        rows = new if rows is None else tuple(np.concatenate(x) for x in zip(rows, new))
        if headed < reach:  # nothing has been dropped yet
            upto = min(reach, len(rows[0]))
            yield edge(rows, np.arange(headed, upto), 0)
            headed = upto
        hi = len(rows[0]) - 2 * widest  # both windows of a pair have to be known
        if hi > lo + widest:
            yield pairs(rows, lo, hi)
            rows, lo, gone = tuple(x[hi - widest :] for x in rows), widest, gone + hi - widest
    if rows is not None:
        yield pairs(rows, lo, len(rows[0]))
        n = len(rows[0])
        yield edge(rows, np.arange(max(n - reach, headed - gone, 0), n), gone)


def _across(batches: Iterator[pa.RecordBatch], reach: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Pairs that collide often enough and lie within reach of each other on both
    sides of a range's edge, from the edges of all ranges in order. A range of
    fewer than 2 * reach entries is here as a whole, so none is too short."""
    rows = None
    for batch in batches:
        new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "more", "part", "a"))
        old = 0 if rows is None else len(rows[0])
        rows = new if rows is None else tuple(np.concatenate(x) for x in zip(rows, new))
        key, more, part, ids = rows
        a, b = [], []
        for d in range(1, min(reach, len(ids) - 1) + 1):
            start = max(0, old - d)  # pairs before have been looked at
            x, y = slice(start, len(ids) - d), slice(start + d, len(ids))
            apart = np.bitwise_count((key[x] ^ key[y]).view(np.uint64)) + np.bitwise_count((more[x] ^ more[y]).view(np.uint64))
            hit = np.flatnonzero((apart <= KEY_BITS + MORE_BITS - threshold) & (key[x] >> KEY_BITS == key[y] >> KEY_BITS) & (part[x] != part[y])) + start
            a.append(ids[hit]), b.append(ids[hit + d])
        rows = tuple(x[-reach:] for x in rows)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _blocks(rows: pa.Table, dim: int, k: int, least: float) -> pa.Table:
    """The k most similar of every vector of one block in the other, exactly and
    both ways. Of equally similar ones the first by name."""
    rows = rows.sort_by("name").combine_chunks()
    names, block = np.array(rows.column("name").to_pylist(), object), rows.column("block").to_numpy()
    x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    i, j = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    out = []
    if len(i) and len(j):
        s = np.round(x[i] @ x[j].T, 12)
        if lo == hi:
            np.fill_diagonal(s, -2)
        for one, other, cos in [(i, j, s)] if lo == hi else [(i, j, s), (j, i, np.ascontiguousarray(s.T))]:
            each = np.arange(len(one))
            for _ in range(min(k, len(other))):
                best = cos.argmax(axis=1)  # the first of equal ones
                c = cos[each, best]
                cos[each, best] = -2
                near = np.flatnonzero(c >= least)
                out.append((names[one[near]], names[other[best[near]]], c[near]))
    cat = lambda n, t: pa.array(np.concatenate([o[n] for o in out]) if out else [], t)
    return pa.table([cat(0, pa.string()), cat(1, pa.string()), cat(2, pa.float64())], ["ida", "idb", "cos"])


def groups(links: DataFrame) -> DataFrame:
    """id, label: connected components of links (a, b), by least labels that are
    passed on and followed."""
    e = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = materialise(e.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        got = e.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("got"))
        new = now.join(got, "id").select("id", F.least("label", "got").alias("label"), F.col("label").alias("old"))
        jump = now.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = materialise(new.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "old"))
        if new.where("label < old").isEmpty():
            return new.select("id", "label")
        now = new.select("id", "label")


def dense(near: DataFrame, links: DataFrame, *, dim: int, k: int, least: float) -> DataFrame:
    """(ida, idb, cos): for each vector of a dense group, the k most similar of
    each block of the group, exactly. near: id, name, v. The work is quadratic in
    the size of a group, for nothing less finds the nearest of many vectors that
    are all about as near; a task holds two blocks of it."""
    member = groups(links)
    size = member.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"))
    rows = near.join(member, "id").join(size, "label").withColumn("block", F.pmod(F.hash("id", F.lit(1)), F.col("of")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    rows = rows.select("label", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "block", "name", "v")
    return rows.groupBy("label", "lo", "hi").applyInArrow(lambda t: _blocks(t, dim, k, least), "ida string, idb string, cos double")


def _cosine(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_matrix(batch.column(c), dim).astype(np.float64) for c in ("va", "vb"))
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column("ida"), batch.column("idb"), pa.array(cos)], ["ida", "idb", "cos"])


def similar_pairs(df: DataFrame, *, id_col: str, vector: str, dim: int, k: int = 5, least: float = 0.85, reach: int = REACH, seed: int = 7) -> DataFrame:
    """(a, b, cosine): pairs of usable vectors with a cosine of at least least,
    of which at least one is among the k most similar to the other; a < b as
    strings. Of equally similar ones the smaller id comes first.

    Vectors that aren't usable (NULL, of another length, with a NULL, NaN or
    infinite element, all zero) are in no pair; nor is a NULL id. An empty table
    gives an empty result. ids have to be unique. Only the named columns are
    read.

    Exact copies: of more than k + 1 equal vectors, only the first k + 1 by id
    are indexed. No vector has more than k of them among its k nearest, and the
    others' nearest are the first of their own kind, which they get directly.
    Every usable vector is indexed or belongs to such copies.

    Dense groups (near-copies, copies at another scale): vectors whose widest
    window is full of collisions in some table are joined to groups, and
    searched there exactly in blocks.
    """
    v = F.col(vector).cast("array<float>")
    own = df.select(F.col(id_col).cast("string").alias("name"), v.alias("v")).where(F.col("name").isNotNull() & usable(F.col("v"), dim))
    own = own.select("name", F.xxhash64("name").alias("id"), "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    n = own.count()
    if n == 0:
        return own.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("cosine")).limit(0)
    copies = materialise(own.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2"))
    index, extra = own, None
    if not copies.isEmpty():
        grouped = own.join(copies, ["h1", "h2"], "left_semi").select("h1", "h2", "name")
        # only the first of each kind leave a task, so no task gets all copies
        first = materialise(grouped.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("name"))).where(F.col("rn") <= k + 1))
        later = own.join(copies, ["h1", "h2"], "left_semi").join(first.select("name"), "name", "left_anti")
        heads = first.where(F.col("rn") <= k).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("name")).alias("heads"))
        extra = later.join(heads, ["h1", "h2"]).select("name", F.explode("heads").alias("head"))
        extra = extra.select(F.least("name", "head").alias("a"), F.greatest("name", "head").alias("b"), F.lit(1.0).alias("cosine"))
        index = own.join(later.select("name"), "name", "left_anti")
    tables, threshold = tables_for(n, reach, least), threshold_for(n, reach, least)
    if tables >= 2 ** (63 - KEY_BITS):
        raise ValueError(f"{tables} tables: too many for the key")
    source = index.select("id", "v")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _keys(batches, dim, tables, seed)

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collide(batches, reach, threshold)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _across(batches, reach, threshold)

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cosine(batches, dim)

    spark = df.sparkSession
    # a window has to fit into a range to be known as full
    most = max(1, n * tables // (4 * WIDEST))
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), most), n * tables // 200_000)
    arrays = source.mapInArrow(keys, "key long, more long, id long").repartitionByRange(parts, "key").sortWithinPartitions("key")
    looked = materialise(arrays.mapInArrow(collide, "a long, b long, key long, more long, part int, place long"))
    # 2 reach entries of each range, so one task holds the edges of all
    edges = looked.where("part IS NOT NULL").select("a", "key", "more", "part", "place").repartition(1).sortWithinPartitions("part", "place")
    found = looked.where("part IS NULL").select("a", "b").unionByName(edges.mapInArrow(across, "a long, b long"))
    pairs = materialise(found.distinct())
    near = own.select("id", "name", "v")
    # vectors outside all pairs needn't travel
    hit = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = materialise(near.join(hit, "id", "left_semi"))
    full = materialise(pairs.where("a = b").select(F.col("a").alias("id")))
    in_group = None
    if not full.isEmpty():
        ends = pairs.join(full.select(F.col("id").alias("a"), F.lit(True).alias("fa")), "a", "left").join(full.select(F.col("id").alias("b"), F.lit(True).alias("fb")), "b", "left")
        ends = materialise(ends.select("a", "b", (F.col("fa").isNotNull() & F.col("fb").isNotNull()).alias("inner")))
        in_group = dense(near, ends.where("inner"), dim=dim, k=k, least=least)
        pairs = ends.where("NOT inner").select("a", "b")
    both = pairs.join(near.select(F.col("id").alias("a"), F.col("name").alias("na"), F.col("v").alias("va")), "a").join(near.select(F.col("id").alias("b"), F.col("name").alias("nb"), F.col("v").alias("vb")), "b")
    both = both.select(F.col("na").alias("ida"), F.col("nb").alias("idb"), "va", "vb")
    verified = both.mapInArrow(cosine, "ida string, idb string, cos double").where((F.col("cos") >= least) & (F.col("ida") != F.col("idb")))
    verified = materialise(verified)
    ways = verified.select("ida", "idb", "cos").unionByName(verified.select(F.col("idb").alias("ida"), F.col("ida").alias("idb"), "cos"))
    if in_group is not None:
        ways = ways.unionByName(in_group)
    # near ties are ties: the sums differ in their last digits by the order of the terms
    rank = F.row_number().over(Window.partitionBy("ida").orderBy(F.round("cos", 12).desc(), "idb"))
    top = ways.withColumn("rn", rank).where(F.col("rn") <= k)
    out = top.groupBy(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).agg(F.max("cos").alias("cosine"))
    return out.unionByName(extra) if extra is not None else out


def search(queries: DataFrame, df: DataFrame, *, id_col: str, vector: str, dim: int, k: int = 5, block: int = 2_000) -> DataFrame:
    """(query, rank, id, cosine): the k most similar vectors of df for a stated
    set of queries, exactly. Each task compares its rows with blocks of at most
    block queries, keeps the best k of each, and the best of all tasks are
    merged. The queries are cut into blocks that are broadcast one at a time, so
    neither their number nor that of the rows is bounded."""
    spark = df.sparkSession
    clean = lambda x: x.select(F.col(id_col).cast("string").alias("name"), F.col(vector).cast("array<float>").alias("v")).where(F.col("name").isNotNull() & usable(F.col("v"), dim))
    rows, q = clean(df), clean(queries)
    total = q.count()
    blocks = max(1, -(-total // block))
    q = materialise(q.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks))))
    out = None
    for b in range(blocks):
        part = q.where(F.col("block") == b).select("name", "v").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["name"].tolist(), _unit64(np.stack(part["v"].to_numpy()).astype(np.float32))))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, qx = sent.value
            q32 = qx.astype(np.float32)
            out: list = [[], [], []]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.array(batch.column("name").to_pylist(), object)
                x = _unit64(_matrix(batch.column("v"), dim))
                cos = q32 @ x.astype(np.float32).T
                cut = min(k + 1, cos.shape[1])  # one may be the query itself
                floor = -np.partition(-cos, cut - 1, axis=1)[:, cut - 1] - 1e-5
                r, c = np.nonzero(cos >= floor[:, None])  # ties with the last stay in
                for o, y in zip(out, (r, ids[c], (qx[r] * x[c]).sum(axis=1))):
                    o.append(y)
                if len(out[0]) > 64:
                    out = [[y] for y in _first(*map(np.concatenate, out), k + 1)]
            if out[0]:
                r, ids, cos = _first(*map(np.concatenate, out), k + 1)
                keep = np.array([names[i] != n for i, n in zip(r, ids)], bool)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in r[keep]], pa.string()), pa.array(ids[keep], pa.string()), pa.array(cos[keep])], ["query", "id", "cosine"])

        one = rows.mapInArrow(best, "query string, id string, cosine double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return q.select(F.col("name").alias("query"), F.lit(1).alias("rank"), F.col("name").alias("id"), F.lit(0.0).alias("cosine")).limit(0)
    w = Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")
