"""Evaluation passages inside training text.

Both sides become words without case, punctuation, markup and escapes. A passage
gives runs of SEED words as seeds: how often each occurs in the corpus is
counted, and the most frequent are left out as long as a leak that shows none of
the others would be too short to be one. The seeds lead to the pairs worth a
look. Around the seeds each pair is aligned word by word (Smith-Waterman, where
skipping ahead costs no more than JUMP), and the score decides; of what it lets
through the stretches of equal words are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: A stretch counts from so many words on; also the length of the seeds.
SEED = 8
#: Seeds are broadcast up to so many, else joined by shuffle.
BROADCAST_SEEDS = 2_000_000
#: Smith-Waterman: a word that agrees, one that does not, a word left out, and
#: the most that leaving out any number of words costs.
MATCH, MISS, GAP, JUMP = 2, 1, 1, 4
#: Words of documents aligned at a time.
TOGETHER = 65_536


#: Characters that don't show.
HIDDEN = "[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]"


def plain(text: Column) -> Column:
    """Words of a text, joined by blanks: HTML and string escapes undone, tags
    dropped, lower case, letters and digits only. NULL gives an empty text."""
    raw = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(raw, HIDDEN, "")
    for _ in range(2):
        t = F.regexp_replace(t, "&(?:amp|#38|#x26);", "&")
    t = F.regexp_replace(F.regexp_replace(t, "&(?:lt|#60|#x3[cC]);", "<"), "&(?:gt|#62|#x3[eE]);", ">")
    t = F.regexp_replace(t, r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,20});", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>", " ")
    t = F.regexp_replace(t, r"\\+(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrtbf])", " ")
    # most texts have nothing to undo
    t = F.when(raw.rlike(r"[&<\\]|" + HIDDEN), t).otherwise(raw)
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))


def runs(texts: pa.Array, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all runs of so many words, in order; none in shorter texts.
    Words are hashed once each, runs by a polynomial over their words' hashes,
    for all texts of a batch at once."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten().dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = each[words.indices.to_numpy()]
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    whole = row[:n] == row[size - 1 :]
    return row[:n][whole], out[whole].view(np.int64)


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, place) for (id, words)."""
    for batch in batches:
        row, h = runs(batch.column("words"))
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(h), pa.array(place.astype(np.int32))], ["id", "h", "place"])


def _hits(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, h) once for (id, words) with runs that are known; known is sorted
    and not empty."""
    for batch in batches:
        row, h = runs(batch.column("words"))
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        pair = np.unique(np.stack([row[hit], at[hit]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(pair[:, 0])), pa.array(known[pair[:, 1]])], ["doc", "h"])


def own_passages(items: DataFrame, *, item: str, passage: str) -> DataFrame:
    """(item, words): the passage without a standing instruction, that is without
    the longest opening, in sentences, that another passage has too. Equal
    passages don't count as another, and the last sentence is no opening.
    Openings are compared by a hash that goes on from sentence to sentence, so
    a long passage costs no more than its length."""
    p = items.select(F.col(item).alias("item"), F.split(F.coalesce(F.col(passage), F.lit("")), r"(?<=[.!?:])\s+").alias("s"))
    said = F.transform("s", plain)
    heads = F.aggregate(F.slice(said, 1, F.size("s") - 1), F.array().cast("array<bigint>"), lambda seen, x: F.concat(seen, F.array(F.when(x == "", F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0).cast("bigint"))).otherwise(F.xxhash64(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0).cast("bigint")), x)))))
    p = materialise(p.where("size(s) > 0").withColumn("heads", heads).withColumn("whole", F.xxhash64("s")))
    shared = p.dropDuplicates(["whole"]).select(F.explode(F.array_distinct("heads")).alias("head")).where("head != 0").groupBy("head").agg(F.count("*").alias("k")).where("k > 1").select("head")
    cut = p.select("item", F.posexplode("heads").alias("n", "head")).join(shared, "head", "left_semi").groupBy("item").agg((F.max("n") + 1).alias("n"))
    rest = p.join(cut, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rest.select("item", F.split(plain(F.array_join(F.slice("s", F.col("n") + 1, F.size("s")), " ")), " ").alias("words"))


def rare_runs(h: np.ndarray, n: np.ndarray, size: int, least: float, run: int = SEED) -> np.ndarray:
    """Which runs of an item (hashes in order, with their counts in the corpus)
    are its seeds. The most frequent are left out as long as the words that
    these cover stay below the share least of all: stretches that show no seed
    lie within those words, so a leak always shows one."""
    keep, covered = np.ones(len(h), bool), np.zeros(size, bool)
    for i in sorted(range(len(h)), key=lambda i: (-n[i], i)):
        if n[i] == 0:
            break
        more = covered.copy()
        more[i : i + run] = True
        if more.sum() < least * size:
            covered, keep[i] = more, False
    return keep


def _choose(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(item, h) of the seeds, for (item, size, runs)."""
    for batch in batches:
        items, out_i, out_h = batch.column("item").to_pylist(), [], []
        for k, (size, run) in enumerate(zip(batch.column("size").to_pylist(), batch.column("runs"))):
            h, n = (run.values.field(c).to_numpy() for c in ("h", "n"))
            kept = h[rare_runs(h, n, size, least)]
            out_h.append(kept)
            out_i += [items[k]] * len(kept)
        yield pa.RecordBatch.from_arrays([pa.array(out_i, pa.int64()), pa.array(np.concatenate(out_h) if out_h else [], pa.int64())], ["item", "h"])


def align(docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, one pair a row, as
    numbers; negative ones stand for the end and for words the other lacks.
    Leaving out words costs GAP each, but JUMP at most."""
    g, n = docs.shape
    row, best = np.zeros((g, n + 1), np.int32), np.zeros(g, np.int32)
    top = np.zeros((g, n + 1), np.int32)  # greatest score so far, at most so far along the document
    slope = np.arange(n + 1, dtype=np.int32) * GAP
    for i in range(items.shape[1]):
        equal = (docs == items[:, i : i + 1]) & (items[:, i : i + 1] >= 0)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.where(equal, np.maximum(row[:, :-1], top[:, :-1] - JUMP) + MATCH, row[:, :-1] - MISS), row[:, 1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the document
        top = np.maximum(top, np.maximum.accumulate(row, axis=1))
        best = np.maximum(best, row.max(axis=1))
    return best


def stretches(docs: np.ndarray, items: np.ndarray, least: int = SEED) -> np.ndarray:
    """Most words of an item that lie, in its order, in stretches of at least so
    many words in the document, for pairs as in align(). Exact: best[i, d] over
    the first i and d words is that without one of the last words, or that of a
    stretch which ends with both."""
    g, n = docs.shape
    best = [np.zeros((g, n + 1), np.int32)]  # of the rows up to least back
    run, ending = np.zeros((g, n + 1), np.int32), np.full((g, n + 1), -1, np.int32)
    for i in range(items.shape[1]):
        equal = (docs == items[:, i : i + 1]) & (items[:, i : i + 1] >= 0)
        new_run, new_end = np.zeros_like(run), np.full_like(ending, -1)
        new_run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        new_end[:, 1:] = np.where(equal & (ending[:, :-1] >= 0), ending[:, :-1] + 1, -1)
        if len(best) >= least and n >= least:
            start = np.where(new_run[:, least:] >= least, best[-least][:, :-least] + least, -1)
            new_end[:, least:] = np.maximum(new_end[:, least:], start)
        best.append(np.maximum.accumulate(np.maximum(best[-1], new_end), axis=1))
        best = best[-least:]
        run, ending = new_run, new_end
    return best[-1][:, -1]


def around(doc: np.ndarray, item: np.ndarray, run: int = SEED) -> np.ndarray:
    """The words of doc within run places of a run that item has too, with -1
    for each part left out. No stretch lies outside, and skipping costs JUMP
    whatever its length, so leaving the rest out takes nothing from an
    alignment that jumps."""
    if len(doc) < run or len(item) < run:
        return doc[:0]
    known = {item[i : i + run].tobytes() for i in range(len(item) - run + 1)}
    possible = np.flatnonzero(doc[: len(doc) - run + 1] >= 0)
    if len(possible):  # a run has only words of the item
        ok = np.lib.stride_tricks.sliding_window_view(doc >= 0, run).all(axis=1)
        possible = possible[ok[possible]]
    hit = [i for i in possible.tolist() if doc[i : i + run].tobytes() in known]
    edge = np.zeros(len(doc) + 1, np.int64)
    for i in hit:
        edge[max(0, i - run)] += 1
        edge[min(len(doc), i + 2 * run)] -= 1
    near = np.cumsum(edge[:-1]) > 0
    first_out = ~near & np.r_[True, near[:-1]]
    return np.where(near, doc, -1)[near | first_out]


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(1, max(map(len, rows)))), fill, np.int32)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _together(which: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """which, in order of length, in parts of TOGETHER words or one document."""
    lo = 0
    while lo < len(which):
        hi = lo + 1
        while hi < len(which) and (hi + 1 - lo) * len(docs[which[hi]]) <= TOGETHER:
            hi += 1
        yield which[lo:hi]
        lo = hi


def _score(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Adds score, covered and size; covered is measured where the score allows
    a leak: stretches of a share least score MATCH a word and lose JUMP between
    two of them, of which there are not more than one in SEED words."""
    for batch in batches:
        docs, items = [], []
        number: dict[str, dict[str, int]] = {}
        for d, i in zip(batch.column("doc_words").to_pylist(), batch.column("item_words").to_pylist()):
            place = number.setdefault(i, {})
            words = i.split(" ")
            for w in words:
                place.setdefault(w, len(place))
            item = np.array([place[w] for w in words], np.int32)
            docs.append(around(np.array([place.get(w, -1) for w in d.split(" ")], np.int32), item))
            items.append(item)
        size = np.array([len(i) for i in items])
        score, covered = np.zeros(len(docs), np.int32), np.zeros(len(docs), np.int32)
        by_size = np.argsort([len(d) for d in docs], kind="stable")
        for at in _together(by_size, docs):
            score[at] = align(_padded([docs[k] for k in at], -1), _padded([items[k] for k in at], -2))
        wanted = np.ceil(least * size)
        good = by_size[(score >= wanted * MATCH - JUMP * np.floor((wanted - 1) / SEED))[by_size]]
        for at in _together(good, docs):
            covered[at] = stretches(_padded([docs[k] for k in at], -1), _padded([items[k] for k in at], -2))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("item"), *[pa.array(x.astype(np.int32)) for x in (score, covered, size)]], ["doc", "item", "score", "covered", "size"])


def leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least: float = 0.5) -> DataFrame:
    """(doc, item, score, covered, size, share): documents with at least the
    share least of an item's own words in stretches of SEED or more, in the
    item's order. score is that of the alignment.

    NULL, blank and short texts leak nothing, and an item with fewer than SEED
    words of its own can't be found. Repeated documents are each reported, under
    their own ids; rows with a NULL id can't be named and are left out. Texts
    are read whole, whatever their length. Which runs are rare is counted over
    all documents; see rare_runs() for why no leak is lost by the choice.
    """
    spark = docs.sparkSession
    own = materialise(own_passages(items.where(F.col(item).isNotNull()), item=item, passage=passage).select(F.col("item").cast("long").alias("item"), F.array_join("words", " ").alias("item_words"), F.size("words").alias("size")))
    all_runs = materialise(own.select(F.col("item").alias("id"), F.col("item_words").alias("words")).mapInArrow(_all_runs, "id long, h long, place int"))
    said = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("id"), plain(F.col(text)).alias("words"))
    known = all_runs.select("h").distinct()
    count = known.count()
    if count == 0:
        near = spark.createDataFrame([], "doc long, h long")
    elif count <= BROADCAST_SEEDS:
        sent = spark.sparkContext.broadcast(np.sort(known.toPandas()["h"].to_numpy(np.int64)))

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _hits(batches, sent.value)

        near = said.mapInArrow(hits, "doc long, h long")
    else:
        near = said.mapInArrow(_all_runs, "id long, h long, place int").select(F.col("id").alias("doc"), "h").distinct().join(known, "h", "left_semi").select("doc", "h")
    near = materialise(near)
    frequent = near.groupBy("h").agg(F.count("*").alias("n"))
    counted = all_runs.join(frequent, "h", "left").groupBy(F.col("id").alias("item")).agg(F.array_sort(F.collect_list(F.struct("place", "h", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("runs"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _choose(batches, least)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, least)

    seeds = counted.join(own.select("item", "size"), "item").select("item", "size", "runs").mapInArrow(choose, "item long, h long").distinct()
    # written, so that Spark knows how few they are before it reads the texts again
    pairs = materialise(near.join(seeds, "h").select("doc", "item").distinct())
    texts = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("tm_text"))
    found = pairs.join(texts, "doc").select("doc", "item", plain(F.col("tm_text")).alias("doc_words")).join(own.select("item", "item_words"), "item")
    scored = found.select("doc", "item", "doc_words", "item_words").mapInArrow(score, "doc long, item long, score int, covered int, size int")
    return scored.where(F.col("covered") >= least * F.col("size")).withColumn("share", F.col("covered") / F.col("size"))
