"""Certified top-k: a float32 estimate with proven bounds decides most rows, and
only those it leaves open are scored exactly. Where that can't be had, or isn't
worth it, all rows of the query are scored exactly, and the reason is told."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise, scratch

try:
    import numpy as np
except ImportError:  # the exact lane needs none
    np = None

#: Unit roundoff of float32.
U = 2.0**-24
MEMORY_CAP = 256 * 1024 * 1024
#: Queries are broadcast in blocks of so many.
BLOCK = 1_000


def gamma(dim: int) -> float:
    ops = 2 * dim + 16
    return ops * U / (1 - ops * U)


def exact_cosine(a: Column, b: Column) -> Column:
    """In double, terms in order; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def estimate(x: "np.ndarray", q: "np.ndarray") -> "tuple[np.ndarray, np.ndarray, np.ndarray]":
    """(estimate, lower, upper) of the cosines of rows x with queries q, in
    float32 with rigorous bounds. Zero vectors have 0, 0, 0."""
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors of different dimension")
    if not (np.isfinite(x).all() and np.isfinite(q).all()):
        raise ValueError("vectors must be finite")
    nx, nq = np.linalg.norm(x, axis=1).astype(np.float32), np.linalg.norm(q, axis=1).astype(np.float32)
    with np.errstate(all="ignore"):
        est = ((x @ q.T) / (nx[:, None] * nq[None, :])).astype(np.float64)
    zero = (nx[:, None] == 0) | (nq[None, :] == 0)
    est[zero] = 0.0
    err = gamma(x.shape[1]) * (5 + np.abs(est)) + 32 * 2.0**-23
    err[zero] = 0.0
    return est, est - err, est + err


def exact_rows(x: "np.ndarray", q: "np.ndarray") -> "np.ndarray":
    """Exact cosines of row pairs in double."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
    with np.errstate(all="ignore"):
        return np.where(n > 0, (x * q).sum(axis=1) / n, 0.0)


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Queries in blocks of about BLOCK, as lists of (query, vector); only one
    block is on the driver at a time."""
    head = queries.limit(BLOCK + 1).collect()
    if len(head) <= BLOCK:
        if head:
            yield sorted(((r["query"], list(r["qv"])) for r in head), key=lambda x: x[0])
        return
    parts = -(-queries.count() // BLOCK)
    for b in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == b).orderBy("query").collect()
        if rows:
            yield [(r["query"], list(r["qv"])) for r in rows]


def _matrix(batch: pa.RecordBatch, dim: int) -> "np.ndarray":
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(flat) != dim * batch.num_rows:
        raise ValueError("vectors of different dimension")
    return flat.reshape(-1, dim)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _rows(df: DataFrame, id_col: str, vector: str, lexical: str | None) -> DataFrame:
    base = F.col(lexical).cast("double") if lexical else F.lit(0.0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.coalesce(base, F.lit(0.0)).alias("base")).where("v IS NOT NULL")


_FOUND = "query long, id long, low double, up double, score double, n long, reason string"


def _emit(query, id_=None, low=None, up=None, score=None, n=None, reason=None) -> pa.RecordBatch:
    size = len(query)
    of = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), of(id_, pa.int64()), of(low, pa.float64()), of(up, pa.float64()), of(score, pa.float64()), of(n, pa.int64()), of(reason, pa.string())], ["query", "id", "low", "up", "score", "n", "reason"])


def _certify(batches: Iterator[pa.RecordBatch], names: list, qv: "np.ndarray", k: int, weight: float, cap: int) -> Iterator[pa.RecordBatch]:
    """One task's rows that may be among the k best, with their bounds and exact
    scores: those whose upper bound reaches the k-th lower bound that the task
    has seen, which is no greater than that of the table, and those whose sign is
    open. And one row per query with n, the rows seen, and the reason why none
    were scored, if so."""
    names = np.array(names)
    best = np.empty((0, len(names)))
    seen, reason = 0, None
    for b in batches:
        seen += b.num_rows
        if reason or not b.num_rows:
            continue
        if b.num_rows * qv.shape[1] * 4 > cap:
            reason = "memory_cap_refusal"
            continue
        try:
            x, base = _matrix(b, qv.shape[1]), b.column("base").to_numpy()
            _, low, up = estimate(x, qv)
        except MemoryError:
            reason = "allocation_failure"
            continue
        low, up = low * weight + base[:, None], up * weight + base[:, None]
        best = np.concatenate([best, low])
        if len(best) > k:
            best = -np.partition(-best, k - 1, axis=0)[:k]
        least = best.min(axis=0) if len(best) == k else np.full(len(names), -np.inf)
        r, c = np.nonzero((up >= least[None, :]) | ((low <= 0) & (up > 0)))
        yield _emit(names[c], b.column("id").to_numpy()[r], low[r, c], up[r, c], base[r] + weight * exact_rows(x[r], qv[c]))
    yield _emit(names, n=np.full(len(names), seen), reason=[reason] * len(names))


def _exact(batches: Iterator[pa.RecordBatch], names: list, qv: "np.ndarray", k: int, weight: float) -> Iterator[pa.RecordBatch]:
    """One task's k best rows by exact score, and per query the rows scored."""
    kept: list = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
    seen = 0
    for b in batches:
        seen += b.num_rows
        x, base, ids = _matrix(b, qv.shape[1]).astype(np.float64), b.column("base").to_numpy(), b.column("id").to_numpy()
        for c in range(len(names)):
            score = base + weight * exact_rows(x, np.broadcast_to(qv[c], x.shape))
            score, at = np.r_[kept[c][0], score[score > 0]], np.r_[kept[c][1], ids[score > 0]]
            first = np.lexsort((at, -score))[:k]
            kept[c] = score[first], at[first]
    for name, (score, at) in zip(names, kept):
        yield _emit(np.full(len(at), name), at, score=score)
    yield _emit(np.array(names), n=np.full(len(names), seen))


def topk(df: DataFrame, queries: DataFrame, *, id_col: str, vector: str, k: int, weight: float = 1.0, lexical: str | None = None, mode: str = "float32_certified_candidate", max_fraction: float = 0.25, memory_cap: int = MEMORY_CAP) -> tuple[DataFrame, DataFrame]:
    """(top, counts) for each of queries, which has the same columns as df.

    top: query, rank, id, score; score = lexical + weight * cosine; only scores
    above 0, best first, then the smaller id; so there may be fewer than k.
    counts: query, n, uncertain (rows that the bounds leave open, NULL where
    none were had), rescored (rows that were scored exactly), lane (certified or
    exact), fallback_reason.

    mode exact_tiebreak_baseline scores all rows exactly;
    bounded_exact_fallback does because it is told to; the certified mode falls
    back where more than max(k, max_fraction * n) rows are uncertain
    (certification_fraction_limit), where a task's batch of vectors takes more
    than memory_cap bytes (memory_cap_refusal) or can't be allocated
    (allocation_failure), or without numpy (numpy_unavailable). weight must not
    be negative. NULL vectors are left out; vectors of different lengths, or
    with NaN or infinite elements, are an error in the certified mode. A query
    without rows has no top.

    Rows stay where they are, and each lane reads them once: a task hands on only
    what may be among the k best. Queries go in blocks; one block is on the
    driver at a time, and its results are written before the next begins.
    """
    if weight < 0:
        raise ValueError("weight must not be negative")
    if mode not in ("float32_certified_candidate", "exact_tiebreak_baseline", "bounded_exact_fallback"):
        raise ValueError(f"unknown mode {mode}")
    spark = df.sparkSession
    rows = _rows(df, id_col, vector, lexical)
    q = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("qv")).where("qv IS NOT NULL")
    path = scratch(spark)

    def run(wanted: DataFrame, kernel, lane: str) -> None:
        block = None
        for block in _blocks(wanted):
            names, qv = [x for x, _ in block], [v for _, v in block]
            if np is None:
                near = spark.createDataFrame(block, "query long, qv array<float>")
                score = F.col("base") + weight * exact_cosine(F.col("v"), F.col("qv"))
                every = rows.join(F.broadcast(near), F.lit(True)).select("query", "id", score.alias("score"))
                w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
                best = every.where("score > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
                out = best.unionByName(every.groupBy("query").agg(F.count("*").alias("n")), allowMissingColumns=True).select("query", "id", *[F.lit(None).cast("double").alias(c) for c in ("low", "up")], "score", "n", F.lit(None).cast("string").alias("reason"))
                out.withColumn("lane", F.lit(lane)).write.mode("append").parquet(path)
                continue
            sent = spark.sparkContext.broadcast((names, np.array(qv, np.float32)))

            def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                return kernel(batches, *sent.value)

            rows.mapInArrow(task, _FOUND).withColumn("lane", F.lit(lane)).write.mode("append").parquet(path)
            sent.unpersist()
        if block is None:
            spark.createDataFrame([], _FOUND + ", lane string").write.mode("append").parquet(path)

    def certify(batches, names, qv):
        return _certify(batches, names, qv, k, weight, memory_cap)

    def exactly(batches, names, qv):
        return _exact(batches, names, qv, k, weight)

    reason = {"exact_tiebreak_baseline": "", "bounded_exact_fallback": "forced_exact_fallback_mode"}.get(mode, "numpy_unavailable" if np is None else None)
    if reason is None:
        run(q, certify, "certified")
        found = spark.read.schema(_FOUND + ", lane string").parquet(path)
        cand = found.where("id IS NOT NULL")
        low = Window.partitionBy("query").orderBy(F.col("low").desc())
        kth = cand.withColumn("rn", F.row_number().over(low)).where(F.col("rn") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("kth"))
        open_ = (F.col("up") >= F.col("kth")) | ((F.col("low") <= 0) & (F.col("up") > 0))
        unsure = cand.join(kth, "query").groupBy("query").agg(F.count_if(open_).alias("uncertain"), F.count("*").alias("rescored"))
        stats = found.where("id IS NULL").groupBy("query").agg(F.sum("n").alias("n"), F.max("reason").alias("reason"))
        zero = F.lit(0).cast("long")
        c = stats.join(unsure, "query", "left").withColumns({"uncertain": F.when(F.col("reason").isNull(), F.coalesce("uncertain", zero)), "rescored": F.coalesce("rescored", zero)})
        over = F.col("uncertain") > F.greatest(F.least(F.lit(k), F.col("n")), F.ceil(F.col("n") * max_fraction))
        first = materialise(c.select("query", "n", "uncertain", "rescored", F.coalesce("reason", F.when(over, "certification_fraction_limit"), F.lit("")).alias("fallback_reason")))
        back = first.where("fallback_reason != ''").select("query")
        if not back.isEmpty():
            run(q.join(back, "query", "left_semi"), exactly, "exact")
    else:
        run(q, exactly, "exact")
        first = None
    found = spark.read.schema(_FOUND + ", lane string").parquet(path)
    exact = found.where("lane = 'exact'")
    scored = exact.where("id IS NULL").groupBy("query").agg(F.sum("n").alias("n_exact"))
    if first is None:
        counts = scored.select("query", F.col("n_exact").alias("n"), F.lit(None).cast("long").alias("uncertain"), F.col("n_exact").alias("rescored"), F.lit("exact").alias("lane"), F.lit(reason).alias("fallback_reason"))
        chosen = exact
    else:
        joined = first.join(scored, "query", "left")
        counts = joined.select("query", "n", "uncertain", F.coalesce("n_exact", "rescored").alias("rescored"), F.when(F.col("n_exact").isNotNull(), "exact").otherwise("certified").alias("lane"), "fallback_reason")
        chosen = found.join(first.select("query", (F.col("fallback_reason") == "").alias("tm_ok")), "query").where((F.col("lane") == "exact") | F.col("tm_ok"))
    # a query without any rows in the table
    counts = q.select("query").join(counts, "query", "left").select("query", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "uncertain", F.coalesce("rescored", F.lit(0).cast("long")).alias("rescored"), F.coalesce("lane", F.lit("certified" if reason is None else "exact")).alias("lane"), F.coalesce("fallback_reason", F.lit(reason or "")).alias("fallback_reason"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    top = chosen.where("id IS NOT NULL AND score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
    return top, counts


def insertion_order_top(df: DataFrame, *, by: list[str], score: str, order: str, k: int) -> DataFrame:
    """by, rank and df's columns: the k best positive scores, equal ones in the
    order in which they came (column order). A control that shows what a
    tie-break by id changes; not for use."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), order)
    return df.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_scores(df: DataFrame, queries: DataFrame, *, id_col: str, vector: str, least: float | None = None) -> DataFrame:
    """query, id, exact, est, lower, upper for every row and query of a stated
    query set: for audits of the bounds, not for search. With least, only pairs
    of an exact score from there on come out; the bounds settle most others
    before they are scored."""
    rows = _rows(df, id_col, vector, None)
    q = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("qv")).where("qv IS NOT NULL")
    out = []
    for block in _blocks(q):
        sent = df.sparkSession.sparkContext.broadcast(([x for x, _ in block], np.array([v for _, v in block], np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, qv = sent.value
            for b in batches:
                x, ids = _matrix(b, qv.shape[1]), b.column("id")
                est, low, up = estimate(x, qv)
                for c, name in enumerate(names):  # one query at a time bounds a batch's size
                    at = np.arange(len(x)) if least is None else np.flatnonzero(up[:, c] >= least)
                    exact = exact_rows(x[at], np.broadcast_to(qv[c], (len(at), x.shape[1])))
                    if least is not None:
                        at, exact = at[exact >= least], exact[exact >= least]
                    cols = [pa.array(np.full(len(at), name)), ids.take(pa.array(at)), *[pa.array(a) for a in (exact, est[at, c], low[at, c], up[at, c])]]
                    yield pa.RecordBatch.from_arrays(cols, ["query", "id", "exact", "est", "lower", "upper"])

        out.append(rows.mapInArrow(run, "query long, id long, exact double, est double, lower double, upper double"))
    if not out:
        return rows.select(F.col("id").alias("query"), "id", *[F.lit(0.0).alias(c) for c in ("exact", "est", "lower", "upper")]).limit(0)
    return _union(out)


def tied(scores: DataFrame, score: str = "exact") -> DataFrame:
    """query, score of all scores that more than one row of a query has. Counts
    are added up in each task before they are shuffled."""
    return scores.groupBy("query", score).agg(F.count("*").alias("tm_n")).where("tm_n > 1").select("query", score)


def certification(scores: DataFrame, *, k: int) -> DataFrame:
    """query and counts: total, ties (rows that share an exact score), uncertain,
    certified (uncertain but no tie), genuine (rank differs between exact and
    estimate, no tie, certified), near, other (bounds broken, in none of the
    others), raw disagreements. Ranks are per query, over its rows of scores;
    each task keeps k rows a query of every ranking before they are shuffled."""
    scores = materialise(scores)

    def best(c: str, where: str = "TRUE") -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.col(c).desc(), "id")
        return scores.where(where).select("query", "id", c).withColumn(f"rank_{c}", F.row_number().over(w)).where(F.col(f"rank_{c}") <= k)

    kth = best("lower").groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(F.lit(float("-inf"))).alias("kth"))
    ranks = best("exact", "exact > 0").drop("exact").join(best("est", "est > 0").drop("est"), ["query", "id"], "full_outer")
    differ = ranks.where(~F.col("rank_exact").eqNullSafe(F.col("rank_est"))).select("query", "id", F.lit(True).alias("differs"))
    s = scores.join(kth, "query").join(tied(scores).withColumn("tie", F.lit(True)), ["query", "exact"], "left").join(differ, ["query", "id"], "left")
    s = s.withColumns({"tie": F.coalesce("tie", F.lit(False)), "differs": F.coalesce("differs", F.lit(False))})
    uncertain = (F.col("upper") >= F.col("kth")) | ((F.col("lower") <= 0) & (F.col("upper") > 0))
    broken = (F.col("exact") < F.col("lower")) | (F.col("exact") > F.col("upper"))
    cert = uncertain & ~F.col("tie")
    genuine = F.col("differs") & cert
    return s.groupBy("query").agg(
        F.count("*").alias("total"), F.count_if("tie").alias("ties"), F.count_if(uncertain).alias("uncertain"), F.count_if(cert).alias("certified"), F.count_if(genuine).alias("genuine"),
        F.count_if(cert & ~genuine & ~broken).alias("near"), F.count_if(broken & ~genuine).alias("other"), F.count_if("differs").alias("raw_disagreement"),
    )
