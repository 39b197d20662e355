"""Mixing sources to target weights, by entropy balancing.

Of all ways to weight the documents that give each source its share of the
tokens, the one nearest to taking each document once (by relative entropy) is
an exponential tilt of the documents' rates. Its dual is convex and solved by
Newton's method; sums over the documents are Spark aggregates, and only one
number per source goes back and forth. Rates become whole copies by a draw from
the document's id, shifted for its source such that the sums come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

#: More target sources than this are refused: their numbers pass the driver.
MAX_SOURCES = 100_000
#: So many shifts of a source's draws are tried, to find the one whose copies
#: come nearest to the tokens wanted.
SHIFTS = 64


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


@lru_cache(maxsize=4)
def _encoder(path: str | None):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str | None = None) -> DataFrame:
    """df with the number of tokens of a whole text; NULL has none. tokenizer:
    path of a rank file, by default that of the byte-level BPE of 50k."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            t = b.column(b.schema.get_field_index(text))
            n = [0 if x is None else len(enc.encode_ordinary(x)) for x in t.to_pylist()]
            keep = [k for k in range(b.num_columns) if b.schema.names[k] != text]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], [*[b.schema.names[k] for k in keep], out])

    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"{out} bigint"])
    return df.mapInArrow(count, schema)


def balance(sizes: DataFrame, targets: dict[str, tuple[float, int]], total: float, rounds: int = 60, tolerance: float = 1e-10) -> tuple[dict[str, float], set[str]]:
    """(tilts, short): the tilt of each source, rate = min(cap, exp(tilt * tokens
    / mean)), such that the tokens at these rates are its share of total; and the
    sources for which there is none.

    sizes: (source, tokens, n), documents counted by size. The slope of the dual
    in a source's tilt is what its rates give less its share, and grows with the
    tilt. Each source is first looked at in the limit: where the slope stays
    below 0 however great the tilt, the dual is unbounded, so no mixture is
    feasible; the source is short and its tilt infinite (as it is where the
    limit gives just the share). For a target of 0 the tilt is minus infinity.
    The others are solved by Newton steps, kept inside a bracket and halving it
    where they would leave it, so each equation is solved from anywhere.
    """
    spark = sizes.sparkSession
    x = F.col("tokens") / F.col("mean")
    raw = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
    mass = F.col("n") * F.col("tokens")

    def slopes(at: dict[str, float], mean: dict[str, float]) -> dict:
        now = spark.createDataFrame([(s, float(v), float(targets[s][1]), mean[s]) for s, v in at.items()], "source string, tilt double, cap double, mean double")
        step = sizes.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(mass * F.least(raw, F.col("cap"))).alias("got"), F.sum(F.when(raw < F.col("cap"), mass * raw * x).otherwise(0.0)).alias("slope"))
        return {r["source"]: (r["got"] - targets[r["source"]][0] * total, r["slope"]) for r in step.collect()}

    wanted = {s for s, (w, _) in targets.items() if w * total > 0}
    tilt = {s: -math.inf for s in targets if s not in wanted}
    have = {r["source"]: (float(r["t"] or 0), int(r["n"])) for r in sizes.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()} if wanted else {}
    mean = {s: t / n for s, (t, n) in have.items() if t > 0}
    limit = slopes({s: math.inf for s in mean}, mean) if mean else {}
    short = {s for s in wanted if limit.get(s, (-1.0, 0.0))[0] < 0}
    tilt |= {s: math.inf for s in wanted if limit.get(s, (-1.0, 0.0))[0] <= 0}
    active = {s: [math.log(targets[s][0] * total / have[s][0]), -60.0, 60.0] for s in wanted - tilt.keys()}  # tilt, lower and upper bound
    for _ in range(rounds):
        if not active:
            break
        for s, (off, slope) in slopes({s: v[0] for s, v in active.items()}, mean).items():
            v = active[s]
            if abs(off) <= tolerance * total:
                tilt[s] = v[0]
                continue
            v[1], v[2] = (v[1], v[0]) if off > 0 else (v[0], v[2])
            new = v[0] - off / slope if slope > 0 else math.nan
            v[0] = new if v[1] < new < v[2] else (v[1] + v[2]) / 2
        active = {s: v for s, v in active.items() if s not in tilt}
    return tilt | {s: v[0] for s, v in active.items()}, short


def mixture(docs: DataFrame, targets: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents: doc_id, source, tokens, rate, copies, for every row of docs with
    a source in targets; copies is a whole number, at most max_repeats, whose
    expectation is the rate. shares: source, target_weight, max_repeats,
    documents, tokens, target_tokens, enough (false where the dual is unbounded,
    so even all documents, max_repeats times, don't reach the target),
    copies_tokens, reached_weight (share of the mixture).

    The target is target_weight of the tokens of all documents, those without a
    target source included. Spellings of a source are joined. NULL, blank and
    long texts are counted as they are; a document without tokens takes the rate
    1 and adds nothing. NULL sources, and sources without a target, are in no
    mixture. A target source without documents has no rows in documents and is
    short in shares. targets must name a source once, in whatever spelling.
    """
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("cap")).where("source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(goals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    if len({r["source"] for r in goals}) < len(goals):
        raise ValueError("a source has two targets")
    plan = {r["source"]: (r["w"] or 0.0, r["cap"] or 0) for r in goals}
    spark = docs.sparkSession
    sized = materialise(count_tokens(docs.select(F.col(doc).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("tm_text")), "tm_text", tokenizer=tokenizer))
    sizes = materialise(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    total = float(sizes.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0)
    tilt, short = balance(sizes, plan, total)
    rows = [(s, w, c, w * total, tilt[s], s not in short) for s, (w, c) in plan.items()]
    by_source = spark.createDataFrame(rows, "source string, target_weight double, max_repeats int, target_tokens double, tilt double, enough boolean")
    mean = sizes.groupBy("source").agg((F.sum(F.col("tokens") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("documents"), F.sum(F.col("tokens") * F.col("n")).alias("source_tokens"))
    facts = by_source.join(mean, "source", "left")
    inf = F.lit(float("inf"))
    power = F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(700.0))
    rate = F.when(F.col("tilt") == inf, F.col("max_repeats").cast("double")).when(F.col("tilt") == -inf, 0.0).when(F.col("tokens") == 0, F.least(F.lit(1.0), F.col("max_repeats"))).otherwise(F.least(F.exp(power), F.col("max_repeats").cast("double")))
    # a draw in [0, 1) from the id alone
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    chosen = sized.join(facts.where("mean IS NOT NULL").select("source", "max_repeats", "tilt", "mean"), "source").withColumn("rate", rate)
    copies = lambda shift: F.floor(F.col("rate") + F.pmod(draw + shift, F.lit(1.0))).cast("int")
    tried = chosen.groupBy("source").agg(F.array(*[F.sum(F.col("tokens") * copies(F.lit(k / SHIFTS))) for k in range(SHIFTS)]).alias("sums"), F.sum(F.col("tokens") * F.col("rate")).alias("wanted"))
    best = F.array_sort(F.transform("sums", lambda x, k: F.struct(F.abs(x - F.col("wanted")).alias("off"), k.alias("k"))))[0]["k"]
    documents = chosen.join(tried.select("source", (best / SHIFTS).alias("shift")), "source").select("doc_id", "source", "tokens", "rate", copies(F.col("shift")).alias("copies"))
    reached = documents.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("copies_tokens"))
    all_copies = reached.agg(F.sum("copies_tokens").alias("all_copies"))
    none = F.lit(0).cast("bigint")
    shares = facts.join(reached, "source", "left").crossJoin(all_copies).select(
        "source", "target_weight", "max_repeats", F.coalesce("documents", none).alias("documents"), F.coalesce("source_tokens", none).alias("tokens"), "target_tokens",
        "enough", F.coalesce("copies_tokens", none).alias("copies_tokens"),
        F.coalesce(F.col("copies_tokens") / F.col("all_copies"), F.lit(0.0)).alias("reached_weight"),
    )
    return documents, shares
