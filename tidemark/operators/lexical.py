"""Lexical scores: BM25 and identity, and their fusion with a cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; none for NULL."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(df: DataFrame, *, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the rows that have one of words; words are asked in lower
    case, each once. Number of rows, mean length and frequencies are those of
    all rows, of which blank and NULL ones have the length 0. One pass counts
    them; the second scores only rows with a word."""
    words = list(dict.fromkeys(w.lower() for w in words))
    times = lambda w: F.size(F.filter("tm_t", lambda x: x == F.lit(w)))
    count = [times(w).alias(f"tm_f{i}") for i, w in enumerate(words)]
    rows = df.select(F.col(key), tokens(F.col(text)).alias("tm_t")).select(key, F.size("tm_t").alias("tm_l"), *count)
    if not words:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    f = [F.col(f"tm_f{i}") for i in range(len(words))]
    all_rows = rows.agg(F.count("*").alias("tm_n"), F.avg("tm_l").alias("tm_avg"), *[F.count_if(x > 0).alias(f"tm_d{i}") for i, x in enumerate(f)])
    some = f[0] > 0
    for x in f[1:]:
        some = some | (x > 0)
    part = lambda i: F.ln(1 + (F.col("tm_n") - F.col(f"tm_d{i}") + 0.5) / (F.col(f"tm_d{i}") + 0.5)) * f[i] * (k1 + 1) / (f[i] + k1 * (1 - b + b * F.col("tm_l") / F.col("tm_avg")))
    score = part(0)
    for i in range(1, len(f)):
        score = score + part(i)
    return rows.where(some).crossJoin(F.broadcast(all_rows)).select(key, score.alias("score"))  # one row beside each


def identity(name: Column, wanted: str) -> Column:
    """How far a name is the text asked for, without regard to case: 3 the same,
    2 it begins with it, 1 it holds it, 0 else; 0 for NULL."""
    n, w = F.lower(name), wanted.lower()
    return F.coalesce(F.when(n == w, 3.0).when(n.startswith(w), 2.0).when(F.contains(n, F.lit(w)), 1.0), F.lit(0.0))


def lexical_base(df: DataFrame, scores: list[str], weight: float, out: str = "base") -> DataFrame:
    """df with (1 - weight) times the greatest of its scores, each over its
    maximum in the table; a score whose maximum is not above 0 counts as 0, and
    so does a NULL. The maxima are one row, worked out before in each task."""
    top = df.agg(*[F.max(c).alias(f"tm_max{i}") for i, c in enumerate(scores)])
    share = [F.coalesce(F.when(F.col(f"tm_max{i}") > 0, F.col(c) / F.col(f"tm_max{i}")), F.lit(0.0)) for i, c in enumerate(scores)]
    best = F.greatest(*share) if len(share) > 1 else share[0]
    return df.crossJoin(F.broadcast(top)).select(*df.columns, ((1 - weight) * best).alias(out))
