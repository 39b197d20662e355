"""Questions that tools of a code index ask: search, outline, tree, hot spots,
churn, corrections. Their answers are our design, by name and arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.reads import in_list


def winnow(df: DataFrame, where: list[Column], rank_by: Column, key: str, limit: int = 20) -> DataFrame:
    """Rows for which all of where holds, the greatest by rank_by first, then by
    key; NULL ranks come last."""
    for w in where:
        df = df.where(w)
    return df.orderBy(rank_by.desc_nulls_last(), key).limit(limit)


def search_names(df: DataFrame, name: str, wanted: str, key: str, limit: int = 20) -> DataFrame:
    """Rows whose name has the text wanted, without regard to case: equal names
    first (3), then those that start with it (2), then the rest (1)."""
    n, w = F.lower(name), wanted.lower()
    grade = F.when(n == w, 3).when(n.startswith(w), 2).when(F.contains(n, F.lit(w)), 1)
    return df.withColumn("grade", grade).where("grade IS NOT NULL").orderBy(F.desc("grade"), key).limit(limit)


def search_text(df: DataFrame, text: str, wanted: str, key: str, limit: int = 50) -> DataFrame:
    return df.where(F.contains(F.lower(text), F.lit(wanted.lower()))).orderBy(key).limit(limit)


def outline(df: DataFrame, file: str, name: str, order: str, files: list[str]) -> DataFrame:
    """file, order, name: the symbols of the wanted files, in order."""
    return in_list(df, file, files).select(file, order, name).orderBy(file, order, name)


def tree(df: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """dir, n_files: how many distinct files each directory below prefix has,
    itself or below it. Directories are counted as prefixes of the path."""
    p = df.where(F.col(path).startswith(prefix)).select(F.col(path).alias("p")).distinct()
    parts = F.split("p", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return p.where(F.contains("p", F.lit("/"))).select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def churn(df: DataFrame, key: list[str], at: str, days: int) -> DataFrame:
    """key, n, n_recent, per_day: events of all time, and of the last so many
    days before the latest event of the whole table."""
    last = df.agg(F.max(at).alias("tm_last"))
    recent = F.col(at) > F.col("tm_last") - F.expr(f"INTERVAL {int(days)} DAYS")
    g = df.crossJoin(F.broadcast(last)).groupBy(*key).agg(F.count("*").alias("n"), F.count_if(recent).alias("n_recent"))
    return g.withColumn("per_day", F.col("n_recent") / days)


def latest_each(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in order. Spark keeps n per key in each task
    before it shuffles, so frequent keys don't weigh."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= n)


def corrections(df: DataFrame, name: str, wrong: str, limit: int = 5) -> DataFrame:
    """name, distance: the distinct names with the least edit distance."""
    d = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return d.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(wrong.lower()))).orderBy("distance", "name").limit(limit)


def untested(df: DataFrame, file: str, owner: Column, tests: str = "tests/") -> DataFrame:
    """Rows outside tests whose owner no test file has."""
    d = df.withColumn("owner", owner)
    return d.where(~F.col(file).startswith(tests)).join(d.where(F.col(file).startswith(tests)).select("owner").distinct(), "owner", "left_anti")


def hot_spots(df: DataFrame, file: str, size: str, limit: int = 15) -> DataFrame:
    """file, n, bytes, score: number of symbols times the logarithm of bytes."""
    g = df.groupBy(file).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return g.withColumn("score", F.round(F.col("n") * F.ln(1 + F.col("bytes")), 6)).orderBy(F.desc("score"), file).limit(limit)


def owner(name: Column) -> Column:
    """What a dotted name belongs to: the text before the first dot."""
    return F.substring_index(name, ".", 1)
