"""Exact quantiles of groups of any size. Spark's own exact percentile keeps all
distinct values of a group in one task; here they are counted, range-sorted and
found by prefix counts over the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def exact_quantiles(df: DataFrame, *, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys and a column for each of quantiles (name: q), with linear
    interpolation. NULL values are left out, and a group without others is not
    in the result; NaN is above all others. NULL keys are groups. Without keys
    there is one row, or none for an empty table."""
    k = [f"tm_k{i}" for i in range(len(keys))]
    counted = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(value).cast("double").alias("v")).groupBy(*k, "v").agg(F.count("*").alias("n"))
    # the ranges are fixed by writing them: two samplings could cut them differently
    ranges = counted.repartitionByRange(*k, "v").withColumn("part", F.spark_partition_id())
    curve = materialise(ranges.withColumn("upto", F.sum("n").over(Window.partitionBy("part", *k).orderBy("v"))))
    totals = curve.groupBy(*k, "part").agg(F.sum("n").alias("m"))
    before, whole = Window.partitionBy(*k).orderBy("part"), Window.partitionBy(*k)
    totals = totals.withColumns({"base": F.sum("m").over(before) - F.col("m"), "size": F.sum("m").over(whole)}).drop("m")
    at = {name: F.floor((F.col("size") - 1) * F.lit(float(q))) for name, q in quantiles.items()}
    begin, end = F.col("base") + F.col("upto") - F.col("n"), F.col("base") + F.col("upto")
    inside = lambda rank: (begin <= rank) & (rank < end)
    wanted = F.lit(False)
    for a in at.values():
        wanted = wanted | inside(a) | inside(a + 1)
    # as many rows as ranges and groups
    on = [F.col("part") == F.col("tm_part"), *[F.col(c).eqNullSafe(F.col(f"{c}r")) for c in k]]
    picked = curve.join(totals.select(*[F.col(c).alias(f"{c}r") for c in k], F.col("part").alias("tm_part"), "base", "size"), on).where(wanted)
    found = picked.groupBy(*k, "size").agg(*[F.max(F.when(inside(a + j), F.col("v"))).alias(f"{name}_{j}") for name, a in at.items() for j in (0, 1)])

    def value_of(name: str, q: float):
        share = (F.col("size") - 1) * F.lit(float(q)) - at[name]
        lo, hi = F.col(f"{name}_0"), F.col(f"{name}_1")
        return F.when(share == 0, lo).otherwise(lo + (hi - lo) * share).alias(name)

    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, k)], *[value_of(name, q) for name, q in quantiles.items()])
