"""Running values and as-of joins that hold up when one key has most rows: keys
are cut into pieces along the order, each piece is worked out by itself, and the
pieces' own results are carried forward, one row per piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]


def running_max(df: DataFrame, *, keys: list[str], piece: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """df with the greatest value so far along order. piece must not decrease
    along order, and is what bounds the rows that meet in a task. NULL values
    are passed over; before the first value the result is NULL. Rows that are
    equal in order see each other's values, as they come in no order."""
    d = df.withColumns({"tm_piece": piece, "tm_value": value})
    within = Window.partitionBy(*keys, "tm_piece").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0) if len(order) == 1 else Window.partitionBy(*keys, "tm_piece").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("tm_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = d.groupBy(*keys, "tm_piece").agg(F.max("tm_value").alias("tm_top")).withColumn("tm_carried", F.max("tm_top").over(before)).drop("tm_top")
    all_keys = [*keys, "tm_piece"]
    j = d.withColumn("tm_so_far", F.max("tm_value").over(within)).alias("l").join(carried.alias("r"), _same(all_keys), "left")
    return j.select(*[F.col(f"l.{c}") for c in df.columns], F.greatest("l.tm_so_far", "r.tm_carried").alias(out))


def as_of(left: DataFrame, right: DataFrame, *, key: str, at: str, carry: str, piece: str = "day", out: str = "matched") -> DataFrame:
    """left with the carried column of the latest row of right that has the same
    key and is not later; of rows at one time the greatest value. left and right
    need the columns key and at. NULL keys match none, and neither do NULL
    times."""
    a = left.select("*").withColumns({"tm_side": F.lit(0), "tm_c": F.lit(None).cast(right.schema[carry].dataType)})
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.col(carry).alias("tm_c"), F.lit(1).alias("tm_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = F.when(F.col("tm_side") == 1, F.struct(F.col(at), F.col("tm_c")))
    r = running_max(both, keys=[key], piece=F.date_trunc(piece, at), order=[at], value=seen, out="tm_m")
    hit = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("tm_m")["tm_c"])
    return r.where("tm_side = 0").select(*left.columns, hit.alias(out))
