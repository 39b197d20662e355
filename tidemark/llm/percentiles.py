"""Percentiles of very large numeric columns, from signed logarithmic buckets.

A value falls into the bucket of its sign and of the power of gamma just above
its size; gamma = (1 + a) / (1 - a) makes every value of a bucket lie within the
relative error a of the bucket's middle. A sketch is a table of bucket counts;
sketches of parts, loads or days combine by adding the counts of equal buckets,
in any order and with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Values nearer to zero than this are counted as zero.
TINY = 1e-300
#: Each refinement splits the interval that holds a rank into so many parts.
SPLIT = 4096


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """(sign, index): a struct that orders as the values do. Infinite values
    have buckets of their own at the ends; NULL and NaN have none."""
    size = F.abs(value)
    index = F.ceil(F.ln(size) / math.log(gamma(error))).cast("int")
    sign = F.when(size <= TINY, 0).when(value > 0, 1).otherwise(-1)
    # negative values: the larger the size, the earlier in order
    idx = F.when(sign == 0, 0).when(size == float("inf"), sign * 2_000_000_000).otherwise(sign * index)
    return F.when(value.isNotNull() & ~F.isnan(value), F.struct(sign.alias("sign"), idx.alias("idx")))


def middle(sign: Column, idx: Column, error: float) -> Column:
    """The value that a bucket stands for."""
    g = gamma(error)
    size = F.pow(F.lit(g), F.abs(idx).cast("double") * F.signum(sign * idx)) * (2 / (1 + g))
    return F.when(sign == 0, 0.0).when(F.abs(idx) >= 2_000_000_000, sign * float("inf")).otherwise(sign * size)


def sketch(df: DataFrame, *, groups: list[str], metrics: list[str], error: float = 0.005) -> DataFrame:
    """Bucket counts: groups, metric, sign, idx, n.

    NULL and NaN are left out; a group without any other value has no rows. A
    NULL in a group column is a group. Counts are added up in each task before
    they are shuffled, so a group that holds most rows costs no more than one
    row per bucket and task. Only the named columns are read.
    """
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m).cast("double"), error).alias("b")) for m in metrics])
    rows = df.select(*groups, F.explode(parts).alias("tm_x")).where("tm_x.b IS NOT NULL")
    return rows.groupBy(*groups, F.col("tm_x.metric").alias("metric"), F.col("tm_x.b.sign").alias("sign"), F.col("tm_x.b.idx").alias("idx")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *, groups: list[str]) -> DataFrame:
    """Combine sketches into those of fewer groups."""
    return sketches.groupBy(*groups, "metric", "sign", "idx").agg(F.sum("n").alias("n"))


def _ranks(merged: DataFrame, groups: list[str], quantiles: list[float]) -> DataFrame:
    """For each group, metric and q the buckets of the two order statistics
    between which it interpolates, with the count below each. A group has as
    many rows here as it has buckets: at error a, no more than about
    1400 / a for each sign, whatever the number of values."""
    w = Window.partitionBy(*groups, "metric").orderBy("sign", "idx")
    total = Window.partitionBy(*groups, "metric")
    c = merged.withColumns({"upto": F.sum("n").over(w), "size": F.sum("n").over(total)}).withColumn("below", F.col("upto") - F.col("n"))
    pos = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor((F.col("size") - 1) * q).alias("lo"), F.least(F.floor((F.col("size") - 1) * q) + 1, F.col("size") - 1).alias("hi"), ((F.col("size") - 1) * q).alias("at")) for q in quantiles]))
    c = c.withColumn("tm_p", pos).select("*", "tm_p.*").drop("tm_p")
    return c.where((F.col("lo").between(F.col("below"), F.col("upto") - 1)) | (F.col("hi").between(F.col("below"), F.col("upto") - 1)))


def percentiles(sketches: DataFrame, *, groups: list[str], quantiles: list[float], error: float = 0.005) -> DataFrame:
    """groups, metric, q, n, value, low, high: the percentile by linear
    interpolation, within the relative error of the exact one (each of the two
    order statistics is; they interpolate linearly), and bounds that hold the
    exact one for certain. The error must be the one the sketches were made
    with."""
    r = _ranks(merge(sketches, groups=groups), groups, quantiles)
    at_lo, at_hi = F.col("lo").between(F.col("below"), F.col("upto") - 1), F.col("hi").between(F.col("below"), F.col("upto") - 1)
    m = middle(F.col("sign"), F.col("idx"), error)
    g = gamma(error)
    # a bucket's ends, widened by a rounding of the logarithm
    ends = [m * (1 + g) / (2 * x) for x in (g * (1 + 1e-9), (1 - 1e-9))]
    low, high = F.when(F.col("sign") > 0, ends[0]).otherwise(ends[1]), F.when(F.col("sign") > 0, ends[1]).otherwise(ends[0])
    pick = lambda c, cond: F.max(F.when(cond, c))
    a = r.groupBy(*groups, "metric", "q", "size", "at", "lo").agg(*[pick(c, cond).alias(f"{n}_{k}") for n, c in (("mid", m), ("low", low), ("high", high)) for k, cond in (("lo", at_lo), ("hi", at_hi))])
    share = F.col("at") - F.col("lo")
    mix = lambda n: F.when((share == 0) | (F.col(f"{n}_lo") == F.col(f"{n}_hi")), F.col(f"{n}_lo")).otherwise(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * share)
    return a.select(*groups, "metric", "q", F.col("size").alias("n"), mix("mid").alias("value"), mix("low").alias("low"), mix("high").alias("high"))


def exact(df: DataFrame, sketches: DataFrame, *, groups: list[str], metric: str, quantiles: list[float], error: float = 0.005) -> DataFrame:
    """Exact percentiles of the groups in sketches: groups, q, value.

    Takes from the sketch the buckets that hold the wanted order statistics, and
    reads only those values again. Their intervals are cut into SPLIT parts over
    and over, by counts added up in each task, until each holds one value; four
    rounds are enough for any double. No group of values is ever brought
    together. The number of rounds is fixed, so no count has to be waited for.
    """
    on = lambda a, b: F.lit(True) if not groups else [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    r = _ranks(merge(sketches, groups=groups).where(F.col("metric") == metric), groups, quantiles)
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("end"), F.col(k).alias("rank")) for k in ("lo", "hi")]))
    want = r.withColumn("tm_w", which).select("*", "tm_w.*").where(F.col("rank").between(F.col("below"), F.col("upto") - 1))
    want = want.select(*groups, "q", "end", F.col("at") - F.col("lo"), "sign", "idx", (F.col("rank") - F.col("below")).alias("rank")).toDF(*groups, "q", "end", "share", "sign", "idx", "rank")
    want = materialise(want)
    v = F.col(metric).cast("double")
    values = df.select(*groups, v.alias("v"), bucket(v, error).alias("b")).where("b IS NOT NULL")
    values = values.select(*groups, F.col("b.sign").alias("sign"), F.col("b.idx").alias("idx"), "v")
    keys = [*groups, "sign", "idx"]
    needed = want.select(*keys).distinct()
    join = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    near = values.alias("a").join(needed.alias("b"), join("a", "b", keys), "left_semi")
    counted = materialise(near.groupBy(*keys, "v").agg(F.count("*").alias("n")))
    ids = ["q", "end"]
    state = counted.alias("a").join(want.alias("b"), join("a", "b", keys)).select(*[F.col(f"a.{g}").alias(g) for g in groups], *[F.col(f"b.{c}").alias(c) for c in (*ids, "share", "rank")], F.col("a.v").alias("v"), F.col("a.n").alias("n"))
    for _ in range(4):
        ends = state.groupBy(*groups, *ids).agg(F.min("v").alias("from"), F.max("v").alias("to"))
        s = state.alias("a").join(ends.alias("b"), join("a", "b", [*groups, *ids])).select("a.*", "b.from", "b.to")
        part = F.when(F.col("to") > F.col("from"), F.least(F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * SPLIT), F.lit(SPLIT - 1))).otherwise(0)
        s = s.withColumn("part", part).drop("from", "to")
        w = Window.partitionBy(*groups, *ids).orderBy("part")
        tops = s.groupBy(*groups, *ids, "part").agg(F.sum("n").alias("m"), F.first("rank").alias("rank")).withColumn("upto", F.sum("m").over(w))
        tops = tops.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m"))).select(*groups, *ids, "part", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank2"))
        state = materialise(s.alias("a").join(tops.alias("b"), join("a", "b", [*groups, *ids, "part"])).select(*[F.col(f"a.{c}").alias(c) for c in (*groups, *ids, "share")], F.col("b.rank2").alias("rank"), F.col("a.v").alias("v"), F.col("a.n").alias("n")))
    one = state.groupBy(*groups, "q", "share").agg(F.max(F.when(F.col("end") == "lo", F.col("v"))).alias("a"), F.max(F.when(F.col("end") == "hi", F.col("v"))).alias("b"))
    return one.select(*groups, "q", F.when((F.col("share") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def calls(df: DataFrame, *, key: str, keep: list[str], metrics: list[str], day: str | None = None) -> DataFrame:
    """Each measurement once. Copies agree in all that is kept, so the greatest
    of each metric is that of any copy; the day a call was recorded is the same
    in all its copies, while its load isn't, so sketches of days can be combined
    without counting a call twice."""
    cols = [F.col(c) for c in keep] + ([F.to_date(day).alias("day")] if day else [])
    names = [*keep, *(["day"] if day else [])]
    return df.select(F.col(key).alias("tm_key"), *cols, *metrics).groupBy("tm_key", *names).agg(*[F.max(m).alias(m) for m in metrics]).drop("tm_key")
