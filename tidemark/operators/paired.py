"""Paired A/B measurements: pivots, ratios, separation, shares, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles


def pairs(df: DataFrame, *, keys: list[str], mode: str, value: str, baseline: str, candidate: str, strict: bool = False) -> DataFrame:
    """keys, base, cand: one row per key that has exactly one row of either
    mode; other modes don't count. The pivot is a conditional aggregate, one
    shuffle for both sides. With strict, any other key is an error; else it is
    skipped. Rows with a NULL value are as good as absent. NULL keys pair."""
    of = lambda m: F.when(F.col(mode) == m, F.col(value))
    g = df.where(F.col(mode).isin(baseline, candidate)).groupBy(*keys).agg(
        F.count(of(baseline)).alias("tm_nb"), F.count(of(candidate)).alias("tm_nc"), F.max(of(baseline)).alias("base"), F.max(of(candidate)).alias("cand")
    )
    complete = (F.col("tm_nb") == 1) & (F.col("tm_nc") == 1)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not exactly one pair at "), F.to_json(F.struct(*keys))))
        return g.withColumn("base", F.when(complete, F.col("base")).otherwise(bad.cast("double"))).drop("tm_nb", "tm_nc")
    return g.where(complete).drop("tm_nb", "tm_nc")


def ratio() -> Column:
    return F.when(F.col("cand") > 0, F.col("base") / F.col("cand"))


def geomean(c: Column) -> Column:
    """Of the positive values; NULL where there are none."""
    return F.exp(F.avg(F.when(c > 0, F.ln(c))))


def summary(p: DataFrame, by: list[str], saved_at_least: float = 10.0, percent_at_least: float = 10.0) -> DataFrame:
    """by and sums, both kinds of ratio, and wins that matter: saved at least so
    many units and at least so many percent. Median and 95th percentile are
    exact, whatever the size of a group; the median is 0 for no pair."""
    saved = F.col("base") - F.col("cand")
    pct = F.when(F.col("base") > 0, 100 * saved / F.col("base"))
    win = (saved >= saved_at_least) & (pct >= percent_at_least)
    d = p.withColumn("tm_ratio", ratio())
    plain = d.groupBy(*by).agg(
        F.count("base").alias("n_pairs"), F.sum("base").alias("base_total"), F.sum("cand").alias("cand_total"), (F.sum("base") / F.sum("cand")).alias("ratio_of_sums"),
        geomean(F.col("tm_ratio")).alias("geomean_ratio"), F.count_if(win).alias("meaningful_wins"), F.count_if(F.col("base").isNotNull() & ~F.coalesce(win, F.lit(False))).alias("negligible"), F.count_if(saved < 0).alias("slower"),
    )
    q = exact_quantiles(d, keys=by, value="tm_ratio", quantiles={"median_ratio": 0.5, "p95_ratio": 0.95})
    if by:
        r = q.toDF(*[f"tm_k{i}" for i in range(len(by))], "median_ratio", "p95_ratio")
        joined = plain.join(r, [F.col(k).eqNullSafe(F.col(f"tm_k{i}")) for i, k in enumerate(by)], "left").drop(*[f"tm_k{i}" for i in range(len(by))])
    else:
        joined = plain.join(F.broadcast(q), F.lit(True), "left")  # one row each
    return joined.withColumn("median_ratio", F.coalesce("median_ratio", F.lit(0.0)))


def report(p: DataFrame, levels: list[list[str]]) -> DataFrame:
    """The summary at several levels, as one table; a column that a level isn't
    grouped by is NULL there. Pairs are expanded to the levels once, so all
    levels share one aggregate and one sort. A level without columns has a row
    even for no pair at all."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    sets = F.array(*[F.struct(F.lit(i).alias("tm_level"), *[(F.col(c) if c in level else F.lit(None).cast(p.schema[c].dataType)).alias(c) for c in names]) for i, level in enumerate(levels)])
    wide = p.select("base", "cand", F.explode(sets).alias("tm_x")).select("base", "cand", "tm_x.*")
    whole = [i for i, level in enumerate(levels) if not level]
    if whole:  # no pair, but a row to count none in
        wide = wide.unionByName(p.sparkSession.createDataFrame([(i,) for i in whole], "tm_level int"), allowMissingColumns=True)
    return summary(wide, ["tm_level", *names]).drop("tm_level")


def separation(df: DataFrame, *, keys: list[str], mode: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """keys, separated, direction: whether the ranges of the two modes don't
    touch. A key without either mode is left out."""
    of = lambda f, m: f(F.when(F.col(mode) == m, F.col(value)))
    g = df.where(F.col(mode).isin(baseline, candidate)).groupBy(*keys).agg(
        of(F.min, baseline).alias("b_min"), of(F.max, baseline).alias("b_max"), of(F.min, candidate).alias("c_min"), of(F.max, candidate).alias("c_max")
    ).where("b_min IS NOT NULL AND c_min IS NOT NULL")
    gain, loss = F.col("c_max") < F.col("b_min"), F.col("b_max") < F.col("c_min")
    return g.withColumns({"separated": gain | loss, "direction": F.when(gain, "gain").when(loss, "regression").otherwise("none")})


def savings_share(p: DataFrame, *, by: str, top: int = 3) -> DataFrame:
    """by, saved, rank, share, top_share: each one's share of all that is saved,
    and the share of the first top. Groups are few (one row each), so ranking
    them in one place is cheap."""
    s = p.groupBy(by).agg(F.sum(F.col("base") - F.col("cand")).alias("saved"))
    w, every = Window.orderBy(F.col("saved").desc(), by), Window.partitionBy()
    return s.withColumns({"rank": F.row_number().over(w), "share": F.col("saved") / F.sum("saved").over(every)}).withColumn("top_share", F.sum(F.when(F.col("rank") <= top, F.col("share"))).over(every))


def parity(df: DataFrame, *, keys: list[str], hashed: str) -> DataFrame:
    """keys, n, n_hashes, parity: one hash per group means that all answers are
    equal. NULL hashes count as one more hash."""
    n = F.count_distinct(hashed) + F.max(F.col(hashed).isNull().cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), n.alias("n_hashes")).withColumn("parity", F.col("n_hashes") == 1)


def order_balance(df: DataFrame, *, mode: str, position: str, tolerance: int = 1) -> DataFrame:
    """mode, spread, balanced: how evenly the modes take turns at each place.
    Missing cells of the grid count as 0."""
    cells = df.groupBy(mode, position).agg(F.count("*").alias("n"))
    n_positions = df.agg(F.count_distinct(position).alias("k"))
    g = cells.groupBy(mode).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("have")).crossJoin(F.broadcast(n_positions))
    spread = F.col("hi") - F.when(F.col("have") == F.col("k"), F.col("lo")).otherwise(0)
    return g.select(mode, spread.alias("spread"), (spread <= tolerance).alias("balanced"))


def verdict(parity_ok: Column, breadth: Column, genuine: Column, speedup: Column, *, accept: float = 0.10, design: float = 0.25, genuine_fail: float = 0.005, speed: float = 5.0) -> Column:
    """The gate, in order: fail, design answer required, pass."""
    return (
        F.when(~parity_ok, "fail").when(genuine > genuine_fail, "fail").when(breadth > design, "fail").when(breadth > accept, "design_answer_required")
        .when(speedup < speed, "design_answer_required").otherwise("pass")
    )
