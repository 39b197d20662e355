"""Column profiles per load: exact counts, distincts, quantiles and
Kolmogorov-Smirnov distances.

The values of all profiled columns are unpivoted and counted per (column, load,
value), which also takes the heat out of frequent values. The counted values are
range-sorted by (column, value); each range hands on its own cumulative counts
and totals, and prefix sums over the ranges turn them into positions in the
whole. No step sees more than one range, or more than one row per range, load
and column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialise

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_CURVE = "col int, load string, part int, kind int, n long, distinct long, upto long, all_upto long, all_before long, prev_upto long, prev_before long, i long, d double, s_low string, s_high string"


#: Loads whose names may pass the driver.
MAX_LOADS = 1_000_000

#: Pairs of successive loads that are broadcast; more are joined as Spark sees fit.
BROADCAST_STEPS = 100_000


@dataclass(frozen=True)
class Check:
    """What counts as wrong in a column: a pattern its text must match in full,
    or bounds its numbers must keep."""

    pattern: str | None = None
    low: float | None = None
    high: float | None = None


@dataclass
class Profile:
    """columns: one row per load and column. quantiles and distances are of the
    numeric columns, text_quantiles and text_distances of all others."""

    columns: DataFrame
    quantiles: DataFrame
    distances: DataFrame
    text_quantiles: DataFrame
    text_distances: DataFrame
    names: list[str] = field(default_factory=list)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType))


def _unpivot(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    parts = []
    for k, c in enumerate(columns):
        kind = df.schema[c].dataType
        i, d, s = (F.lit(None).cast(x) for x in ("long", "double", "string"))
        if isinstance(kind, _INTEGRAL):
            i = F.col(c).cast("long")
        elif _numeric(kind):
            d = F.col(c).cast("double")
        else:
            s = F.col(c).cast("string")
        parts.append(F.struct(F.lit(k).alias("col"), i.alias("i"), d.alias("d"), s.alias("s")))
    return df.select(F.col(load).cast("string").alias("load"), F.inline(F.array(*parts)))


def _walk(batches: Iterator[pa.RecordBatch], before: list[dict]) -> Iterator[pa.RecordBatch]:
    """Cumulative counts within one sorted range, of every column. before: by
    column, the load to compare each load with. Rows that share the last value
    of a batch wait for the next batch, so that equal values stay together;
    there is at most one such row per load."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[tuple, int] = {}  # (column, load): counted so far
    whole: dict[int, int] = {}  # column: counted so far in all loads; None is a load, too
    total: dict[tuple, list] = {}
    held: pa.Table | None = None

    def block(t: pa.Table) -> pa.RecordBatch:
        cols = t.column("col").to_numpy()
        n = t.column("n").to_numpy()
        coded = t.column("load").combine_chunks().dictionary_encode("encode")
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        loads = np.array(names, object)[code]
        i, d, s = t.column("i"), t.column("d"), t.column("s")
        key = [cols, i.fill_null(0).to_numpy(), d.fill_null(0.0).to_numpy(), np.array(pc.fill_null(s, "").to_pylist(), object)]
        new = np.ones(len(cols), bool)
        if len(cols) > 1:
            same = np.logical_and.reduce([(k[1:] == k[:-1]) | ((k[1:] != k[1:]) & (k[:-1] != k[:-1])) for k in key])
            new[1:] = ~same
        at = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        out: dict[str, list] = {k: [] for k in ("col", "load", "n", "upto", "all_upto", "all_before", "prev_upto", "prev_before", "at")}
        for c in np.unique(cols):
            own = np.flatnonzero(cols == c)
            run = np.cumsum(np.where(cols == c, n, 0))
            group_end = np.r_[starts[1:], len(n)] - 1
            all_upto, all_before = whole.get(c, 0) + run[group_end[at]], whole.get(c, 0) + run[starts[at]] - n[starts[at]]
            curves: dict = {}
            codes, held_by = np.unique(code[own]), np.argsort(code[own], kind="stable")
            ends = np.searchsorted(code[own][held_by], codes, "right")
            for x, lo, hi in zip(codes, np.r_[0, ends[:-1]], ends):
                mine, load = own[held_by[lo:hi]], names[x]
                curves[load] = (at[mine], np.cumsum(n[mine]) + seen.get((c, load), 0), mine)
            priors = before[c]
            bases = {load: seen.get((c, priors[load]), 0) if load in priors else 0 for load in curves}
            for load, (spots, upto, mine) in curves.items():
                none = (np.zeros(0, int), np.zeros(0, int), None)
                p_spots, p_upto, _ = curves.get(priors[load], none) if load in priors else none
                p_all = np.r_[bases[load], p_upto]
                out["col"].append(np.full(len(mine), c)), out["load"].append(loads[mine])
                out["n"].append(n[mine]), out["upto"].append(upto)
                out["all_upto"].append(all_upto[mine]), out["all_before"].append(all_before[mine])
                out["prev_upto"].append(p_all[np.searchsorted(p_spots, spots, "right")])
                out["prev_before"].append(p_all[np.searchsorted(p_spots, spots, "left")])
                out["at"].append(mine)
                low, high = s[int(mine[0])].as_py(), s[int(mine[-1])].as_py()
                first_i, last_i, first_d, last_d = i[int(mine[0])].as_py(), i[int(mine[-1])].as_py(), d[int(mine[0])].as_py(), d[int(mine[-1])].as_py()
                t0 = total.setdefault((c, load), [0, 0, first_i, first_d, low, last_i, last_d, high])
                t0[0] += int(n[mine].sum())
                t0[1] += len(mine)
                t0[5:] = [last_i, last_d, high]
                seen[c, load] = int(upto[-1])
            whole[c] = whole.get(c, 0) + int(n[own].sum())
        x = {k: np.concatenate(v) for k, v in out.items()}
        m = len(x["col"])
        return pa.RecordBatch.from_arrays(
            [pa.array(x["col"], pa.int32()), pa.array(x["load"].tolist(), pa.string()), pa.array(np.full(m, part), pa.int32()), pa.array(np.zeros(m), pa.int32()), pa.array(x["n"], pa.int64()), pa.array(np.ones(m), pa.int64())]
            + [pa.array(x[k], pa.int64()) for k in ("upto", "all_upto", "all_before", "prev_upto", "prev_before")]
            + [v.combine_chunks().take(pa.array(x["at"])) for v in (i, d, s)]
            + [pa.nulls(m, pa.string())],
            names=[f.split()[0] for f in _CURVE.split(", ")],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        last = t.slice(t.num_rows - 1).to_pylist()[0]
        cut = t.num_rows - 1
        while cut > 0:
            x = t.slice(cut - 1, 1).to_pylist()[0]
            if any(x[k] != last[k] and not (x[k] != x[k] and last[k] != last[k]) for k in ("col", "i", "d", "s")):
                break
            cut -= 1
        held = t.slice(cut)
        if cut:
            yield block(t.slice(0, cut))
    if held is not None:
        yield block(held)
    for kind, pick in ((1, slice(2, 5)), (2, slice(5, 8))) if total else ():
        k = list(total.items())
        values = [v[pick] for _, v in k]
        zero = pa.array([0] * len(k), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(c) for (c, _), _ in k], pa.int32()), pa.array([x for (_, x), _ in k], pa.string()), pa.array([part] * len(k), pa.int32()), pa.array([kind] * len(k), pa.int32()),
                pa.array([v[0] for _, v in k], pa.int64()), pa.array([v[1] for _, v in k], pa.int64()), zero, zero, zero, zero, zero,
                pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.float64()), pa.array([v[2] for v in values], pa.string()), pa.nulls(len(k), pa.string()),
            ],
            names=[f.split()[0] for f in _CURVE.split(", ")],
        )


def profile(df: DataFrame, *, load: str, columns: list[str], checks: dict[str, Check] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), order: list[str] | None = None, parts: int | None = None) -> Profile:
    """Profile columns for every value of load.

    columns: load_id, column_name, n_rows, n_null, n_wrong, n_distinct,
    min_value, max_value (as text). quantiles: load_id, column_name, q, value,
    with linear interpolation. distances: load_id, column_name, ks_before (to
    the last load before it in order that has a value in the column; NULL for
    the first), ks_rest (to all other loads together; NULL if there are none).
    text_quantiles and text_distances: the same for columns that are no
    numbers, as text in the order of its bytes; a quantile is the least value
    with that share of values up to it. All figures are exact.

    All rows count, repeated ones too. A NULL load is a load of its own. NaN is
    a value, above all others. A column with no value in a load has n_distinct
    0, NULL bounds, and no quantiles or distances. An empty table gives empty
    results. Only the named columns are read, so others cannot clash. order: the
    loads as text, first to last, needed for ks_before (a number of loads that
    the caller bounds; by default their names are collected, which refuses more
    than MAX_LOADS).
    """
    spark = df.sparkSession
    checks = checks or {}
    # which columns have a value, by load: a load without is passed over by ks_before
    loads = df.groupBy(F.col(load).alias("l")).agg(F.array(*[F.count(c) > 0 for c in columns]).alias("has"))
    if order is None:
        found = loads.orderBy("l").limit(MAX_LOADS + 1).select(F.col("l").cast("string"), "has").collect()
        if len(found) > MAX_LOADS:
            raise ValueError("too many loads; give their order, or profile fewer at a time")
    else:
        asked = spark.createDataFrame(list(enumerate(order)), "k long, l2 string")
        found = asked.join(loads, F.col("l2").eqNullSafe(F.col("l").cast("string"))).orderBy("k").select("l2", "has").collect()
    before, known = [], {}
    for k in range(len(columns)):
        with_values = tuple(name for name, has in found if has[k])
        before.append(known.setdefault(with_values, dict(zip(with_values[1:], with_values[:-1]))))
    long = _unpivot(df.select(load, *columns), load, columns)
    wrong = F.lit(False)
    for k, c in enumerate(columns):
        if check := checks.get(c):
            v = F.coalesce(F.col("i").cast("double"), F.col("d"))
            bad = F.lit(False)
            if check.pattern is not None:
                bad = bad | ~F.col("s").rlike(rf"\A(?:{check.pattern})\z")
            if check.low is not None:
                bad = bad | (v < check.low)
            if check.high is not None:
                bad = bad | (v > check.high)
            wrong = F.when(F.col("col") == k, F.coalesce(bad, F.lit(False))).otherwise(wrong)
    counted = long.groupBy("col", "load", "i", "d", "s").agg(F.count("*").alias("n"))
    null = F.col("i").isNull() & F.col("d").isNull() & F.col("s").isNull()
    basics = long.groupBy("col", "load").agg(
        F.count("*").alias("n_rows"), F.count_if(null).alias("n_null"), F.count_if(~null & wrong).alias("n_wrong")
    )
    width = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = counted.where(~null).repartitionByRange(width, "col", "i", "d", "s").sortWithinPartitions("col", "i", "d", "s")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, before)

    curve = materialise(ranges.mapInArrow(walk, _CURVE))
    names = F.array(*[F.lit(c) for c in columns])
    by_range = Window.partitionBy("col", "load").orderBy("part")
    ends = curve.where("kind > 0").withColumns({"tail": F.lag("n", 1, 0).over(Window.partitionBy("col", "load", "kind").orderBy("part"))})
    totals = (
        ends.groupBy("col", "load", "part")
        .agg(F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("kind") == 1, F.col("distinct"))).alias("distinct"),
             F.max(F.when(F.col("kind") == 1, F.struct("i", "d", "s_low"))).alias("low"), F.max(F.when(F.col("kind") == 2, F.struct("i", "d", "s_low"))).alias("high"))
        .withColumn("base", F.sum("n").over(by_range) - F.col("n"))
    )
    sums = totals.groupBy("col", "load").agg(F.sum("n").alias("size"), F.sum("distinct").alias("n_distinct"), F.min_by("low", "part").alias("low"), F.max_by("high", "part").alias("high"))
    text = lambda c: F.coalesce(F.col(f"{c}.s_low"), F.col(f"{c}.i").cast("string"), F.col(f"{c}.d").cast("string"))
    s = sums.select(F.col("col").alias("c2"), F.col("load").alias("l2"), "size", "n_distinct", "low", "high")
    columns_df = basics.join(s, (F.col("col") == F.col("c2")) & F.col("load").eqNullSafe(F.col("l2")), "left").select(
        F.col("load").alias("load_id"), names[F.col("col")].alias("column_name"), "n_rows", "n_null", "n_wrong",
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), text("low").alias("min_value"), text("high").alias("max_value"),
    )

    # positions in the whole: a range's own counts plus what lies in ranges before it
    t = totals.select(F.col("col").alias("c2"), F.col("load").alias("l2"), F.col("part").alias("p2"), "base")
    sized = curve.where("kind = 0").join(t, (F.col("col") == F.col("c2")) & F.col("load").eqNullSafe(F.col("l2")) & (F.col("part") == F.col("p2"))).drop("c2", "l2", "p2")
    sized = sized.join(s.select("c2", "l2", "size"), (F.col("col") == F.col("c2")) & F.col("load").eqNullSafe(F.col("l2"))).drop("c2", "l2")
    value = F.coalesce(F.col("d"), F.col("i").cast("double"))
    begin = F.col("base") + F.col("upto") - F.col("n")
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor((F.col("size") - 1) * F.lit(float(q))).alias("at")) for q in quantiles]))
    ranked = sized.withColumn("w", wanted).select("col", "load", "size", begin.alias("begin"), "n", value.alias("value"), F.col("w.q").alias("q"), F.col("w.at").alias("at"))
    inside = lambda at: (F.col("begin") <= at) & (at < F.col("begin") + F.col("n"))
    after = F.least(F.col("at") + 1, F.col("size") - 1)
    share = (F.col("size") - 1) * F.col("q") - F.col("at")
    numbers = [k for k, c in enumerate(columns) if _numeric(df.schema[c].dataType)]
    is_number = F.col("col").isin(*numbers) if numbers else F.lit(False)
    quantiles_df = (
        ranked.where(is_number).where(inside(F.col("at")) | inside(after))
        .groupBy("col", "load", "q", "size", "at")
        .agg(F.max(F.when(inside(F.col("at")), F.col("value"))).alias("a"), F.max(F.when(inside(after), F.col("value"))).alias("b"))
        .select(F.col("load").alias("load_id"), names[F.col("col")].alias("column_name"), "q", F.when(share == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * share).alias("value"))
    )

    least = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.ceil(F.col("size") * F.lit(float(q))) - 1, F.lit(0)).alias("at")) for q in quantiles]))
    ranked_text = sized.where(~is_number).withColumn("w", least).select("col", "load", begin.alias("begin"), "n", F.col("s_low").alias("value"), F.col("w.q").alias("q"), F.col("w.at").alias("at"))
    text_quantiles = ranked_text.where(inside(F.col("at"))).select(F.col("load").alias("load_id"), names[F.col("col")].alias("column_name"), "q", "value")

    # distances: at each value of a load, its own curve against the others', before and after the step
    all_base = totals.groupBy("col", "part").agg(F.sum("n").alias("n")).withColumn("all_base", F.sum("n").over(Window.partitionBy("col").orderBy("part")) - F.col("n"))
    all_size = sums.groupBy(F.col("col").alias("c2")).agg(F.sum("size").alias("all_size"))
    steps = [(k, b, a, True) for k, own in enumerate(before) for b, a in own.items()]
    prev = spark.createDataFrame(steps, "c4 int, l4 string, prev string, has_prev boolean")
    prev = F.broadcast(prev) if len(steps) <= BROADCAST_STEPS else prev
    # a load may have nothing in a range: its base there is what all ranges before hold
    grid = all_base.select("col", "part").join(sums.select(F.col("col").alias("c2"), "load"), F.col("col") == F.col("c2")).drop("c2")
    grid = grid.join(totals.select(F.col("col").alias("c2"), F.col("load").alias("l2"), F.col("part").alias("p2"), "n"), (F.col("col") == F.col("c2")) & F.col("load").eqNullSafe(F.col("l2")) & (F.col("part") == F.col("p2")), "left")
    grid = grid.withColumn("prev_base", F.coalesce(F.sum("n").over(by_range) - F.coalesce("n", F.lit(0)), F.lit(0))).select(F.col("col").alias("c3"), F.col("load").alias("l3"), F.col("part").alias("p3"), "prev_base")
    c = sized.join(prev, (F.col("col") == F.col("c4")) & F.col("load").eqNullSafe(F.col("l4")), "left").drop("c4", "l4")
    c = c.join(all_base.select(F.col("col").alias("c2"), F.col("part").alias("p2"), "all_base"), (F.col("col") == F.col("c2")) & (F.col("part") == F.col("p2"))).drop("c2", "p2")
    c = c.join(all_size, F.col("col") == F.col("c2")).drop("c2")
    c = c.join(grid, (F.col("col") == F.col("c3")) & (F.col("part") == F.col("p3")) & F.col("prev").eqNullSafe(F.col("l3")), "left").drop("c3", "p3", "l3")
    c = c.join(sums.select(F.col("col").alias("c2"), F.col("load").alias("l2"), F.col("size").alias("prev_size")), (F.col("col") == F.col("c2")) & F.col("prev").eqNullSafe(F.col("l2")), "left")
    own = [(F.col("base") + F.col("upto")) / F.col("size"), (F.col("base") + F.col("upto") - F.col("n")) / F.col("size")]
    pre = [(F.col("prev_base") + F.col("prev_upto")) / F.col("prev_size"), (F.col("prev_base") + F.col("prev_before")) / F.col("prev_size")]
    pooled = [(F.col("all_base") + F.col("all_upto")) / F.col("all_size"), (F.col("all_base") + F.col("all_before")) / F.col("all_size")]
    # F_all = share*F_own + (1-share)*F_rest, so the distance to the rest is that to all, stretched
    stretch = F.when(F.col("all_size") > F.col("size"), F.col("all_size") / (F.col("all_size") - F.col("size")))
    distances = c.groupBy("col", "load").agg(
        F.max(F.when(F.col("has_prev"), F.greatest(*[F.abs(a - b) for a, b in zip(own, pre)]))).alias("ks_before"),
        F.max(F.greatest(*[F.abs(a - b) for a, b in zip(own, pooled)]) * stretch).alias("ks_rest"),
    )
    shown = [F.col("load").alias("load_id"), names[F.col("col")].alias("column_name"), "ks_before", "ks_rest"]
    return Profile(columns_df, quantiles_df, distances.where(is_number).select(*shown), text_quantiles, distances.where(~is_number).select(*shown), list(columns))


def departures(p: Profile, *, null_rate: float = 0.20, pattern: float = 0.12, out_of_range: float = 0.05, distinct: float = 0.2, times: float = 8.0, pattern_columns: tuple[str, ...] = (), range_columns: tuple[str, ...] = (), distinct_columns: tuple[str, ...] = (), median_columns: tuple[str, ...] = ()) -> DataFrame:
    """(load_id, column_name, check_name) where a load departs from the usual,
    which is the median over all loads. A load without values has no rate of
    wrong values and no median; it can only depart by null_rate and distinct.
    The per-load figures are one row per load and column, so the median over
    loads is taken by a plain aggregate."""
    c = p.columns.withColumns({"rate": F.col("n_null") / F.col("n_rows"), "wrong": F.when(F.col("n_rows") > F.col("n_null"), F.col("n_wrong") / (F.col("n_rows") - F.col("n_null")))})
    m = p.quantiles.where("q = 0.5").select(F.col("load_id").alias("l2"), F.col("column_name").alias("c2"), F.col("value").alias("mid"))
    c = c.join(m, F.col("load_id").eqNullSafe(F.col("l2")) & (F.col("column_name") == F.col("c2")), "left").drop("l2", "c2")
    usual = c.groupBy(F.col("column_name").alias("c3")).agg(F.median("rate").alias("u_rate"), F.median("n_distinct").alias("u_distinct"), F.median("mid").alias("u_mid"))
    c = c.join(usual, F.col("column_name") == F.col("c3"))
    of = lambda names: F.col("column_name").isin(*names) if names else F.lit(False)
    found = [
        ("null_rate", F.col("rate") - F.col("u_rate") > null_rate),
        ("pattern", of(pattern_columns) & (F.col("wrong") > pattern)),
        ("range", of(range_columns) & (F.col("wrong") > out_of_range)),
        ("distinct", of(distinct_columns) & (F.col("n_distinct") < distinct * F.col("u_distinct"))),
        ("distribution", of(median_columns) & (F.col("u_mid") > 0) & ((F.col("mid") >= times * F.col("u_mid")) | (F.col("mid") <= F.col("u_mid") / times))),
    ]
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in found]))
    return c.select("load_id", "column_name", F.explode(names).alias("check_name"))
