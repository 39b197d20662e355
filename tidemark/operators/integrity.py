"""Completeness, claims, redaction and audits."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def expect_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df if it has exactly these columns, else an error that names the missing
    and the unknown ones."""
    missing, unknown = sorted(set(names) - set(df.columns)), sorted(set(df.columns) - set(names))
    if missing or unknown:
        raise ValueError(f"missing columns {missing}, unknown columns {unknown}")
    return df


#: A grid of axes has at most so many cells.
MAX_CELLS = 10_000_000


def missing_cells(df: DataFrame, axes: list[str], most: int = MAX_CELLS) -> DataFrame:
    """Combinations of the axes' values that have no row. The grid is a matter
    of configuration, not of the number of rows: its size is worked out first,
    and a grid of more than most cells is an error. So every axis is small
    enough to be sent to all tasks. NULL is no value of an axis."""
    seen = materialise(df.select(*axes).distinct())
    sizes = seen.agg(*[F.count_distinct(a).alias(f"n{i}") for i, a in enumerate(axes)]).first()
    if math.prod(sizes) > most:
        raise ValueError(f"a grid of {math.prod(sizes)} cells; axes have to be few values each")
    grid = None
    for a in axes:
        v = seen.where(F.col(a).isNotNull()).select(a).distinct()
        grid = v if grid is None else grid.join(F.broadcast(v))
    return grid.join(seen, axes, "left_anti")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def claims_in(df: DataFrame, text: str) -> DataFrame:
    """key, value for every marker <!-- claim:key=value --> in a text."""
    pattern = r"<!--\s*claim:([A-Za-z0-9_.]+)=([^>]*?)\s*-->"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    return df.select(F.explode(both).alias("c")).select("c.key", "c.value")


def reconcile(computed: DataFrame, stated: DataFrame) -> DataFrame:
    """key, computed, stated for claims that don't agree to the letter, or that
    one side lacks."""
    c, s = computed.select("key", F.col("value").alias("computed")), stated.select("key", F.col("value").alias("stated"))
    return c.join(s, "key", "full_outer").where(~F.col("computed").eqNullSafe(F.col("stated")))


def marker_scan(df: DataFrame, markers: list[str], allowed: dict[str, str] | None = None) -> DataFrame:
    """column, marker, hits: text columns that hold a marker. allowed: column to
    a condition under which a hit is tolerated. All columns and markers are
    counted in one pass."""
    texts = [c for c, t in df.dtypes if t == "string"]
    allowed = allowed or {}
    if not texts or not markers:
        return df.sparkSession.createDataFrame([], "`column` string, marker string, hits bigint")
    cells = [(c, m, F.count_if((F.instr(F.col(c), m) > 0) & ~(F.coalesce(F.expr(allowed[c]), F.lit(False)) if c in allowed else F.lit(False)))) for c in texts for m in markers]
    one = df.agg(*[e.alias(f"x{i}") for i, (_, _, e) in enumerate(cells)])
    out = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("marker"), F.col(f"x{i}").alias("hits")) for i, (c, m, _) in enumerate(cells)]))
    return one.select(out).where("hits > 0")


def marker_audit(tables: dict[str, DataFrame], markers: list[str], allowed: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """table_name, column, marker, hits over several tables, each read once;
    allowed: per table the conditions of marker_scan()."""
    out = None
    for name, df in tables.items():
        one = marker_scan(df, markers, (allowed or {}).get(name)).select(F.lit(name).alias("table_name"), "column", "marker", "hits")
        out = one if out is None else out.unionByName(one)
    return out


def table_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, n_null of several tables: rows, columns and
    NULL cells, each table read once."""
    out = None
    for name, df in tables.items():
        nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0).cast("long"))
        one = df.agg(F.count("*").alias("n_rows"), nulls.alias("n_null")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_null")
        out = one if out is None else out.unionByName(one)
    return out


def redact(df: DataFrame, replace: dict[str, str], constants: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(redacted, changes): text replaced in all text columns, some columns set
    to a constant; changes has the number of rows changed by column."""
    constants = constants or {}
    texts = [c for c, t in df.dtypes if t == "string"]

    def new(c: str):
        if c in constants:
            return F.when(F.col(c).isNotNull(), F.lit(constants[c]))
        e = F.col(c)
        for a, b in replace.items():
            e = F.replace(e, F.lit(a), F.lit(b))
        return e

    counts = df.agg(*[F.count_if(~new(c).eqNullSafe(F.col(c))).alias(c) for c in texts])
    changed = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_changed")) for c in texts])))
    return df.withColumns({c: new(c) for c in texts}), changed


def clipped_first(df: DataFrame, paths: str) -> DataFrame:
    """df with clipped: whether the first of a JSON list of paths begins with a
    folder that isn't known, but is when a letter is put in front. Known are the
    folders with which later paths of any row begin; they are few, counted in
    each task first. Text that is no such list is not clipped."""
    d = df.withColumn("tm_p", F.from_json(paths, "array<string>"))
    head = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    known = d.select(F.explode(F.slice("tm_p", 2, F.greatest(F.size("tm_p"), F.lit(1)))).alias("x")).select(head(F.col("x")).alias("tm_h")).where("tm_h IS NOT NULL").distinct()
    known = materialise(known)
    first = d.withColumn("tm_h", head(F.get("tm_p", F.lit(0))))
    short = known.where("length(tm_h) > 1").select(F.substring("tm_h", 2, 1_000_000).alias("tm_h"), F.lit(True).alias("tm_short")).distinct()
    j = first.join(known.withColumn("tm_known", F.lit(True)), "tm_h", "left").join(short, "tm_h", "left")
    return j.select(*df.columns, (F.col("tm_known").isNull() & F.col("tm_short").isNotNull()).alias("clipped"))


ABSOLUTE_PATH = r"(?<![A-Za-z0-9:/.])(?:/(?:home|Users|root|tmp)/|[A-Za-z]:\\)"


def absolute_paths(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).rlike(ABSOLUTE_PATH))


def audit_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: vectors, NULL ones, least and greatest length, wrong lengths."""
    n = F.size(vector)
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col(vector).isNull()).alias("n_null"), F.min(F.when(F.col(vector).isNotNull(), n)).alias("min_length"),
        F.max(F.when(F.col(vector).isNotNull(), n)).alias("max_length"), F.count_if(F.col(vector).isNotNull() & (n != dim)).alias("n_wrong"),
    )


def valid_member(name: str) -> bool:
    return bool(name) and not name.startswith("/") and ".." not in re.split(r"[/\\]", name)
