"""Selective reads over a small relational model: points, lists, prefixes,
two phases, overlays, samples. All push their filters into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.session import materialise


def nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """An empty list matches nothing. Longer lists than 1,000 go in as a join,
    which Spark broadcasts if they are small."""
    if not values:
        return df.where(F.lit(False))
    if len(values) <= 1_000:
        return df.where(F.col(column).isin(*values))
    kind = df.schema[column].dataType
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind.simpleString()}")
    return df.join(known, column, "left_semi")


def same_text(column: str, value: str) -> Column:
    """Equal without regard to case."""
    return F.lower(column) == value.lower()


def like_prefix(prefix: str) -> str:
    return prefix.replace("%", r"\%").replace("_", r"\_") + "%"


def prefix_scan(df: DataFrame, column: str, prefix: str, ignore_case: bool = True) -> DataFrame:
    """Rows whose text starts with prefix; by default without regard to ASCII
    case, which can't be pushed into the scan, while the other way is."""
    return df.where(F.col(column).ilike(like_prefix(prefix))) if ignore_case else df.where(F.col(column).startswith(prefix))


def key_values(df: DataFrame, key: str, value: str, like: str | None = None) -> DataFrame:
    """A key-value table as one map, keys in order. Of a repeated key the
    greatest value stands. Meant for small tables: the map is one row."""
    d = df.where(F.col(key).like(like)) if like else df
    d = d.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("tm_v"))
    return d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("tm_v").alias("v"))))).alias("pairs"))


def two_phase(rows: DataFrame, row_key: str, lookups: DataFrame, lookup_key: str) -> DataFrame:
    """Rows whose key is among the keys that a first read found."""
    found = lookups.select(F.col(lookup_key).alias("tm_k")).distinct()
    return rows.join(found, F.col(row_key) == F.col("tm_k"), "left_semi")


def stride_positions(length: int, count: int) -> list[int]:
    """Evenly spread positions from first to last; the middle one for a count
    of 1. Halves are rounded to even."""
    if length < count:
        raise ValueError("fewer rows than positions")
    return [length // 2] if count == 1 else [round(i * (length - 1) / (count - 1)) for i in range(count)]


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Positions from 0 in a total order, without bringing all rows to one task:
    range-sorted parts are counted, and each row gets its part's offset. The
    counts are one row per part."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("tm_part", F.spark_partition_id()).withColumn("tm_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    part = materialise(part)
    sizes = part.groupBy("tm_part").agg(F.count("*").alias("tm_n"))
    offset = sizes.withColumn("tm_o", F.sum("tm_n").over(Window.orderBy("tm_part")) - F.col("tm_n")).select("tm_part", "tm_o")
    return part.join(offset, "tm_part").withColumn("position", F.col("tm_o") + F.col("tm_i")).drop("tm_part", "tm_i", "tm_o")


def stride_sample(df: DataFrame, order: list[str], count: int) -> DataFrame:
    n = numbered(df, order)
    at = stride_positions(df.count(), count)
    return n.where(F.col("position").isin(*at))


def wraparound(df: DataFrame, order: list[str], starts: list[int], size: int = 3) -> DataFrame:
    """start, step and row for batches of size rows that begin at each start and
    go on from the first row after the last."""
    n = df.count()
    want = [(s, j, (s + j) % n) for s in starts for j in range(size)] if n else []
    w = df.sparkSession.createDataFrame(want, "start int, step int, position long")
    return numbered(df, order).join(F.broadcast(w), "position")


def overlay(base: DataFrame, delta: DataFrame, *, key: str, action: str, order: str | None = None) -> DataFrame:
    """base without the keys that delta touches, plus delta's added and modified
    rows. A NULL key in delta touches nothing. order: a column of delta; then a
    column tm_at is added by which base's rows come first and delta's follow in
    that order."""
    kept = base.join(delta.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    new = delta.where(F.col(action).isin("add", "modify"))
    if order is None:
        return kept.unionByName(new.select(*base.columns))
    return kept.withColumn("tm_at", F.lit(None).cast(delta.schema[order].dataType)).unionByName(new.select(*base.columns, F.col(order).alias("tm_at")))


def upsert(first: DataFrame, second: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """All rows by key; a key in both has the row of second. Keys must be unique
    in either; NULL is a key. position: a column that gives each row its place;
    a key in both keeps its place in first, and keys of second alone come after
    all of first, by their own."""
    same = F.col("l.tm_key").eqNullSafe(F.col("r.tm_key"))
    if position is None:
        a, b = first.withColumn("tm_key", F.col(key)), second.select(F.col(key).alias("tm_key"))
        return a.alias("l").join(b.alias("r"), same, "left_anti").select(*first.columns).unionByName(second)
    rest = [c for c in first.columns if c not in (key, position)]
    a = first.select(F.col(key).alias("tm_key"), F.col(position).alias("tm_a"), F.struct(*rest).alias("tm_one"))
    b = second.select(F.col(key).alias("tm_key"), F.col(position).alias("tm_b"), F.struct(*rest).alias("tm_two"), F.lit(True).alias("tm_new"))
    both = a.alias("l").join(b.alias("r"), same, "full_outer")
    row = F.when(F.col("tm_new"), F.col("tm_two")).otherwise(F.col("tm_one"))
    place = [F.col("tm_a").isNull().alias("tm_late"), F.coalesce("tm_a", "tm_b").alias(position)]
    return both.select(F.coalesce("l.tm_key", "r.tm_key").alias(key), *place, row.alias("tm_row")).select(key, "tm_late", position, *[F.col("tm_row")[c].alias(c) for c in rest])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side and row for rows that only one side has, counting repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


#: The read profiles and what each loads of files and symbols.
PROFILES = {
    "target_symbols": ("of_symbols", "ids"), "target_files": ("of_symbols", "none"), "target_file_symbols": ("of_symbols", "in_paths"), "all_files": ("all", "none"),
    "all_files_target_symbols": ("all", "ids"), "all_files_target_file_symbols": ("all", "in_paths"), "all_files_definitions": ("all", "names"),
    "metadata": ("none", "none"), "prefix_files": ("prefix", "in_files"), "reference_call_chain": ("all", "referencing"), "blast_enrichment": ("all", "reaching"),
}


def load_profile(files: DataFrame, symbols: DataFrame, profile: str, *, ids: list | None = None, paths: list | None = None, identifiers: list | None = None, prefix: str = "", depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) as a read profile needs them. files has path and imports
    (JSON, see graph.import_edges), symbols has id, name and file.

    Symbols: those with the ids, in the files of paths, with a name among
    identifiers in any case, in the files found by prefix, in the first limit
    files that import one of identifiers (reference_call_chain), or those with
    the ids and, after them, all in files that import the file of the first of
    these by id, over up to depth imports (blast_enrichment). Files: none, all,
    by prefix, or those of paths and of the symbols loaded. Empty lists match
    nothing, and a NULL path or file is never loaded by one. Filters on values
    are pushed into both scans by Spark; keys that were found go in as joins."""
    f_how, s_how = PROFILES[profile]
    none, no_symbols = files.where(F.lit(False)), symbols.where(F.lit(False))
    picked = prefix_scan(files, "path", prefix) if f_how == "prefix" else files
    if s_how == "none":
        s = no_symbols
    elif s_how == "ids":
        s = in_list(symbols, "id", ids or [])
    elif s_how == "in_paths":
        s = in_list(symbols, "file", paths or [])
    elif s_how == "names":
        s = symbols.where(F.lower("name").isin(*[n.lower() for n in identifiers])) if identifiers else no_symbols
    elif s_how == "in_files":
        s = two_phase(symbols, "file", picked, "path")
    elif s_how == "referencing":
        s = two_phase(symbols, "file", graph.reference_files(files, path="path", imports="imports", wanted=identifiers or [], limit=limit), "path")
    else:
        own = in_list(symbols, "id", ids or [])
        focal = own.groupBy().agg(F.min_by("file", "id").alias("node"))
        near = graph.reach(graph.import_edges(files, path="path", imports="imports"), focal, depth, reverse=True).where("depth > 0")
        s = own.unionByName(two_phase(symbols, "file", near, "node").join(own.select("id"), "id", "left_anti").select(*symbols.columns))
    if f_how == "of_symbols":
        wanted = in_list(files, "path", paths or [])
        f = wanted.unionByName(two_phase(files, "path", s.where("file != ''"), "file").join(wanted.select("path"), "path", "left_anti").select(*files.columns)) if s_how != "none" else wanted
    else:
        f = {"none": none, "all": files, "prefix": picked}[f_how]
    return f, s
