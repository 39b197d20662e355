"""Canonical forms, identities and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import parse_json
from tidemark.operators.nested import as_list, as_struct, let
from tidemark.operators.reads import numbered
from tidemark.session import materialise

#: Digests are joined to those of so many rows, these again, and so on.
FAN = 1024


def canonical_json(text: Column, drop: tuple[str, ...] = (), drop_prefix: tuple[str, ...] = (), drop_path: tuple[str, ...] = ()) -> Column:
    """JSON with sorted keys, compact, without the dropped keys at any depth, and
    without what lies at drop_path below any object. NULL, and text that is not
    JSON, give NULL. Recursive, hence a pandas UDF."""

    def without(x: dict, path: tuple[str, ...]) -> dict:
        if path[0] not in x:
            return x
        if len(path) == 1:
            return {k: v for k, v in x.items() if k != path[0]}
        below = x[path[0]]
        return x | {path[0]: without(below, path[1:])} if isinstance(below, dict) else x

    def clean(x):
        if isinstance(x, dict):
            x = without(x, drop_path) if drop_path else x
            return {k: clean(v) for k, v in x.items() if k not in drop and not k.startswith(tuple(drop_prefix) or ("\0",))}
        return [clean(v) for v in x] if isinstance(x, list) else x

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(clean(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return run(text)


def core_parity(df: DataFrame, *, keys: list[str], mode: str, text: str, baseline: str, candidate: str, path: tuple[str, ...]) -> DataFrame:
    """keys, full_parity, core_parity, difference: whether two modes' answers are
    the same JSON, and whether they are but for what lies at path; then the path
    is the difference, else it is empty. Keys without either mode are left out;
    of several rows of a mode the greatest canonical text counts. Text that is
    no JSON is equal to none."""
    whole, core = canonical_json(F.col(text)), canonical_json(F.col(text), drop_path=path)
    both = df.where(F.col(mode).isin(baseline, candidate)).select(*keys, F.col(mode).alias("tm_m"), whole.alias("tm_w"), core.alias("tm_c"))
    of = lambda c, m: F.max(F.when(F.col("tm_m") == m, F.col(c)))
    has = lambda m: F.max(F.col("tm_m") == m)
    g = both.groupBy(*keys).agg(of("tm_w", baseline).alias("tm_w1"), of("tm_w", candidate).alias("tm_w2"), of("tm_c", baseline).alias("tm_c1"), of("tm_c", candidate).alias("tm_c2"), has(baseline).alias("tm_b"), has(candidate).alias("tm_d"))
    full, same = (F.coalesce(F.col(f"tm_{x}1") == F.col(f"tm_{x}2"), F.lit(False)) for x in "wc")
    return g.where("tm_b AND tm_d").select(*keys, full.alias("full_parity"), (full | same).alias("core_parity"), F.when(~full & same, ".".join(path)).otherwise("").alias("difference"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _sized(c: Column) -> Column:
    """A value with its length in front, so that no two rows read the same; NULL
    is a form of its own."""
    t = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def table_digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """n, digest: one SHA-256 of a table's rows in the order of key (then of the
    other columns), each value with its length in front. Rows are numbered over
    a range sort and hashed; the hashes of FAN successive rows are joined and
    hashed again, and so on until one is left, so no task reads more than FAN
    hashes at a time and the result depends on no partition. An empty table has
    the hash of the empty text."""
    row = F.sha2(F.concat(*[_sized(F.col(c)) for c in [key, *columns]]), 256)
    n = numbered(df.select(key, *columns), [key, *columns]).select("position", row.alias("h"))
    total = df.count()
    size = total
    while size > 1:
        n = n.groupBy(F.floor(F.col("position") / FAN).alias("position")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
        size = -(-size // FAN)
        if size > 1:
            n = materialise(n)
    if not total:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), F.sha2(F.lit(""), 256).alias("digest"))
    return n.select(F.lit(total).cast("long").alias("n"), F.col("h").alias("digest"))


def provenance(df: DataFrame, *, group: list[str], sha: str, current: str, width: int = 8) -> DataFrame:
    """group, class, shas: whether all rows of a group are of the current
    revision, none, or some. Blank and NULL revisions don't count."""
    short = F.when(F.col(sha) != "", F.substring(sha, 1, width))
    g = df.groupBy(*group).agg(F.array_sort(F.collect_set(short)).alias("shas"))
    has = F.array_contains("shas", current[:width])
    kind = F.when(F.size("shas") == 0, "empty").when(has & (F.size("shas") == 1), "current_only").when(has, "mixed").otherwise("older_only")
    return g.select(*group, kind.alias("class"), F.array_join("shas", ",").alias("shas"))


#: Names in a hydration trace.
TRACE_COUNTERS = ("lazy_full_materializations", "lazy_ensure_calls", "sparse_by_id_calls", "sparse_by_file_calls", "sparse_by_name_calls", "sparse_by_files_calls")


def _trace(text: str, then) -> Column:
    """then(trace), where trace is a struct of the counters and of the list of
    loads, and NULL where the record has no object for a trace. JSON held as a
    string counts like the JSON itself."""
    record = as_struct(parse_json(F.col(text)), [("hydration_trace", "variant")])
    return let(as_struct(record["hydration_trace"], [("load_results", "variant"), *((c, "int") for c in TRACE_COUNTERS)]), then)


def _loads(t: Column) -> Column:
    return F.transform(as_list(t["load_results"]), lambda x: as_struct(x, [("requested_hydration", "string")]))


def traces(text: str) -> Column:
    """One of six labels, in order, for the hydration trace in JSON text: full
    loads asked for with or without sparse reads, lazy ones that became full
    with or without, sparse reads alone, or nothing but metadata and the state
    of files. Counters that are missing count as 0. NULL without a trace."""

    def label(t: Column) -> Column:
        full = F.coalesce(F.exists(_loads(t), lambda x: F.coalesce(x["requested_hydration"] == "full", F.lit(False))), F.lit(False))
        lazy = F.coalesce(t["lazy_full_materializations"], F.lit(0)) > 0
        sparse = sum((F.coalesce(t[c], F.lit(0)) for c in TRACE_COUNTERS if c.startswith("sparse")), F.lit(0)) > 0
        named = (
            F.when(full & sparse, "explicit_full_plus_sparse").when(full, "explicit_full").when(lazy & sparse, "lazy_full_plus_sparse").when(lazy, "lazy_full")
            .when(sparse, "sparse_only").otherwise("metadata_or_file_state_only")
        )
        return F.when(t.isNotNull(), named)

    return _trace(text, label)


def trace_counters(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """by, n_traces, n_loads, and the sum of each counter over the traces of a
    group; rows without a trace add nothing."""
    one = lambda t: F.when(t.isNotNull(), F.struct(F.size(F.filter(F.coalesce(_loads(t), F.array()), lambda x: x.isNotNull())).alias("n_loads"), *[t[c].alias(c) for c in TRACE_COUNTERS]))
    t = df.select(*by, _trace(text, one).alias("tm_t")).where("tm_t IS NOT NULL")
    return t.groupBy(*by).agg(F.count("*").alias("n_traces"), F.sum("tm_t.n_loads").alias("n_loads"), *[F.coalesce(F.sum(f"tm_t.{c}"), F.lit(0)).alias(c) for c in TRACE_COUNTERS])
