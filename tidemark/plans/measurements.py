"""Queries over the measurement tables: profiles, schema drift, nested records,
spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import drift, unify
from tidemark.operators.nested import TRACE, flatten, layout, outline
from tidemark.operators.profile import Check, Profile, departures, profile
from tidemark.operators.spikes import spikes
from tidemark.session import table

CALLS = "generation_safe_hybrid_concurrency_v1"
PROBES = "generation_boundary_architecture_probe_v1"
PROFILED = ["rss_delta_bytes", "response_bytes", "canonical_response_hash"]
CHECKS = {
    "rss_delta_bytes": Check(low=-(2.0**40), high=2.0**40),
    "response_bytes": Check(low=1, high=2.0**30),
    "canonical_response_hash": Check(pattern="[0-9a-f]{64}"),
}


def _profile(spark: SparkSession, d: str) -> Profile:
    return profile(table(spark, d, CALLS), load="load_id", columns=PROFILED, checks=CHECKS)


def _load_id(df: DataFrame) -> DataFrame:
    return df.withColumn("load_id", F.col("load_id").cast("int"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return _load_id(_profile(spark, d).columns)


def p2_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _load_id(_profile(spark, d).quantiles)


def p2_distances(spark: SparkSession, d: str) -> DataFrame:
    q = _load_id(_profile(spark, d).distances)
    return q.withColumns({c: F.round(c, 9) for c in ("ks_before", "ks_rest")})


def p2_text_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _load_id(_profile(spark, d).text_quantiles)


def p2_text_distances(spark: SparkSession, d: str) -> DataFrame:
    q = _load_id(_profile(spark, d).text_distances)
    return q.withColumns({c: F.round(c, 9) for c in ("ks_before", "ks_rest")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    numbers = ("rss_delta_bytes", "response_bytes")
    text = ("canonical_response_hash",)
    return _load_id(departures(_profile(spark, d), pattern_columns=text, range_columns=numbers, distinct_columns=text, median_columns=numbers))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    return drift(table(spark, d, "raw_run_files"), table(spark, d, "raw_run_rows"))


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).select(
        F.col("line").alias("line_id"), F.col("order").alias("seq_no"), F.col("file").alias("file_id"), "field_name", "change_kind", "new_name", "old_type", "new_type"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).select(F.col("file").alias("file_id"), "field_name", "change_kind")


def _unified(spark: SparkSession, d: str) -> DataFrame:
    wide = (
        ("repo_name", "string"), ("case", "string"), ("mode", "string"), ("repetition", "int"), ("wall_ms", "double"), ("elapsed_ms", "double"), ("load_phase_ms", "double"),
        ("response_bytes", "bigint"), ("file_count", "bigint"), ("canonical_response_hash", "string"), ("symbol_hash", "string"), ("jcodemunch_version", "string"), ("jcodemunch_source_sha", "string"),
    )
    return unify(table(spark, d, "raw_run_files"), table(spark, d, "raw_run_rows"), wide=wide)


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records in one table."""
    u = _unified(spark, d).drop("reported")
    names = {"row": "raw_id", "file": "file_id", "line": "line_id"}
    # the map goes out as JSON, since maps can't be compared
    return u.select(*[F.col(c).alias(names.get(c, c)) for c in u.columns if c != "other"], F.to_json("other").alias("other_fields"))


def p3_reported(spark: SparkSession, d: str) -> DataFrame:
    """What does not stand whole in the columns of p3_unified, and why."""
    u = _unified(spark, d).select(F.col("row").alias("raw_id"), F.inline("reported"))
    return u.select("raw_id", F.col("field").alias("field_name"), "name", "value", "reason")


def _trace(spark: SparkSession, d: str, depth: int) -> DataFrame:
    nested = layout(table(spark, d, PROBES), key="probe_id", text="parity_debug_json", levels=TRACE)
    return flatten(nested, TRACE, depth).withColumnRenamed("key", "probe_id")


def p4_attempts(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, 0)


def p4_loads(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, 1)


def p4_accesses(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, 2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nested = layout(table(spark, d, PROBES), key="probe_id", text="parity_debug_json", levels=TRACE)
    return outline(nested, TRACE, (1, 2)).withColumnRenamed("key", "probe_id")


def p6_spikes(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(table(spark, d, CALLS), id_col="measurement_id", source=["repo_name", "case", "mode"], position="repetition", value="wall_ms")
    return s.select(F.col("id").alias("measurement_id"), F.col("value").alias("wall_ms"), "reason")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_spikes(spark, d).select("measurement_id")


QUERIES = {f.__name__: f for f in (p2_profile, p2_quantiles, p2_distances, p2_text_quantiles, p2_text_distances, p2_found, p3_changes, p3_found, p3_unified, p3_reported, p4_attempts, p4_loads, p4_accesses, p4_found, p6_spikes, p6_found)}

_LONG = f"""
long AS (
  SELECT load_id, 'rss_delta_bytes' AS column_name, rss_delta_bytes AS v, NULL::VARCHAR AS s FROM {CALLS}
  UNION ALL SELECT load_id, 'response_bytes', response_bytes, NULL FROM {CALLS}
  UNION ALL SELECT load_id, 'canonical_response_hash', NULL, canonical_response_hash FROM {CALLS}),
stats AS (
  SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(coalesce(v::VARCHAR, s)) AS n_null,
    CAST(coalesce(sum(CASE WHEN column_name = 'rss_delta_bytes' THEN (abs(v) > 1099511627776)::INT
      WHEN column_name = 'response_bytes' THEN (v < 1 OR v > 1073741824)::INT
      ELSE (NOT regexp_full_match(s, '[0-9a-f]{{64}}'))::INT END), 0) AS BIGINT) AS n_wrong,
    count(DISTINCT coalesce(v::VARCHAR, s)) AS n_distinct,
    coalesce(min(s), min(v)::VARCHAR) AS min_value, coalesce(max(s), max(v)::VARCHAR) AS max_value, median(v) AS mid
  FROM long GROUP BY ALL)"""

def _decoded(x: str, times: int) -> str:
    """JSON in SQL, decoded while it is a string that holds JSON."""
    for _ in range(times):
        x = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END ELSE {x} END)"
    return x


def _list(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x}::JSON[] WHEN 'OBJECT' THEN [{x}] END"


def _below(parent: str, name: str, node: str, keys: list[str], own: str, lone: bool = False, many: bool = True) -> str:
    """Steps in SQL from the objects of parent (keys, o) to those below node:
    decoded, listed, numbered, and objects kept."""
    k = ", ".join(keys)
    items = f"coalesce({_list('n')}, CASE WHEN n IS NULL OR json_type(n) NOT IN ('ARRAY', 'OBJECT') THEN [o] END)" if lone else _list("n") if many else "CASE json_type(n) WHEN 'OBJECT' THEN [n] END"
    return f"""{name}_n AS (SELECT {k}, o, {node} AS n0 FROM {parent}), {name}_d AS (SELECT {k}, o, {_decoded("n0", 2)} AS n FROM {name}_n), {name}_l AS (SELECT {k}, {items} AS l FROM {name}_d),
  {name}_u AS (SELECT {k}, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS {own} FROM {name}_l), {name} AS (SELECT * EXCLUDE (o0), o0 AS o FROM (SELECT {k}, {own}, {_decoded("x", 2)} AS o0 FROM {name}_u) WHERE json_type(o0) = 'OBJECT')"""


_TREE = f"""raw AS (SELECT DISTINCT probe_id, parity_debug_json::JSON AS r FROM {PROBES} WHERE json_valid(parity_debug_json)), rec AS (SELECT probe_id, o FROM (SELECT probe_id, {_decoded("r", 3)} AS o FROM raw) WHERE json_type(o) = 'OBJECT'),
  {_below("rec", "attempt", "o -> 'attempts'", ["probe_id"], "attempt_no", lone=True)},
  {_below("attempt", "trace", "o -> 'hydration_trace'", ["probe_id", "attempt_no"], "t_no", many=False)},
  {_below("trace", "load", "o -> 'load_results'", ["probe_id", "attempt_no"], "load_no")},
  {_below("load", "access", "o -> 'accesses'", ["probe_id", "attempt_no", "load_no"], "access_no")}"""


SQL = {
    "p4_attempts": f"WITH {_TREE} SELECT probe_id, attempt_no, try_cast(o ->> 'attempt' AS INT) AS attempt, try_cast(o ->> 'skipped' AS BOOLEAN) AS skipped FROM attempt",
    "p4_loads": f"""WITH {_TREE} SELECT probe_id, attempt_no, load_no, o ->> 'repo' AS repo, o ->> 'branch' AS branch, o ->> 'requested_hydration' AS requested_hydration, o ->> 'symbol_collection_type' AS symbol_collection_type,
      try_cast(o ->> 'lazy_loaded_at_return' AS BOOLEAN) AS lazy_loaded_at_return FROM load""",
    "p4_accesses": f"WITH {_TREE} SELECT probe_id, attempt_no, load_no, access_no, o ->> 'kind' AS kind, try_cast(o ->> 'ms' AS DOUBLE) AS ms, o ->> 'symbol_id' AS symbol_id FROM access",
    "p4_found": f"WITH {_TREE} SELECT probe_id, attempt_no, load_no, -1 AS access_no FROM load UNION ALL SELECT probe_id, attempt_no, load_no, access_no FROM access",
    "p2_profile": f"WITH {_LONG} SELECT load_id, column_name, n_rows, n_null, n_wrong, n_distinct, min_value, max_value FROM stats",
    "p2_quantiles": f"""WITH {_LONG}, three AS (
        SELECT load_id, column_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM long WHERE v IS NOT NULL GROUP BY ALL)
      SELECT load_id, column_name, 0.25::DOUBLE AS q, a::DOUBLE AS value FROM three UNION ALL SELECT load_id, column_name, 0.5, b FROM three UNION ALL SELECT load_id, column_name, 0.75, c FROM three""",
    "p2_distances": f"""WITH {_LONG},
      sized AS (SELECT column_name, load_id, count(*)::DOUBLE AS size FROM long WHERE v IS NOT NULL GROUP BY ALL),
      points AS (SELECT DISTINCT column_name, v FROM long WHERE v IS NOT NULL),
      hits AS (SELECT column_name, load_id, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
      grid AS (SELECT p.column_name, z.load_id, p.v, z.size, coalesce(h.n, 0) AS n FROM points p JOIN sized z USING (column_name) LEFT JOIN hits h USING (column_name, load_id, v)),
      curve AS (SELECT column_name, load_id, v, size, sum(n) OVER (PARTITION BY column_name, load_id ORDER BY v) AS c FROM grid),
      pooled AS (SELECT *, sum(c) OVER (PARTITION BY column_name, v) AS all_c, sum(size) OVER (PARTITION BY column_name, v) AS all_size,
        lag(c / size) OVER (PARTITION BY column_name, v ORDER BY load_id) AS f_before FROM curve)
      SELECT load_id, column_name, round(max(abs(c / size - f_before)), 9) AS ks_before, round(max(abs(c / size - (all_c - c) / (all_size - size))), 9) AS ks_rest FROM pooled GROUP BY ALL""",
    "p2_text_quantiles": f"""WITH {_LONG}, three AS (
        SELECT load_id, column_name, quantile_disc(s, 0.25) AS a, quantile_disc(s, 0.5) AS b, quantile_disc(s, 0.75) AS c FROM long WHERE s IS NOT NULL GROUP BY ALL)
      SELECT load_id, column_name, 0.25::DOUBLE AS q, a AS value FROM three UNION ALL SELECT load_id, column_name, 0.5, b FROM three UNION ALL SELECT load_id, column_name, 0.75, c FROM three""",
    "p2_text_distances": f"""WITH {_LONG},
      sized AS (SELECT column_name, load_id, count(*)::DOUBLE AS size FROM long WHERE s IS NOT NULL GROUP BY ALL),
      points AS (SELECT DISTINCT column_name, s FROM long WHERE s IS NOT NULL),
      hits AS (SELECT column_name, load_id, s, count(*) AS n FROM long WHERE s IS NOT NULL GROUP BY ALL),
      grid AS (SELECT p.column_name, z.load_id, p.s, z.size, coalesce(h.n, 0) AS n FROM points p JOIN sized z USING (column_name) LEFT JOIN hits h USING (column_name, load_id, s)),
      curve AS (SELECT column_name, load_id, s, size, sum(n) OVER (PARTITION BY column_name, load_id ORDER BY s) AS c FROM grid),
      pooled AS (SELECT *, sum(c) OVER (PARTITION BY column_name, s) AS all_c, sum(size) OVER (PARTITION BY column_name, s) AS all_size,
        lag(c / size) OVER (PARTITION BY column_name, s ORDER BY load_id) AS f_before FROM curve)
      SELECT load_id, column_name, round(max(abs(c / size - f_before)), 9) AS ks_before, round(max(abs(c / size - (all_c - c) / (all_size - size))), 9) AS ks_rest FROM pooled GROUP BY ALL""",
    "p2_found": f"""WITH {_LONG},
      rates AS (SELECT *, n_null / n_rows AS rate, n_wrong / nullif(n_rows - n_null, 0) AS wrong FROM stats),
      u AS (SELECT *, median(rate) OVER w AS u_rate, median(n_distinct) OVER w AS u_distinct, median(mid) OVER w AS u_mid FROM rates WINDOW w AS (PARTITION BY column_name))
      SELECT load_id, column_name, 'null_rate' AS check_name FROM u WHERE rate - u_rate > 0.20
      UNION ALL SELECT load_id, column_name, 'pattern' FROM u WHERE column_name = 'canonical_response_hash' AND wrong > 0.12
      UNION ALL SELECT load_id, column_name, 'range' FROM u WHERE column_name != 'canonical_response_hash' AND wrong > 0.05
      UNION ALL SELECT load_id, column_name, 'distinct' FROM u WHERE column_name = 'canonical_response_hash' AND n_distinct < 0.2 * u_distinct
      UNION ALL SELECT load_id, column_name, 'distribution' FROM u WHERE column_name != 'canonical_response_hash' AND u_mid > 0 AND (mid >= 8 * u_mid OR mid <= u_mid / 8)""",
}
