"""Queries for the tools of a code index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import index_tools as tools
from tidemark.operators import reads
from tidemark.plans.measurements import CALLS
from tidemark.session import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT id, name, byte_length FROM symbols WHERE byte_length > 500 AND contains(id, '#method') ORDER BY byte_length DESC, id LIMIT 20")
def tool_winnow_symbols(spark, d):
    s = table(spark, d, "symbols").select("id", "name", "byte_length")
    return tools.winnow(s, [F.col("byte_length") > 500, F.contains("id", F.lit("#method"))], F.col("byte_length"), "id")


@query("""SELECT id, name, CASE WHEN lower(name) = 'snapshot' THEN 3 WHEN starts_with(lower(name), 'snapshot') THEN 2 ELSE 1 END AS grade FROM symbols WHERE contains(lower(name), 'snapshot')
  ORDER BY grade DESC, id LIMIT 20""")
def tool_search_symbols(spark, d):
    return tools.search_names(table(spark, d, "symbols").select("id", "name"), "name", "Snapshot", "id")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'parity check') ORDER BY doc_id LIMIT 50")
def tool_search_text(spark, d):
    return tools.search_text(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", "Parity check", "doc_id").drop("text")


@query("SELECT file, ord, name FROM symbols WHERE file = (SELECT min(file) FROM symbols) OR file = (SELECT max(file) FROM symbols)")
def tool_file_outline(spark, d):
    s = table(spark, d, "symbols")
    ends = s.agg(F.min("file").alias("a"), F.max("file").alias("b")).first()
    return tools.outline(s, "file", "name", "ord", [x for x in ends if x is not None])


@query("""WITH f AS (SELECT DISTINCT file FROM symbols WHERE contains(file, '/')), x AS (SELECT string_split(file, '/') AS p FROM f),
  y AS (SELECT array_to_string(p[1:i], '/') AS dir FROM (SELECT p, unnest(range(1, len(p))) AS i FROM x)) SELECT dir, count(*) AS n_files FROM y GROUP BY dir""")
def tool_file_tree(spark, d):
    return tools.tree(table(spark, d, "symbols"), "file")


@query(f"""SELECT repo_name, count(*) AS n, count(*) FILTER (recorded_at > (SELECT max(recorded_at) FROM {CALLS}) - INTERVAL 7 DAYS) AS n_recent,
  round(count(*) FILTER (recorded_at > (SELECT max(recorded_at) FROM {CALLS}) - INTERVAL 7 DAYS) / 7, 6) AS per_day FROM {CALLS} GROUP BY repo_name""")
def tool_churn_rate(spark, d):
    c = tools.churn(table(spark, d, CALLS).select("repo_name", "recorded_at"), ["repo_name"], "recorded_at", 7)
    return c.withColumn("per_day", F.round("per_day", 6))


@query(f"""WITH c AS (SELECT *, json_extract_string(target_value, '$.symbol_id') AS symbol_id FROM {CALLS})
  SELECT symbol_id, measurement_id, load_id, tool, row_number() OVER (PARTITION BY symbol_id ORDER BY recorded_at DESC, measurement_id, load_id) AS nth FROM c WHERE symbol_id IS NOT NULL QUALIFY nth <= 3""")
def tool_symbol_provenance(spark, d):
    """The three latest calls about each symbol that calls were about."""
    c = table(spark, d, CALLS).select(F.get_json_object("target_value", "$.symbol_id").alias("symbol_id"), "measurement_id", "load_id", "tool", "recorded_at").where("symbol_id IS NOT NULL")
    return tools.latest_each(c, ["symbol_id"], [F.desc("recorded_at"), F.col("measurement_id"), F.col("load_id")], 3).drop("recorded_at")


@query("SELECT name, levenshtein(lower(name), 'snapshott.colect_000')::INT AS distance FROM (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL) ORDER BY distance, name LIMIT 5")
def tool_suggest_corrections(spark, d):
    return tools.corrections(table(spark, d, "symbols"), "name", "Snapshott.colect_000")


@query("""SELECT file, count(*) AS n, coalesce(sum(byte_length), 0)::BIGINT AS bytes, round(count(*) * ln(1 + coalesce(sum(byte_length), 0)), 6) AS score FROM symbols GROUP BY file ORDER BY score DESC, file LIMIT 15""")
def tool_hotspots(spark, d):
    return tools.hot_spots(table(spark, d, "symbols"), "file", "byte_length")


@query("""WITH new AS (SELECT id, CASE WHEN ord % 10 = 0 THEN coalesce(byte_length, 0) + 1 ELSE byte_length END AS byte_length FROM symbols WHERE ord % 10 <> 1), old AS (SELECT id, byte_length FROM symbols)
  SELECT id, CASE WHEN n.id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM (SELECT id, byte_length FROM old EXCEPT ALL SELECT id, byte_length FROM new) o LEFT JOIN new n USING (id)""")
def tool_changed_symbols(spark, d):
    old = table(spark, d, "symbols").select("ord", "id", "byte_length")
    new = old.where("ord % 10 <> 1").withColumn("byte_length", F.when(F.col("ord") % 10 == 0, F.coalesce("byte_length", F.lit(0)) + 1).otherwise(F.col("byte_length"))).drop("ord")
    gone = reads.differences(old.drop("ord"), new).where("side = 'left'").select("id")
    return gone.join(new.select("id", F.lit(1).alias("there")), "id", "left").select("id", F.when(F.col("there").isNull(), "deleted").otherwise("changed").alias("change"))
