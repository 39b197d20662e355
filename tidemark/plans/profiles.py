"""Queries of the read profiles, over files and symbols, and of reads and sinks
that need a setting of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, paired, reads
from tidemark.plans.measurements import CALLS, PROBES
from tidemark.session import scratch, table
from tidemark.sources import files as sources

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Files and what they import, in SQL: each symbol stands for an import of the
#: file of the symbol after it, under the name of what that one belongs to.
FILES_SQL = """uses AS (SELECT DISTINCT a.file AS path, b.file AS specifier, split_part(b.name, '.', 1) AS name FROM symbols a JOIN symbols b ON b.ord = a.ord + 1 WHERE a.file IS NOT NULL AND a.ord % 7 = 0),
  files AS (SELECT DISTINCT file AS path FROM symbols WHERE file IS NOT NULL), imp AS (SELECT DISTINCT path AS src, specifier AS dst FROM uses WHERE specifier IS NOT NULL)"""


def symbols_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols")


def files_of(spark: SparkSession, d: str) -> DataFrame:
    """path and imports (JSON) of every file of a symbol; see FILES_SQL."""
    s = symbols_of(spark, d)
    after = s.select((F.col("ord") - 1).alias("ord"), F.col("file").alias("specifier"), F.substring_index("name", ".", 1).alias("used"))
    uses = s.where("file IS NOT NULL AND ord % 7 = 0").select("ord", F.col("file").alias("path")).join(after, "ord").groupBy("path", "specifier").agg(F.sort_array(F.collect_set("used")).alias("names"))
    imports = uses.groupBy("path").agg(F.to_json(F.sort_array(F.collect_list(F.struct("specifier", "names")))).alias("imports"))
    return s.where("file IS NOT NULL").select(F.col("file").alias("path")).distinct().join(imports, "path", "left")


_ASKED = [3, 8, 21, 34, 55]
_IDS = f"SELECT id FROM symbols WHERE ord IN ({', '.join(map(str, _ASKED))})"
_PATHS = "SELECT file FROM symbols WHERE ord IN (2, 13)"


def _loaded(spark, d, profile, **o):
    s = symbols_of(spark, d)
    if o.pop("by_id", False):
        o["ids"] = [r["id"] for r in s.where(F.col("ord").isin(_ASKED)).select("id").collect()]
    if o.pop("by_path", False):
        o["paths"] = sorted({r["file"] for r in s.where("ord IN (2, 13)").select("file").collect()})
    f, got = reads.load_profile(files_of(spark, d), s.select("id", "name", "file"), profile, **o)
    out = f.select(F.lit("file").alias("kind"), F.col("path").alias("key")).unionByName(got.select(F.lit("symbol").alias("kind"), F.col("id").alias("key")))
    if profile == "metadata":  # loads no rows, only what is known of the tables
        out = out.unionByName(sources.catalog(spark, d, ["symbols"]).select(F.lit("column").alias("kind"), F.col("column_name").alias("key")))
    return out


def _profile(name: str, files: str, symbols: str, **o) -> None:
    """Registers the query of one profile."""

    def run(spark, d):
        return _loaded(spark, d, name, **o)

    run.__name__ = f"profile_{name}"
    parts = [f"SELECT 'file' AS kind, path AS key FROM files WHERE {files}"] if files else []
    parts += [f"SELECT 'symbol' AS kind, id AS key FROM symbols WHERE {symbols}"] if symbols else []
    query(f"WITH {FILES_SQL} " + " UNION ALL ".join(parts or ["SELECT 'column' AS kind, column_name AS key FROM information_schema.columns WHERE table_name = 'symbols'"]))(run)


_profile("target_symbols", f"path IN (SELECT file FROM symbols WHERE id IN ({_IDS}))", f"id IN ({_IDS})", by_id=True)
_profile("target_files", f"path IN ({_PATHS})", "", by_path=True)
_profile("target_file_symbols", f"path IN ({_PATHS})", f"file IN ({_PATHS})", by_path=True)
_profile("all_files", "true", "")
_profile("all_files_target_symbols", "true", f"id IN ({_IDS})", by_id=True)
_profile("all_files_target_file_symbols", "true", f"file IN ({_PATHS})", by_path=True)
_profile("all_files_definitions", "true", "lower(name) IN ('snapshot.collect_000', 'session.rebuild_001')", identifiers=["Snapshot.collect_000", "SESSION.rebuild_001"])
_profile("metadata", "", "")
_profile("prefix_files", "path ILIKE 'src/s%'", "file ILIKE 'src/s%'", prefix="SRC/s")
_profile("reference_call_chain", "true", "file IN (SELECT path FROM (SELECT DISTINCT path FROM uses WHERE lower(name) IN ('snapshot', 'ledger') ORDER BY path LIMIT 50))", identifiers=["Snapshot", "ledger"])
_profile("blast_enrichment", "true", f"""id IN ({_IDS}) OR file IN (WITH focal AS (SELECT arg_min(file, id) AS f FROM symbols WHERE id IN ({_IDS})), one AS (SELECT src FROM imp WHERE dst = (SELECT f FROM focal)),
  two AS (SELECT src FROM imp WHERE dst IN (SELECT src FROM one)) SELECT src FROM (SELECT src FROM one UNION SELECT src FROM two) WHERE src <> (SELECT f FROM focal))""", by_id=True, depth=2)


@query(f"""WITH RECURSIVE {FILES_SQL}, r AS (SELECT min(dst) AS node, 0 AS depth FROM imp UNION SELECT imp.src, depth + 1 FROM r JOIN imp ON imp.dst = r.node WHERE depth < 4) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def importers_reach(spark, d):
    """All files that import the first imported one, over up to four steps."""
    e = graph.import_edges(files_of(spark, d), path="path", imports="imports")
    return graph.reach(e, e.agg(F.min("dst").alias("node")), 4, reverse=True)


@query(f"WITH {FILES_SQL} SELECT s.id FROM symbols s WHERE s.file IN (SELECT src FROM imp WHERE dst = (SELECT min(dst) FROM imp) AND src <> dst)")
def symbols_reaching(spark, d):
    """Symbols in files that import the first imported file."""
    e = graph.import_edges(files_of(spark, d), path="path", imports="imports")
    near = graph.reach(e, e.agg(F.min("dst").alias("node")), 1, reverse=True).where("depth = 1")
    return reads.two_phase(symbols_of(spark, d).select("id", "file"), "file", near, "node").select("id")


# --- lists, maps, truth ----------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey < 6000")
def long_in_list(spark, d):
    """A list of more values than go into one filter."""
    return reads.in_list(table(spark, d, "orders"), "o_orderkey", list(range(1, 6000, 3)))


@query("SELECT string_agg(key || '=' || value, ';' ORDER BY key) AS pairs FROM (SELECT split_part(name, '.', 2) AS key, max(file) AS value FROM symbols WHERE split_part(name, '.', 2) LIKE 'embed_%' OR split_part(name, '.', 2) LIKE 'walk_0%' GROUP BY 1) WHERE key LIKE 'walk_0%'")
def kv_like(spark, d):
    """A key-value table read by a pattern in which _ is any character."""
    m = reads.key_values(symbols_of(spark, d).withColumn("k", F.substring_index(F.substring_index("name", ".", 2), ".", -1)), "k", "file", like="walk_0%")
    return m.select(F.array_join(F.transform(F.map_entries("pairs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("pairs"))


@query("SELECT count(*) FILTER (summary IS NOT NULL AND summary <> '') AS with_summary, count(*) FILTER (byte_length IS NOT NULL AND byte_length <> 0) AS with_length, coalesce(max(byte_length) FILTER (byte_length < 0), -1) AS most_or_default FROM symbols")
def truth_and_defaults(spark, d):
    """What counts as true, and a maximum of nothing."""
    most = F.coalesce(F.max(F.when(F.col("byte_length") < 0, F.col("byte_length"))), F.lit(-1))
    return symbols_of(spark, d).agg(F.count_if(T.truthy(F.col("summary"), "string")).alias("with_summary"), F.count_if(T.truthy(F.col("byte_length"), "number")).alias("with_length"), most.alias("most_or_default"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, printf('%.3f ms', value) AS shown, printf('%03d', event_id % 1000) AS padded, CASE WHEN starts_with(event_type, 'p') THEN substr(event_type, 2) ELSE event_type END AS bare, ends_with(event_type, 'k') AS is_k,
  to_hex(event_id & 15) AS low, event_id >> 2 AS shifted, xor(event_id, 5) AS mixed FROM events""")
def format_functions(spark, d):
    k, t = F.col("event_id"), F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", T.utc_stamp(F.date_trunc("second", "ts")).alias("stamp"), T.milliseconds(F.col("value")).alias("shown"), T.padded(F.pmod(k, F.lit(1000))).alias("padded"), T.without_prefix(t, "p").alias("bare"), t.endswith("k").alias("is_k"),
        F.hex(k.bitwiseAND(15)).alias("low"), F.shiftright(k, 2).alias("shifted"), k.bitwiseXOR(F.lit(5)).alias("mixed"),
    )


@query('SELECT c_custkey AS "the ""key""", c_name AS "a`b" FROM customer')
def quoted_names(spark, d):
    """Columns whose names have to be quoted, through an SQL text."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias('the "key"'), F.col("c_name").alias("a`b"))
    return c.selectExpr(T.quoted('the "key"'), T.quoted("a`b"))


# --- pairs, rotation, order ------------------------------------------------


@query(f"""WITH t AS (SELECT tool, mode, count(*)::DOUBLE AS n FROM {CALLS} WHERE mode IN ('baseline_full', 'generation_safe_hybrid') GROUP BY ALL)
  SELECT tool, max(n) FILTER (mode = 'baseline_full') AS base, max(n) FILTER (mode = 'generation_safe_hybrid') AS cand FROM t GROUP BY tool""")
def strict_pairs(spark, d):
    """Calls by tool in either mode; a tool without one of them is an error."""
    t = table(spark, d, CALLS).groupBy("tool", "mode").agg(F.count("*").cast("double").alias("n"))
    return paired.pairs(t, keys=["tool"], mode="mode", value="n", baseline="baseline_full", candidate="generation_safe_hybrid", strict=True)


@query(f"""WITH m AS (SELECT list_sort(list(DISTINCT mode)) AS ms FROM {CALLS}), r AS (SELECT DISTINCT repetition FROM {CALLS})
  SELECT repetition, array_to_string(list_concat(ms[(repetition % len(ms))::INT + 1:], ms[:(repetition % len(ms))::INT]), ',') AS modes, CASE WHEN repetition % 2 = 0 THEN 'forward' ELSE 'backward' END AS way FROM r, m""")
def mode_rotation(spark, d):
    """The order in which modes take turns: the list is rotated by one for every
    repetition, and the way alternates."""
    t = table(spark, d, CALLS).select("mode", "repetition")
    modes = F.broadcast(t.agg(F.sort_array(F.collect_set("mode")).alias("ms")))  # one row
    by = F.pmod("repetition", F.size("ms"))
    turned = F.concat(F.slice("ms", by + 1, F.size("ms")), F.slice("ms", F.lit(1), by))
    return t.select("repetition").distinct().crossJoin(modes).select("repetition", F.array_join(turned, ",").alias("modes"), F.when(F.col("repetition") % 2 == 0, "forward").otherwise("backward").alias("way"))


@query("""WITH d AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE o_orderkey % 10 WHEN 1 THEN 'modify' ELSE 'delete' END AS action FROM orders WHERE o_orderkey % 10 IN (1, 2)
  UNION ALL SELECT o_orderkey + 10000000, 5.0, 'add' FROM orders WHERE o_orderkey % 10 = 3), x AS (SELECT o_orderkey, o_totalprice, NULL AS place FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)
  UNION ALL SELECT o_orderkey, o_totalprice, -o_orderkey FROM d WHERE action IN ('add', 'modify'))
  SELECT o_orderkey, o_totalprice FROM x ORDER BY place NULLS FIRST, o_orderkey""")
def overlay_in_order(spark, d):
    """Base rows, then changed and new ones in the delta's order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changed = o.where("o_orderkey % 10 IN (1, 2)").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 10 == 1, "modify").otherwise("delete").alias("action"))
    new = o.where("o_orderkey % 10 = 3").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit(5.0).alias("o_totalprice"), F.lit("add").alias("action"))
    delta = changed.unionByName(new).withColumn("at", -F.col("o_orderkey"))
    return reads.overlay(o, delta, key="o_orderkey", action="action", order="at").orderBy(F.col("tm_at").asc_nulls_first(), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey AS place, o_totalprice AS v FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_orderkey AS k, -o_orderkey AS place, 0.0 AS v FROM orders WHERE o_orderkey % 3 > 0)
  SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS late, coalesce(a.place, b.place) AS place, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v FROM a FULL JOIN b USING (k) ORDER BY late, place""")
def upsert_in_place(spark, d):
    """Later rows win, at the place of the first."""
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("place"), F.col("o_totalprice").alias("v"))
    b = o.where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("k"), (-F.col("o_orderkey")).alias("place"), F.lit(0.0).alias("v"))
    return reads.upsert(a, b, "k", position="place").withColumnRenamed("tm_late", "late").orderBy("late", "place")


# --- sinks and sources -----------------------------------------------------


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def json_documents(spark, d):
    """One document of many lines per region, written with sorted keys and read
    back."""
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    path = scratch(spark)
    sources.write_documents(rows, path, name="k")
    back = sources.read_documents(spark, path, "k int, names array<string>")
    return back.select("k", F.array_join("names", ",").alias("names"))


@query("SELECT 'orc' AS format, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type UNION ALL SELECT 'json', event_type, count(*), round(sum(value), 3) FROM events GROUP BY event_type")
def other_formats(spark, d):
    """The same table written and read as ORC and as lines of JSON."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    out = []
    for kind in ("orc", "json"):
        path = scratch(spark)
        e.write.format(kind).save(path)
        back = spark.read.schema(e.schema).format(kind).load(path)
        out.append(back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.lit(kind).alias("format"), "event_type", "n", "total"))
    return out[0].unionByName(out[1])


@query("SELECT r_name AS member, sha256(r_name || chr(10)) AS hash, true AS whole FROM region")
def packed(spark, d):
    """A sealed archive of one file per region: packed, verified, installed, and
    a changed copy refused."""
    return sources.pack_roundtrip(table(spark, d, "region").select(F.col("r_name").alias("member"), F.concat("r_name", F.lit("\n")).alias("content")), scratch(spark))


@query("SELECT symbol_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) AS first_value FROM symbol_embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND isfinite(embedding[1]) ORDER BY symbol_id")
def blob_scan(spark, d):
    """Vectors as bytes of 4-byte floats, decoded again, in the order of ids."""
    v = table(spark, d, "symbol_embeddings").where("embedding IS NOT NULL AND size(embedding) > 0")
    back = sources.vectors_from_bytes(sources.vectors_to_bytes(v, "embedding", "blob"), "blob", "vector")
    first = F.col("vector")[0]
    return back.where(~F.isnan(first) & (F.abs(first) != float("inf"))).orderBy("symbol_id").select("symbol_id", F.size("vector").alias("dim"), F.round(first.cast("double"), 6).alias("first_value"))


@query("SELECT c_custkey, c_acctbal, 'first' AS pinned_reads, 'second' AS lazy_reads FROM customer")
def snapshot_isolation(spark, d):
    """A writer publishes while two readers are open: the pinned one reads its
    version to the end, the one that looks up the newest table with each read
    sees the other version in its second half."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    root = scratch(spark)
    first = sources.publish(c.withColumn("said", F.lit("first")), root)
    mine = sources.pinned(spark, root, first)
    low = sources.pinned(spark, root).where("c_custkey % 2 = 0").select("c_custkey", F.col("said").alias("lazy"))
    sources.publish(c.withColumn("said", F.lit("second")), root)
    high = sources.pinned(spark, root).where("c_custkey % 2 = 1").select("c_custkey", F.col("said").alias("lazy"))
    both = low.withColumn("half", F.lit(0)).unionByName(high.withColumn("half", F.lit(1)))
    mixed = mine.join(both, "c_custkey").agg(F.count_if((F.col("half") == 0) & (F.col("lazy") == "first")).alias("a"), F.count_if((F.col("half") == 1) & (F.col("lazy") == "second")).alias("b"), F.count("*").alias("n"))
    ok = mixed.select((F.col("a") + F.col("b") == F.col("n")).alias("ok"))
    return mine.crossJoin(F.broadcast(ok)).select("c_custkey", "c_acctbal", F.col("said").alias("pinned_reads"), F.when(F.col("ok"), "second").otherwise("other").alias("lazy_reads"))
