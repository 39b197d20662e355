"""Queries for more tools of a code index, over symbols, the files and imports
made from them, documents and calls. Each answer is our design by the tool's
name and arguments, and has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import graph, index_tools, lexical, reads, topk
from tidemark.plans.measurements import CALLS, PROBES
from tidemark.plans.profiles import FILES_SQL, files_of, symbols_of
from tidemark.session import materialise, table
from tidemark.sources import files as sources

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Symbols with the parts of their names, in SQL.
_S = """s AS (SELECT *, split_part(id, '#', 2) AS kind, split_part(name, '.', 1) AS owner, regexp_extract(split_part(name, '.', 2), '^([a-z]+)', 1) AS verb, split_part(file, '/', 1) AS dir,
  coalesce(trim(summary), '') <> '' AS told FROM symbols)"""
_VECTORS = "v AS (SELECT symbol_id FROM symbol_embeddings WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
_ASKED = "(3, 8, 21, 34, 55)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c, by, n: F.split_part(F.col(c), F.lit(by), F.lit(n))
    return symbols_of(spark, d).withColumns({
        "kind": part("id", "#", 2), "owner": part("name", ".", 1), "verb": F.regexp_extract(part("name", ".", 2), "^([a-z]+)", 1), "dir": part("file", "/", 1),
        "told": F.coalesce(F.trim("summary"), F.lit("")) != "",
    })


def _asked(s: DataFrame) -> DataFrame:
    return s.where(f"ord IN {_ASKED}")


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(files_of(spark, d), path="path", imports="imports").distinct()


def _with_vector(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) == 96) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return table(spark, d, "symbol_embeddings").where(ok)


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- symbols ---------------------------------------------------------------


@query(f"SELECT id, name, file, summary, byte_length FROM symbols WHERE ord IN {_ASKED}")
def tool_symbol_source(spark, d):
    s = symbols_of(spark, d)
    ids = [x["id"] for x in _asked(s).select("id").collect()]
    return reads.in_list(s, "id", ids).select("id", "name", "file", "summary", "byte_length")


@query(f"""WITH {FILES_SQL}, a AS (SELECT id, file FROM symbols WHERE ord IN {_ASKED}) SELECT id, 'self' AS role, id AS key FROM a UNION ALL SELECT a.id, 'beside', s.id FROM a JOIN symbols s ON s.file = a.file AND s.id <> a.id AND s.ord < 40
  UNION ALL SELECT a.id, 'caller', imp.src FROM a JOIN imp ON imp.dst = a.file""")
def tool_context_bundle(spark, d):
    """The symbols asked for, those of the first forty in the same file, and the
    files that import it."""
    s = symbols_of(spark, d)
    a = _asked(s).select("id", "file")
    beside = a.join(s.where("ord < 40").select("file", F.col("id").alias("key")), "file").where("id != key")
    callers = a.join(_imports(spark, d), F.col("file") == F.col("dst"))
    return a.select("id", F.lit("self").alias("role"), F.col("id").alias("key")).unionByName(beside.select("id", F.lit("beside").alias("role"), "key")).unionByName(callers.select("id", F.lit("caller").alias("role"), F.col("src").alias("key")))


@query("SELECT file, count(*) AS n, md5(string_agg(ord || ':' || name || coalesce(' ' || summary, ''), chr(10) ORDER BY ord)) AS content FROM symbols WHERE file IN (SELECT file FROM symbols WHERE ord IN (2, 13)) GROUP BY file")
def tool_file_content(spark, d):
    """What is known of two files, line by line in order, by its hash."""
    s = symbols_of(spark, d)
    line = F.concat(F.col("ord").cast("string"), F.lit(":"), "name", F.coalesce(F.concat(F.lit(" "), "summary"), F.lit("")))
    f = reads.two_phase(s, "file", s.where("ord IN (2, 13)"), "file")
    return f.groupBy("file").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")).alias("content"))


@query(f"WITH {_S} SELECT id, len(regexp_extract_all(coalesce(summary, ''), '[A-Za-z]+')) AS n_words, coalesce(byte_length, 0) AS bytes, len(string_split(file, '/')) AS depth, round(ln(1 + coalesce(byte_length, 0)) * len(string_split(file, '/')), 6) AS complexity FROM s WHERE ord IN {_ASKED}")
def tool_symbol_complexity(spark, d):
    depth, size = F.size(F.split("file", "/")), F.coalesce("byte_length", F.lit(0))
    return _asked(_symbols(spark, d)).select("id", F.size(F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("n_words"), size.alias("bytes"), depth.alias("depth"), r(F.ln(1 + size) * depth).alias("complexity"))


@query(f"""WITH {_S}, a AS (SELECT * FROM s WHERE ord IN {_ASKED}), x AS (SELECT a.id, b.id AS related, (a.file = b.file)::INT + (a.owner = b.owner)::INT + (a.verb = b.verb)::INT AS score FROM a JOIN s b ON a.id <> b.id AND a.owner = b.owner)
  SELECT id, related, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, related) AS rank FROM x QUALIFY rank <= 5""")
def tool_related_symbols(spark, d):
    """For each asked symbol five of the same owner: those of its file and its
    verb first."""
    s = _symbols(spark, d)
    a = _asked(s).select(F.col("id").alias("a_id"), F.col("file").alias("a_file"), "owner", F.col("verb").alias("a_verb"))
    near = s.join(F.broadcast(a), "owner").where("id != a_id")  # five rows are asked for
    score = (F.col("file") == F.col("a_file")).cast("int") + 1 + (F.col("verb") == F.col("a_verb")).cast("int")
    x = near.select(F.col("a_id").alias("id"), F.col("id").alias("related"), score.alias("score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "related"))).where("rank <= 5")


@query("""WITH n AS (SELECT id, CASE WHEN ord % 10 = 0 THEN coalesce(byte_length, 0) + 1 ELSE byte_length END AS byte_length, CASE WHEN ord % 15 = 0 THEN 'changed' ELSE summary END AS summary FROM symbols WHERE ord % 10 <> 1),
  x AS (SELECT o.id, n.id IS NULL AS gone, o.byte_length::VARCHAR AS b0, n.byte_length::VARCHAR AS b1, o.summary AS s0, n.summary AS s1 FROM symbols o LEFT JOIN n USING (id))
  SELECT id, 'removed' AS field, NULL AS old, NULL AS new FROM x WHERE gone UNION ALL SELECT id, 'byte_length', b0, b1 FROM x WHERE NOT gone AND b0 IS DISTINCT FROM b1 UNION ALL SELECT id, 'summary', s0, s1 FROM x WHERE NOT gone AND s0 IS DISTINCT FROM s1""")
def tool_symbol_diff(spark, d):
    """Field by field between two states of the symbols, the second made up."""
    s = symbols_of(spark, d)
    new = s.where("ord % 10 <> 1").select("id", F.when(F.col("ord") % 10 == 0, F.coalesce("byte_length", F.lit(0)) + 1).otherwise(F.col("byte_length")).alias("b1"), F.when(F.col("ord") % 15 == 0, "changed").otherwise(F.col("summary")).alias("s1"), F.lit(True).alias("there"))
    x = s.join(new, "id", "left")
    cell = lambda f, a, b: F.struct(F.lit(f).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new"))
    none = F.lit(None)
    cells = F.when(F.col("there").isNull(), F.array(cell("removed", none, none))).otherwise(F.filter(F.array(cell("byte_length", F.col("byte_length"), F.col("b1")), cell("summary", F.col("summary"), F.col("s1"))), lambda c: ~c["old"].eqNullSafe(c["new"])))
    return x.select("id", F.inline(cells))


@query(f"WITH {_S} SELECT verb, count(DISTINCT owner) AS n_owners, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners, count(*) AS n FROM s WHERE verb <> '' GROUP BY verb HAVING count(DISTINCT owner) > 1")
def tool_find_implementations(spark, d):
    """Verbs that several owners implement."""
    return _symbols(spark, d).where("verb != ''").groupBy("verb").agg(F.count_distinct("owner").alias("n_owners"), F.array_join(F.sort_array(F.collect_set("owner")), ",").alias("owners"), F.count("*").alias("n")).where("n_owners > 1")


@query(f"WITH {_S}, c AS (SELECT owner, file, arg_min(id, ord) AS parent FROM s WHERE kind = 'class' GROUP BY ALL) SELECT s.owner, s.id, CASE WHEN c.parent = s.id THEN 0 WHEN c.parent IS NULL THEN -1 ELSE 1 END AS level, CASE WHEN c.parent <> s.id THEN c.parent END AS parent FROM s LEFT JOIN c ON c.owner = s.owner AND c.file = s.file")
def tool_class_hierarchy(spark, d):
    """Each symbol below the first class of its owner in its file; level 0 for
    that class, -1 where there is none."""
    s = _symbols(spark, d)
    c = s.where("kind = 'class'").groupBy("owner", "file").agg(F.min_by("id", "ord").alias("p"))
    j = s.join(c, ["owner", "file"], "left")
    return j.select("owner", "id", F.when(F.col("p") == F.col("id"), 0).when(F.col("p").isNull(), -1).otherwise(1).alias("level"), F.when(F.col("p") != F.col("id"), F.col("p")).alias("parent"))


@query(f"WITH {_S} SELECT dir, kind, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY dir), 6) AS percent FROM s GROUP BY dir, kind")
def tool_decorator_census(spark, d):
    """Kinds of symbols by top folder; one row per folder and kind is windowed."""
    g = _symbols(spark, d).groupBy("dir", "kind").agg(F.count("*").alias("n"))
    return g.withColumn("percent", r(100 * F.col("n") / F.sum("n").over(Window.partitionBy("dir"))))


@query(f"""WITH {_S}, t AS (SELECT DISTINCT owner, verb FROM s WHERE dir = 'tests') SELECT id, owner, verb FROM s WHERE dir <> 'tests' AND NOT EXISTS (SELECT 1 FROM t WHERE t.owner = s.owner AND t.verb = s.verb)""")
def tool_untested_symbols(spark, d):
    """Symbols outside tests whose owner and verb no test has."""
    s = _symbols(spark, d).withColumnRenamed("owner", "o")
    u = index_tools.untested(s, "file", F.concat(index_tools.owner(F.col("name")), F.lit(" "), "verb"))
    return u.select("id", F.col("o").alias("owner"), "verb")


@query(f"""WITH {FILES_SQL}, {_S}, {_VECTORS}, g AS (SELECT id, (NOT told)::INT AS silent, (file NOT IN (SELECT dst FROM imp))::INT AS unused, (id NOT IN (SELECT symbol_id FROM v))::INT AS blind, (byte_length IS NULL)::INT AS unsized FROM s)
  SELECT id, silent, unused, blind, unsized FROM g WHERE silent + unused + blind + unsized >= 1 AND silent = 1""")
def tool_dead_code(spark, d):
    """Symbols that nothing describes, with what else speaks against them: their
    file is not imported, they have no usable vector, no size."""
    s = _symbols(spark, d).where("NOT told")
    used = _imports(spark, d).select(F.col("dst").alias("file"), F.lit(0).alias("unused")).distinct()
    seen = _with_vector(spark, d).select(F.col("symbol_id").alias("id"), F.lit(0).alias("blind"))
    j = s.join(used, "file", "left").join(seen, "id", "left")
    return j.select("id", F.lit(1).alias("silent"), F.coalesce("unused", F.lit(1)).alias("unused"), F.coalesce("blind", F.lit(1)).alias("blind"), F.col("byte_length").isNull().cast("int").alias("unsized"))


@query(f"""WITH {FILES_SQL}, {_S}, n AS (SELECT file, count(*) AS n, count(*) FILTER (NOT told) AS silent FROM s GROUP BY file), x AS (SELECT f.path, coalesce((SELECT count(*) FROM imp WHERE dst = f.path AND src <> f.path), 0) AS n_importers FROM files f)
  SELECT path, n_importers, n AS n_symbols, round(silent / n, 6) AS silent_share, round(1 / (1 + n_importers) + silent / n, 6) AS score FROM x JOIN n ON n.file = x.path ORDER BY score DESC, path LIMIT 20""")
def tool_dead_code_v2(spark, d):
    """Files graded by how little is imported from them and said of them."""
    n = _symbols(spark, d).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n_symbols"), F.count_if(~F.col("told")).alias("silent"))
    importers = _imports(spark, d).where("src != dst").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("k"))
    x = n.where("path IS NOT NULL").join(importers, "path", "left").withColumn("n_importers", F.coalesce("k", F.lit(0)))
    share = F.col("silent") / F.col("n_symbols")
    return x.select("path", "n_importers", "n_symbols", r(share).alias("silent_share"), r(1 / (1 + F.col("n_importers")) + share).alias("score")).orderBy(F.desc("score"), "path").limit(20)


@query("""WITH v AS (SELECT s.ord, e.embedding FROM symbols s JOIN (SELECT symbol_id, embedding FROM symbol_embeddings WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) e ON e.symbol_id = s.id)
  SELECT q.ord AS query, v.ord AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM v, v q WHERE q.ord % 20 = 0 AND v.ord <> q.ord AND list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.95""")
def tool_similar_symbols(spark, d):
    """Symbols at a cosine of 0.95 at least from those whose number is divisible
    by 20."""
    v = symbols_of(spark, d).select("ord", "id").join(_with_vector(spark, d).withColumnRenamed("symbol_id", "id"), "id").select("ord", "embedding")
    s = topk.pair_scores(v, v.where("ord % 20 = 0"), id_col="ord", vector="embedding", least=0.95)
    return s.where("query != id").select("query", "id", r("exact").alias("score"))


@query(f"""WITH {FILES_SQL}, a AS (SELECT id, file, name FROM symbols WHERE ord IN {_ASKED}), x AS (SELECT id, (SELECT count(*) FROM imp WHERE dst = a.file AND src <> a.file) AS n_importers, (SELECT count(*) FROM symbols s WHERE s.name = a.name AND s.id <> a.id) AS n_same_name FROM a)
  SELECT *, n_importers = 0 AS safe FROM x""")
def tool_check_delete_safe(spark, d):
    s = symbols_of(spark, d)
    a = _asked(s).select("id", "file", "name")
    importers = _imports(spark, d).where("src != dst").groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n1"))
    named = s.groupBy("name").agg(F.count("*").alias("n2"))
    x = a.join(importers, "file", "left").join(named, "name", "left")
    n = F.coalesce("n1", F.lit(0))
    return x.select("id", n.alias("n_importers"), (F.col("n2") - 1).alias("n_same_name"), (n == 0).alias("safe"))


@query(f"""WITH {_S}, a AS (SELECT id, owner || '.' || verb || '_001' AS new_name FROM s WHERE ord IN {_ASKED} OR ord = 2) SELECT id, new_name, (SELECT count(*) FROM symbols s WHERE lower(s.name) = lower(a.new_name) AND s.id <> a.id) AS n_taken,
  (SELECT count(*) FROM symbols s WHERE lower(s.name) = lower(a.new_name) AND s.id <> a.id) = 0 AS safe FROM a""")
def tool_check_rename_safe(spark, d):
    """Whether a new name, made up, is free in any case."""
    s = _symbols(spark, d)
    a = s.where(f"ord IN {_ASKED} OR ord = 2").select("id", F.concat("owner", F.lit("."), "verb", F.lit("_001")).alias("new_name"))
    taken = a.join(s.select(F.col("id").alias("other"), F.lower("name").alias("low")), (F.lower("new_name") == F.col("low")) & (F.col("id") != F.col("other"))).groupBy("id").agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    return a.join(taken, "id", "left").select("id", "new_name", n.alias("n_taken"), (n == 0).alias("safe"))


@query(f"""WITH {FILES_SQL}, a AS (SELECT id, file FROM symbols WHERE ord IN {_ASKED}), one AS (SELECT DISTINCT a.id, imp.src FROM a JOIN imp ON imp.dst = a.file WHERE imp.src <> a.file), two AS (SELECT DISTINCT one.id, imp.src FROM one JOIN imp ON imp.dst = one.src)
  SELECT a.id, (SELECT count(*) FROM (SELECT src FROM one WHERE one.id = a.id UNION SELECT src FROM two WHERE two.id = a.id) WHERE src <> a.file) AS n_reached, (SELECT count(*) FROM one WHERE one.id = a.id AND starts_with(src, 'tests/')) AS n_tests FROM a""")
def tool_check_edit_safe(spark, d):
    """How many files an edit reaches in two steps, and how many tests import its
    file."""
    e = _imports(spark, d)
    a = _asked(symbols_of(spark, d)).select("id", "file")
    one = a.join(e, F.col("file") == F.col("dst")).where("src != file").select("id", "file", "src").distinct()
    two = one.select("id", "file", F.col("src").alias("via")).join(e, F.col("via") == F.col("dst")).where("src != file").select("id", "file", "src").distinct()
    n = one.unionByName(two).distinct().groupBy("id").agg(F.count("*").alias("k"))
    t = one.where(F.startswith("src", F.lit("tests/"))).groupBy("id").agg(F.count("*").alias("m"))
    return a.select("id").join(n, "id", "left").join(t, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n_reached"), F.coalesce("m", F.lit(0)).alias("n_tests"))


# --- files and imports -----------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT DISTINCT dst AS file, src AS importer FROM imp WHERE dst IN (SELECT file FROM symbols WHERE ord IN (2, 13))")
def tool_find_importers(spark, d):
    return reads.two_phase(_imports(spark, d), "dst", symbols_of(spark, d).where("ord IN (2, 13)"), "file").select(F.col("dst").alias("file"), F.col("src").alias("importer"))


@query(f"""WITH {FILES_SQL}, w AS (SELECT unnest(['Snapshot', 'ledger', 'Nobody']) AS word) SELECT word, (SELECT count(*) FROM symbols WHERE lower(split_part(name, '.', 1)) = lower(word)) AS n_definitions,
  (SELECT count(DISTINCT path) FROM uses WHERE lower(name) = lower(word)) AS n_importing, (SELECT count(*) FROM documents WHERE contains(lower(text), lower(word))) AS n_documents FROM w""")
def tool_check_references(spark, d):
    """Definitions, importing files and documents of identifiers, in any case."""
    words = ["Snapshot", "ledger", "Nobody"]
    low = [w.lower() for w in words]
    own = F.lower(F.split_part("name", F.lit("."), F.lit(1)))
    defs = symbols_of(spark, d).agg(*[F.count_if(own == w).alias(f"d{i}") for i, w in enumerate(low)])
    f = files_of(spark, d).select(F.from_json("imports", "array<struct<specifier:string,names:array<string>>>").alias("i"))
    uses = f.agg(*[F.count_if(F.coalesce(F.exists("i", _names(w)), F.lit(False))).alias(f"u{i}") for i, w in enumerate(low)])
    docs = table(spark, d, "documents").agg(*[F.count_if(F.contains(F.lower("text"), F.lit(w))).alias(f"t{i}") for i, w in enumerate(low)])
    one = defs.crossJoin(uses).crossJoin(docs)  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"d{i}").alias("n_definitions"), F.col(f"u{i}").alias("n_importing"), F.col(f"t{i}").alias("n_documents")) for i, w in enumerate(words)])))


def _names(w: str):
    return lambda x: F.exists(x["names"], lambda n: F.lower(n) == F.lit(w))


@query(f"""WITH {FILES_SQL}, {_S}, n AS (SELECT file, count(*) AS n, count(*) FILTER (NOT told) AS silent, coalesce(sum(byte_length), 0) AS bytes FROM s GROUP BY file), i AS (SELECT dst, count(*) AS k FROM imp WHERE src <> dst GROUP BY dst)
  SELECT file, n AS n_symbols, bytes::BIGINT AS bytes, coalesce(k, 0) AS n_importers, round(0.4 * silent / n + 0.3 * least(1, bytes / 20000) + 0.3 * least(1, coalesce(k, 0) / 10), 6) AS risk FROM n LEFT JOIN i ON i.dst = n.file WHERE file IS NOT NULL""")
def tool_file_risk(spark, d):
    """Silent symbols, size and importers of every file, weighted."""
    n = _symbols(spark, d).where("file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n_symbols"), F.count_if(~F.col("told")).alias("silent"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))
    i = _imports(spark, d).where("src != dst").groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    risk = 0.4 * F.col("silent") / F.col("n_symbols") + 0.3 * F.least(F.lit(1.0), F.col("bytes") / 20000) + 0.3 * F.least(F.lit(1.0), k / 10)
    return n.join(i, "file", "left").select("file", "n_symbols", "bytes", k.alias("n_importers"), r(risk).alias("risk"))


@query(f"""WITH {FILES_SQL}, {_S}, d AS (SELECT dir, count(DISTINCT file) AS n_files, count(*) AS n_symbols FROM s WHERE file IS NOT NULL GROUP BY dir), x AS (SELECT split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS b FROM imp)
  SELECT dir, n_files, n_symbols, (SELECT count(*) FROM x WHERE a = dir AND b <> dir) AS n_out, (SELECT count(*) FROM x WHERE b = dir AND a <> dir) AS n_in, (SELECT count(*) FROM x WHERE a = dir AND b = dir) AS n_within FROM d""")
def tool_architecture_metrics(spark, d):
    """Folders, and the imports among and within them."""
    n = _symbols(spark, d).where("file IS NOT NULL").groupBy("dir").agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_symbols"))
    top = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    x = _imports(spark, d).select(top("src").alias("a"), top("dst").alias("b"))
    ends = x.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("dir"), F.lit("w").alias("way")))).otherwise(F.array(F.struct(F.col("a").alias("dir"), F.lit("o").alias("way")), F.struct(F.col("b").alias("dir"), F.lit("i").alias("way"))))).alias("e")).select("e.*")
    g = ends.groupBy("dir").agg(F.count_if(F.col("way") == "o").alias("o"), F.count_if(F.col("way") == "i").alias("i"), F.count_if(F.col("way") == "w").alias("w"))
    zero = F.lit(0)
    return n.join(g, "dir", "left").select("dir", "n_files", "n_symbols", F.coalesce("o", zero).alias("n_out"), F.coalesce("i", zero).alias("n_in"), F.coalesce("w", zero).alias("n_within"))


@query(f"""WITH {FILES_SQL}, a AS (SELECT min(dst) AS f FROM imp), u1 AS (SELECT DISTINCT src AS node FROM imp, a WHERE dst = f AND src <> f), u2 AS (SELECT DISTINCT src AS node FROM imp WHERE dst IN (SELECT node FROM u1)),
  d1 AS (SELECT DISTINCT dst AS node FROM imp, a WHERE src = f AND dst <> f), d2 AS (SELECT DISTINCT dst AS node FROM imp WHERE src IN (SELECT node FROM d1))
  SELECT 'callers' AS way, node, 1 AS depth FROM u1 UNION ALL SELECT 'callers', node, 2 FROM u2, a WHERE node <> f AND node NOT IN (SELECT node FROM u1)
  UNION ALL SELECT 'callees', node, 1 FROM d1 UNION ALL SELECT 'callees', node, 2 FROM d2, a WHERE node <> f AND node NOT IN (SELECT node FROM d1)""")
def tool_call_hierarchy(spark, d):
    """Two steps up and down from the first imported file."""
    e = materialise(_imports(spark, d))
    start = e.agg(F.min("dst").alias("node"))
    up, down = (graph.reach(e, start, 2, reverse=way).where("depth > 0").withColumn("way", F.lit(n)) for way, n in ((True, "callers"), (False, "callees")))
    return up.unionByName(down).select("way", "node", "depth")


@query(f"""WITH {FILES_SQL}, c AS (SELECT DISTINCT file FROM symbols WHERE ord % 200 = 0), one AS (SELECT DISTINCT src AS node FROM imp WHERE dst IN (SELECT file FROM c) AND src NOT IN (SELECT file FROM c)),
  all_ AS (SELECT file AS node, 0 AS depth FROM c UNION ALL SELECT node, 1 FROM one) SELECT node AS file, depth, (SELECT count(*) FROM symbols WHERE file = node) AS n_symbols FROM all_""")
def tool_impact_preview(spark, d):
    """Files of changed symbols, those that import them, and their symbols."""
    s = symbols_of(spark, d)
    near = graph.reach(_imports(spark, d), s.where("ord % 200 = 0 AND file IS NOT NULL").select(F.col("file").alias("node")), 1, reverse=True)
    n = s.groupBy(F.col("file").alias("node")).agg(F.count("*").alias("n_symbols"))
    return near.join(n, "node").select(F.col("node").alias("file"), "depth", "n_symbols")


@query(f"""WITH RECURSIVE {FILES_SQL}, c AS (SELECT src, dst FROM imp UNION SELECT c.src, imp.dst FROM c JOIN imp ON c.dst = imp.src), p AS (SELECT path, coalesce((SELECT max(a.dst) FROM c a WHERE a.src = path AND EXISTS (SELECT 1 FROM c b WHERE b.src = a.dst AND b.dst = path)), path) AS m FROM (SELECT src AS path FROM imp UNION SELECT dst FROM imp))
  SELECT greatest(m, path) AS plate, count(*) AS n_files FROM p GROUP BY 1""")
def tool_tectonic_map(spark, d):
    """Plates: files that import each other in circles, by their greatest."""
    return graph.components(_imports(spark, d)).groupBy(F.col("component").alias("plate")).agg(F.count("*").alias("n_files"))


@query(f"""WITH {_S}, g AS (SELECT file, owner, count(*) AS n, coalesce(sum(byte_length), 0)::BIGINT AS bytes FROM s WHERE file IS NOT NULL GROUP BY ALL), t AS (SELECT file, sum(n) AS all_n FROM g GROUP BY file)
  SELECT file, owner, n, bytes, round(n / all_n, 6) AS share FROM g JOIN t USING (file) WHERE n / all_n >= 0.1 ORDER BY bytes DESC, file, owner LIMIT 25""")
def tool_extraction_candidates(spark, d):
    """Owners that hold a tenth of a file at least, the largest first."""
    g = _symbols(spark, d).where("file IS NOT NULL").groupBy("file", "owner").agg(F.count("*").alias("n"), F.coalesce(F.sum("byte_length"), F.lit(0)).alias("bytes"))
    g = g.withColumn("x", F.col("n") / F.sum("n").over(Window.partitionBy("file")))
    return g.where("x >= 0.1").select("file", "owner", "n", "bytes", r("x").alias("share")).orderBy(F.desc("bytes"), "file", "owner").limit(25)


@query(f"""WITH {FILES_SQL}, {_S}, c AS (SELECT dir, count(*) FILTER (ord % 10 IN (0, 1)) AS changed, count(*) AS n, coalesce(sum(byte_length) FILTER (ord % 10 IN (0, 1)), 0)::BIGINT AS bytes FROM s WHERE file IS NOT NULL GROUP BY dir),
  i AS (SELECT split_part(dst, '/', 1) AS dir, count(DISTINCT src) AS k FROM imp WHERE dst IN (SELECT file FROM symbols WHERE ord % 10 IN (0, 1)) GROUP BY 1)
  SELECT dir, changed, bytes, coalesce(k, 0) AS n_importers, round(changed / n + ln(1 + bytes) / 20 + coalesce(k, 0) / 100, 6) AS risk FROM c LEFT JOIN i USING (dir)""")
def tool_pr_risk_profile(spark, d):
    """A change of every symbol numbered 0 or 1 in its ten, by top folder."""
    s = _symbols(spark, d).where("file IS NOT NULL")
    hit = F.col("ord") % 10 < 2
    c = s.groupBy("dir").agg(F.count_if(hit).alias("changed"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(hit, F.col("byte_length"))), F.lit(0)).alias("bytes"))
    e = reads.two_phase(_imports(spark, d), "dst", s.where(hit), "file").groupBy(F.split_part("dst", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count_distinct("src").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return c.join(e, "dir", "left").select("dir", "changed", "bytes", k.alias("n_importers"), r(F.col("changed") / F.col("n") + F.ln(1 + F.col("bytes")) / 20 + k / 100).alias("risk"))


@query(f"""WITH {_S}, k AS (SELECT dir, id, coalesce(byte_length, 0) AS bytes, row_number() OVER (PARTITION BY dir ORDER BY coalesce(byte_length, 0) DESC, id) AS rank FROM s WHERE file IS NOT NULL) SELECT dir, rank, id, bytes FROM k WHERE rank <= 3""")
def tool_repo_map(spark, d):
    """The three largest symbols of every top folder."""
    s = _symbols(spark, d).where("file IS NOT NULL").select("dir", "id", F.coalesce("byte_length", F.lit(0)).alias("bytes"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("bytes"), "id"))).where("rank <= 3").select("dir", "rank", "id", "bytes")


@query(f"""WITH {FILES_SQL}, l AS (SELECT path, len(string_split(path, '/')) AS level FROM files), f AS (SELECT DISTINCT s.file FROM symbols s WHERE split_part(s.name, '.', 1) = 'Snapshot')
  SELECT path, (SELECT count(*) FROM imp WHERE src = path AND dst <> path) AS n_first, row_number() OVER (ORDER BY (SELECT count(*) FROM imp WHERE src = path AND dst <> path), path) AS step FROM files WHERE path IN (SELECT file FROM f)""")
def tool_plan_refactoring(spark, d):
    """In which order the files of one owner are taken: those that import the
    fewest first. Steps come from a count over few files of one owner."""
    own = _symbols(spark, d).where("owner = 'Snapshot' AND file IS NOT NULL").select(F.col("file").alias("path")).distinct()
    n = _imports(spark, d).where("src != dst").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("k"))
    x = own.join(n, "path", "left").select("path", F.coalesce("k", F.lit(0)).alias("n_first"))
    return reads.numbered(x, ["n_first", "path"]).select("path", "n_first", (F.col("position") + 1).alias("step"))


# --- the whole repository --------------------------------------------------


@query(f"WITH {_S} SELECT regexp_extract(file, '\\.([a-z]+)$', 1) AS extension, kind, count(*) AS n, count(DISTINCT file) AS n_files, count(DISTINCT owner) AS n_owners FROM s WHERE file IS NOT NULL GROUP BY ALL")
def tool_project_intel(spark, d):
    return _symbols(spark, d).where("file IS NOT NULL").groupBy(F.regexp_extract("file", r"\.([a-z]+)$", 1).alias("extension"), "kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"), F.count_distinct("owner").alias("n_owners"))


@query(f"WITH {_S}, {_VECTORS} SELECT count(*) AS n_symbols, round(avg(told::INT), 6) AS told, round(avg((byte_length IS NOT NULL)::INT), 6) AS sized, round(avg((v.symbol_id IS NOT NULL)::INT), 6) AS with_vector, round(avg((dir = 'tests')::INT), 6) AS tests FROM s LEFT JOIN v ON v.symbol_id = s.id")
def tool_repo_health(spark, d):
    s = _symbols(spark, d).join(_with_vector(spark, d).select(F.col("symbol_id").alias("id"), F.lit(True).alias("vec")), "id", "left")
    share = lambda c: r(F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    return s.agg(F.count("*").alias("n_symbols"), share(F.col("told")).alias("told"), share(F.col("byte_length").isNotNull()).alias("sized"), share(F.col("vec")).alias("with_vector"), share(F.col("dir") == "tests").alias("tests"))


@query(f"WITH {_S} SELECT count(*) AS n_symbols, count(DISTINCT file) AS n_files, count(DISTINCT owner) AS n_owners, sum(byte_length)::BIGINT AS bytes, (SELECT count(*) FROM {CALLS}) AS n_calls, (SELECT strftime(max(recorded_at), '%Y-%m-%dT%H:%M:%SZ') FROM {CALLS}) AS last_call FROM s")
def tool_digest(spark, d):
    """One line on all that is indexed and measured."""
    a = _symbols(spark, d).agg(F.count("*").alias("n_symbols"), F.count_distinct("file").alias("n_files"), F.count_distinct("owner").alias("n_owners"), F.sum("byte_length").alias("bytes"))
    b = table(spark, d, CALLS).agg(F.count("*").alias("n_calls"), T.utc_stamp(F.date_trunc("second", F.max("recorded_at"))).alias("last_call"))
    return a.crossJoin(b)  # one row each


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_schema = 'main' AND contains(lower(column_name), 'repo')")
def tool_search_columns(spark, d):
    return sources.catalog(spark, d).where(F.contains(F.lower("column_name"), F.lit("repo"))).select("table_name", "column_name")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9]+'))) AS word FROM symbols) WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 10")
def tool_suggest_queries(spark, d):
    """Words that the most summaries have."""
    w = symbols_of(spark, d).select(F.explode(F.array_distinct(lexical.tokens(F.col("summary")))).alias("word")).where("length(word) > 3")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query(f"""WITH w AS (SELECT ord, id, coalesce(byte_length, 0) AS bytes, regexp_extract_all(lower(name || ' ' || coalesce(summary, '')), '[a-z0-9]+') AS t FROM symbols), m AS (SELECT count(*) AS n, avg(len(t)) AS l FROM w), q AS (SELECT unnest(['snapshot', 'overlay']) AS term),
  tf AS (SELECT ord, id, bytes, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM w, q), df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
  b AS (SELECT ord, id, bytes, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / l))), 6) AS score FROM tf JOIN df USING (term), m WHERE f > 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM b QUALIFY rank <= 50)
  SELECT rank, id, score, used FROM (SELECT rank, id, score, sum(bytes) OVER (ORDER BY rank)::BIGINT AS used FROM k) WHERE used <= 8000""")
def tool_assemble_task_context(spark, d):
    """The best symbols for a task's words, as many as a budget of bytes holds;
    the running sum is over the first fifty."""
    s = symbols_of(spark, d).select("ord", "id", F.coalesce("byte_length", F.lit(0)).alias("bytes"), F.concat_ws(" ", "name", F.coalesce("summary", F.lit(""))).alias("txt"))
    b = lexical.bm25(s, key="ord", text="txt", words=["snapshot", "overlay"]).withColumn("score", r("score"))
    best = b.orderBy(F.desc("score"), "ord").limit(50).join(s.select("ord", "id", "bytes"), "ord")
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))
    return best.withColumn("used", F.sum("bytes").over(Window.orderBy("rank"))).where("used <= 8000").select("rank", "id", "score", "used")


@query("""WITH s AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s\\-_]+', '_', 'g') AS source FROM documents WHERE source IS NOT NULL), t AS (SELECT *, regexp_replace(lower(trim(source)), '[\\s\\-_]+', '_', 'g') AS n FROM mix_targets), w AS (SELECT sum(target_weight) AS w FROM mix_targets)
  SELECT t.source, s.source IS NOT NULL AS known, target_weight > 0 AND target_weight <= 1 AS weight_ok, max_repeats >= 1 AS repeats_ok, abs(w - 1) < 1e-6 AS adds_up FROM t LEFT JOIN s ON s.source = t.n, w""")
def tool_audit_agent_config(spark, d):
    """The settings in mix_targets against what they are about."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")
    known = table(spark, d, "documents").where("source IS NOT NULL").select(plain(F.col("source")).alias("n"), F.lit(True).alias("known")).distinct()
    t = table(spark, d, "mix_targets").withColumn("n", plain(F.col("source")))
    total = t.agg((F.abs(F.sum("target_weight") - 1) < 1e-6).alias("adds_up"))
    return t.join(known, "n", "left").crossJoin(F.broadcast(total)).select("source", F.coalesce("known", F.lit(False)).alias("known"), F.col("target_weight").between(1e-300, 1).alias("weight_ok"), (F.col("max_repeats") >= 1).alias("repeats_ok"), "adds_up")


# --- calls -----------------------------------------------------------------


@query(f"SELECT repo_name, count(*) AS n_calls, count(DISTINCT \"case\") AS n_cases, strftime(min(recorded_at), '%Y-%m-%dT%H:%M:%SZ') AS first_call, strftime(max(recorded_at), '%Y-%m-%dT%H:%M:%SZ') AS last_call FROM {CALLS} GROUP BY repo_name")
def tool_list_workspaces(spark, d):
    stamp = lambda c: T.utc_stamp(F.date_trunc("second", c))
    return table(spark, d, CALLS).groupBy("repo_name").agg(F.count("*").alias("n_calls"), F.count_distinct("case").alias("n_cases"), stamp(F.min("recorded_at")).alias("first_call"), stamp(F.max("recorded_at")).alias("last_call"))


@query(f"SELECT repo_name, strftime(date_trunc('week', recorded_at), '%Y-%m-%d') AS week, count(DISTINCT measurement_id) AS n, round(avg(load_calls), 6) AS load_calls, round(count(canonical_response_hash) / count(*), 6) AS answered FROM {CALLS} GROUP BY ALL")
def tool_delivery_metrics(spark, d):
    """What each repository delivered, week by week."""
    t = table(spark, d, CALLS).select("repo_name", F.date_format(F.date_trunc("week", "recorded_at"), "yyyy-MM-dd").alias("week"), "measurement_id", "load_calls", "canonical_response_hash")
    return t.groupBy("repo_name", "week").agg(F.count_distinct("measurement_id").alias("n"), r(F.avg("load_calls")).alias("load_calls"), r(F.count("canonical_response_hash") / F.count("*")).alias("answered"))


@query(f"""WITH x AS (SELECT repo_name, 1 AS c, 0 AS p, 0 AS t FROM {CALLS} UNION ALL SELECT repo_name, 0, 1, 0 FROM {PROBES} UNION ALL SELECT repo_name, 0, 0, 1 FROM documents)
  SELECT repo_name, sum(c)::BIGINT AS n_calls, sum(p)::BIGINT AS n_probes, sum(t)::BIGINT AS n_documents FROM x GROUP BY repo_name HAVING sum(c) > 0 OR sum(t) > 1""")
def tool_cross_repo_map(spark, d):
    """Where each repository turns up. NULL is a name of its own."""
    count = lambda t, i: table(spark, d, t).groupBy("repo_name").agg(F.count("*").alias("n")).select("repo_name", *[(F.col("n") if j == i else F.lit(0)).cast("long").alias(c) for j, c in enumerate("cpt")])
    x = count(CALLS, 0).unionByName(count(PROBES, 1)).unionByName(count("documents", 2))
    return x.groupBy("repo_name").agg(F.sum("c").alias("n_calls"), F.sum("p").alias("n_probes"), F.sum("t").alias("n_documents")).where("n_calls > 0 OR n_documents > 1")


@query(f"SELECT tool, count(DISTINCT \"case\") AS n_cases, count(DISTINCT repo_name) AS n_repos, count(DISTINCT profile) AS n_profiles, max(load_calls) AS most_loads FROM {CALLS} GROUP BY tool")
def tool_endpoint_impact(spark, d):
    return table(spark, d, CALLS).groupBy("tool").agg(F.count_distinct("case").alias("n_cases"), F.count_distinct("repo_name").alias("n_repos"), F.count_distinct("profile").alias("n_profiles"), F.max("load_calls").alias("most_loads"))


@query(f"""WITH h AS (SELECT repo_name, tool, "case", count(DISTINCT canonical_response_hash) AS k, count(DISTINCT mode) AS m FROM {CALLS} WHERE regexp_full_match(canonical_response_hash, '[0-9a-f]{{64}}') GROUP BY ALL)
  SELECT repo_name, tool, count(*) AS n_cases, count(*) FILTER (k = 1) AS n_kept, count(*) FILTER (k = 1 AND m > 1) AS n_kept_by_all FROM h GROUP BY ALL""")
def tool_group_contracts(spark, d):
    """Cases of a tool whose answers are one and the same, in all modes."""
    t = table(spark, d, CALLS).where(F.col("canonical_response_hash").rlike("^[0-9a-f]{64}$"))
    h = t.groupBy("repo_name", "tool", "case").agg(F.count_distinct("canonical_response_hash").alias("k"), F.count_distinct("mode").alias("m"))
    return h.groupBy("repo_name", "tool").agg(F.count("*").alias("n_cases"), F.count_if(F.col("k") == 1).alias("n_kept"), F.count_if((F.col("k") == 1) & (F.col("m") > 1)).alias("n_kept_by_all"))


@query(f"""WITH h AS (SELECT repo_name, "case", mode, list_sort(list(DISTINCT canonical_response_hash)) AS hs FROM {CALLS} WHERE canonical_response_hash IS NOT NULL GROUP BY ALL), b AS (SELECT * FROM h WHERE mode = 'baseline_full')
  SELECT h.repo_name, h."case", h.mode, h.hs = b.hs AS same, len(list_intersect(h.hs, b.hs)) AS n_shared FROM h JOIN b USING (repo_name, "case") WHERE h.mode <> 'baseline_full'""")
def tool_parity_map(spark, d):
    """Answers of every mode against those of the baseline, case by case. Hashes
    of a case are a set of distinct ones, gathered in each task first."""
    h = table(spark, d, CALLS).where("canonical_response_hash IS NOT NULL").groupBy("repo_name", "case", "mode").agg(F.sort_array(F.collect_set("canonical_response_hash")).alias("hs"))
    b = h.where("mode = 'baseline_full'").select("repo_name", "case", F.col("hs").alias("b"))
    return h.where("mode != 'baseline_full'").join(b, ["repo_name", "case"]).select("repo_name", "case", "mode", (F.col("hs") == F.col("b")).alias("same"), F.size(F.array_intersect("hs", "b")).alias("n_shared"))
