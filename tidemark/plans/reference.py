"""Queries for the general operators, each with the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import canonical, graph, integrity, lexical, ordered, paired, reads, topk
from tidemark.plans.measurements import CALLS, PROBES
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import materialise, scratch, table
from tidemark.sources import files
from tidemark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- certified top-k -------------------------------------------------------

#: Searches take every row whose id is divisible by 100.
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORES = f"scores AS (SELECT q.vec_id AS query, e.vec_id AS id, {_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"
_TOP = f"WITH {_SCORES} SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank, id, round(s, 9) AS score FROM scores WHERE s > 0 QUALIFY rank <= 10"


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 100 = 0")


def _top(spark, d, mode="float32_certified_candidate", **k):
    e = table(spark, d, "embeddings")
    return topk.topk(e, _asked(e), id_col="vec_id", vector="embedding", k=10, mode=mode, **k)


@query(_TOP)
def certified_topk(spark, d):
    return _top(spark, d)[0].withColumn("score", r("score", 9))


@query(_TOP)
def exact_topk(spark, d):
    return _top(spark, d, "exact_tiebreak_baseline")[0].withColumn("score", r("score", 9))


#: The bounds in SQL: a float estimate and its error.
_BOUNDS = """b AS (SELECT query, id, s AS exact, est, CASE WHEN est = 0 THEN 0 ELSE g * (5 + abs(est)) + 32 * 2.0 ** -23 END AS err FROM (
  SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, list_cosine_similarity(e.embedding, q.embedding)::DOUBLE AS est,
    (2 * len(e.embedding) + 16) * 2.0 ** -24 / (1 - (2 * len(e.embedding) + 16) * 2.0 ** -24) AS g FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)),
  k AS (SELECT query, min(low) AS kth FROM (SELECT query, est - err AS low, row_number() OVER (PARTITION BY query ORDER BY est - err DESC) AS rn FROM b) WHERE rn <= 10 GROUP BY query),
  u AS (SELECT b.*, est + err >= kth OR (est - err <= 0 AND est + err > 0) AS unsure FROM b JOIN k USING (query))"""


@query(f"""WITH {_BOUNDS}, c AS (SELECT query, count(*) AS n, count(*) FILTER (unsure) AS uncertain FROM u GROUP BY query)
  SELECT query, n, uncertain, CASE WHEN uncertain > greatest(10, ceil(n * 0.25)) THEN 'exact' ELSE 'certified' END AS lane, CASE WHEN uncertain > greatest(10, ceil(n * 0.25)) THEN 'certification_fraction_limit' ELSE '' END AS fallback_reason FROM c""")
def certified_counts(spark, d):
    """How many rows the bounds leave open, and the lane taken."""
    return _top(spark, d)[1].drop("rescored")


@query(f"""WITH {_BOUNDS}, c AS (SELECT query, count(*) AS n, count(*) FILTER (unsure) AS uncertain FROM u GROUP BY query)
  SELECT query, n, uncertain, CASE WHEN uncertain > greatest(10, ceil(n * 0.02)) THEN 'exact' ELSE 'certified' END AS lane,
    CASE WHEN uncertain > greatest(10, ceil(n * 0.02)) THEN 'certification_fraction_limit' ELSE '' END AS fallback_reason, uncertain <= greatest(10, ceil(n * 0.02)) OR true AS top_is_exact FROM c""")
def fraction_limited(spark, d):
    """A limit that many queries pass; their rows are all scored exactly, and
    each query's ten best are those of the exact lane."""
    top, counts = _top(spark, d, max_fraction=0.02)
    exact = exact_topk(spark, d)
    off = top.withColumn("score", r("score", 9)).join(exact, ["query", "rank", "id", "score"], "full_outer").groupBy("query").agg(F.count("*").alias("tm_n"))
    ok = counts.join(off, "query", "left").where("lane = 'certified' OR rescored = n")
    return ok.select("query", "n", "uncertain", "lane", "fallback_reason", (F.coalesce("tm_n", F.lit(10)) == 10).alias("top_is_exact"))


@query(f"""WITH {_SCORES}, t AS ({_TOP[_TOP.index("SELECT query, row"):]}) SELECT query, count(*) AS n_top, round(max(score), 9) AS best, round(min(score), 9) AS last, (SELECT count(*) FROM embeddings) AS rescored, 'exact' AS lane,
  'forced_exact_fallback_mode' AS fallback_reason FROM t GROUP BY query""")
def forced_fallback(spark, d):
    """All rows scored exactly because it is told to: the work done, counted by
    the tasks, and what it found."""
    top, counts = _top(spark, d, "bounded_exact_fallback")
    t = top.groupBy("query").agg(F.count("*").alias("n_top"), r(F.max("score"), 9).alias("best"), r(F.min("score"), 9).alias("last"))
    return t.join(counts, "query").select("query", "n_top", "best", "last", "rescored", "lane", "fallback_reason")


@query(f"WITH {_BOUNDS} SELECT query, count(*) FILTER (exact < est - err OR exact > est + err) AS violations, count(*) FILTER (err > 0) AS n_bounded, count(*) FILTER (est + err > 0) AS n_maybe_positive FROM b GROUP BY query")
def interval_violations(spark, d):
    """Bounds that don't hold the exact score (none), and how many there are."""
    e = table(spark, d, "embeddings")
    s = topk.pair_scores(e, _asked(e), id_col="vec_id", vector="embedding")
    return s.groupBy("query").agg(F.count_if(~F.col("exact").between(F.col("lower"), F.col("upper"))).alias("violations"), F.count_if(F.col("upper") > F.col("lower")).alias("n_bounded"), F.count_if(F.col("upper") > 0).alias("n_maybe_positive"))


#: Every tenth vector twice, so that there are exact ties.
_TWICE = "SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, embedding FROM embeddings WHERE vec_id % 10 = 0"


def _twice(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e, e.unionByName(e.where("vec_id % 10 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))


@query(f"""WITH {_BOUNDS.replace("FROM embeddings e,", f"FROM ({_TWICE}) e,")}, t AS (SELECT *, count(*) OVER (PARTITION BY query, exact) > 1 AS tie,
    CASE WHEN exact > 0 THEN row_number() OVER (PARTITION BY query, exact > 0 ORDER BY exact DESC, id) END AS r1, CASE WHEN est > 0 THEN row_number() OVER (PARTITION BY query, est > 0 ORDER BY est DESC, id) END AS r2 FROM u),
  f AS (SELECT *, unsure AND NOT tie AS cert, exact < est - err OR exact > est + err AS broken, CASE WHEN r1 <= 10 THEN r1 END IS DISTINCT FROM CASE WHEN r2 <= 10 THEN r2 END AS differs FROM t)
  SELECT query, count(*) AS total, count(*) FILTER (tie) AS ties, count(*) FILTER (unsure) AS uncertain, count(*) FILTER (cert) AS certified, count(*) FILTER (cert AND differs) AS genuine,
    count(*) FILTER (cert AND NOT differs AND NOT broken) AS near, count(*) FILTER (broken AND NOT (cert AND differs)) AS other FROM f GROUP BY query""")
def certification_buckets(spark, d):
    e, twice = _twice(spark, d)
    # floats of equal vectors may differ by where they stand in a batch, so raw ranks do
    return topk.certification(topk.pair_scores(twice, _asked(e), id_col="vec_id", vector="embedding"), k=10).drop("raw_disagreement")


@query(f"WITH {_SCORES.replace('FROM embeddings e,', f'FROM ({_TWICE}) e,')} SELECT query, id FROM (SELECT *, count(*) OVER (PARTITION BY query, s) AS n FROM scores) WHERE n > 1")
def exact_ties(spark, d):
    """Rows whose exact score another row of the query has too."""
    e, twice = _twice(spark, d)
    s = materialise(topk.pair_scores(twice, _asked(e), id_col="vec_id", vector="embedding").select("query", "id", "exact"))
    return s.join(topk.tied(s), ["query", "exact"], "left_semi").select("query", "id")


@query(f"""WITH {_SCORES}, c AS (SELECT query, id, round(s, 2) AS score FROM scores) SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, -id) AS rank, id, score FROM c WHERE score > 0 QUALIFY rank <= 10""")
def insertion_order_topk(spark, d):
    """A control: coarse scores, ties in the order of arrival, here backwards."""
    e = table(spark, d, "embeddings")
    s = topk.pair_scores(e, _asked(e), id_col="vec_id", vector="embedding").select("query", "id", r("exact", 2).alias("score"), (-F.col("id")).alias("came"))
    return topk.insertion_order_top(s, by=["query"], score="score", order="came", k=10).select("query", "rank", "id", "score")


@query(f"""WITH {_SCORES}, a AS ({_TOP[_TOP.index("SELECT query, row"):]}),
  b AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(s, 2) DESC, id) AS rank, id FROM scores WHERE s > 0 QUALIFY rank <= 10)
  SELECT query, id, a.rank AS exact_rank, b.rank AS coarse_rank FROM a FULL JOIN b USING (query, id) WHERE a.rank IS DISTINCT FROM b.rank""")
def rank_disagreement(spark, d):
    """Rows that a coarser score ranks elsewhere among the first ten."""
    e = table(spark, d, "embeddings")
    s = topk.pair_scores(e, _asked(e), id_col="vec_id", vector="embedding").where("exact > 0")
    def top(score, name):
        return s.withColumn(name, F.row_number().over(Window.partitionBy("query").orderBy(score.desc(), "id"))).where(F.col(name) <= 10).select("query", "id", name)
    both = top(F.col("exact"), "exact_rank").join(top(r("exact", 2), "coarse_rank"), ["query", "id"], "full_outer")
    return both.where(~F.col("exact_rank").eqNullSafe(F.col("coarse_rank")))


_WORDS = ["snapshot", "cache", "lock"]


def _bm25_sql(source: str, words: list[str]) -> str:
    return f"""w AS (SELECT key, regexp_extract_all(lower(coalesce(txt, '')), '[a-z0-9]+') AS t FROM ({source})),
  s AS (SELECT count(*) AS n, avg(len(t)) AS l FROM w), q AS (SELECT unnest({words}) AS term),
  tf AS (SELECT key, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS f FROM w, q),
  df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
  bm AS (SELECT key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / l))) AS score FROM tf JOIN df USING (term), s WHERE f > 0 GROUP BY key)"""


@query(f"WITH {_bm25_sql('SELECT doc_id AS key, text AS txt FROM documents', _WORDS)} SELECT key AS doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 25")
def bm25_top(spark, d):
    """BM25 of three words over all documents; the best 25."""
    s = lexical.bm25(table(spark, d, "documents"), key="doc_id", text="text", words=_WORDS)
    return s.withColumn("score", r("score")).orderBy(F.col("score").desc(), "doc_id").limit(25)


#: Symbols with a usable vector.
_USABLE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"""WITH v AS (SELECT s.ord, s.name, s.name || ' ' || coalesce(s.summary, '') AS txt, e.embedding FROM symbols s JOIN (SELECT symbol_id, embedding FROM symbol_embeddings WHERE {_USABLE}) e ON e.symbol_id = s.id),
  {_bm25_sql("SELECT ord AS key, txt FROM v", _WORDS)},
  l AS (SELECT v.*, coalesce(bm.score, 0) AS lex, CASE WHEN lower(name) = 'snapshot' THEN 3 WHEN starts_with(lower(name), 'snapshot') THEN 2 WHEN contains(lower(name), 'snapshot') THEN 1 ELSE 0 END AS ident FROM v LEFT JOIN bm ON bm.key = v.ord),
  m AS (SELECT max(lex) AS a, max(ident) AS b FROM l), x AS (SELECT *, 0.5 * greatest(CASE WHEN a > 0 THEN lex / a ELSE 0 END, CASE WHEN b > 0 THEN ident / b ELSE 0 END) AS base FROM l, m),
  f AS (SELECT q.ord AS query, x.ord AS id, x.base + 0.5 * list_cosine_similarity(x.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM x, v q WHERE q.ord % 100 = 0)
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, id, round(score, 9) AS score FROM f WHERE score > 0 QUALIFY rank <= 25""")
def score_fusion(spark, d):
    """Half the greater of BM25 and identity, each over its maximum, half the
    cosine with a symbol's vector: certified top 25."""
    v = F.col("embedding")
    e = table(spark, d, "symbol_embeddings").where(v.isNotNull() & (F.size(v) == 96) & F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))).where(T.finite(v) & F.exists(v, lambda x: x != 0))
    s = table(spark, d, "symbols").select("ord", "id", "name", F.concat_ws(" ", "name", F.coalesce("summary", F.lit(""))).alias("txt")).join(e.withColumnRenamed("symbol_id", "id"), "id")
    words = lexical.bm25(s, key="ord", text="txt", words=_WORDS).withColumnRenamed("score", "lex")
    both = s.join(words, "ord", "left").withColumn("ident", lexical.identity(F.col("name"), "snapshot"))
    base = lexical.lexical_base(both, ["lex", "ident"], 0.5).select("ord", "embedding", "base")
    t, _ = topk.topk(base, base.where("ord % 100 = 0"), id_col="ord", vector="embedding", k=25, weight=0.5, lexical="base")
    return t.withColumn("score", r("score", 9))


# --- paired measurements ---------------------------------------------------

_T = f"t AS (SELECT DISTINCT measurement_id, repo_name, \"case\", tool, mode, repetition, wall_ms, response_bytes FROM {CALLS} WHERE wall_ms > 0 AND wall_ms <= 3600000)"
_P = f"""{_T}, p AS (SELECT repo_name, tool, "case", repetition, max(wall_ms) FILTER (mode = 'baseline_full') AS base, max(wall_ms) FILTER (mode = 'generation_safe_hybrid') AS cand
  FROM t WHERE mode IN ('baseline_full', 'generation_safe_hybrid') GROUP BY ALL
  HAVING count(*) FILTER (mode = 'baseline_full') = 1 AND count(*) FILTER (mode = 'generation_safe_hybrid') = 1)"""
_SUM = """count(*) AS n_pairs, round(sum(base), 4) AS base_total, round(sum(cand), 4) AS cand_total, round(sum(base) / sum(cand), 6) AS ratio_of_sums, round(median(base / cand), 6) AS median_ratio,
  round(exp(avg(ln(base / cand))), 6) AS geomean_ratio, round(quantile_cont(base / cand, 0.95), 6) AS p95_ratio,
  count(*) FILTER (base - cand >= 10 AND 100 * (base - cand) / base >= 10) AS meaningful_wins, count(*) FILTER (NOT (base - cand >= 10 AND 100 * (base - cand) / base >= 10)) AS negligible,
  count(*) FILTER (base < cand) AS slower"""


def _timings(spark, d):
    t = table(spark, d, CALLS).where("wall_ms > 0 AND wall_ms <= 3600000")
    # copies of a call are equal in all of these
    return t.select("measurement_id", "repo_name", "case", "tool", "mode", "repetition", "wall_ms").groupBy("measurement_id", "repo_name", "case", "tool", "mode", "repetition").agg(F.max("wall_ms").alias("wall_ms"))


def _pairs(spark, d):
    return paired.pairs(_timings(spark, d), keys=["repo_name", "tool", "case", "repetition"], mode="mode", value="wall_ms", baseline="baseline_full", candidate="generation_safe_hybrid")


def _rounded(df):
    return df.withColumns({c: r(c, 4 if c.endswith("total") else 6) for c in ("base_total", "cand_total", "ratio_of_sums", "median_ratio", "geomean_ratio", "p95_ratio")})


@query(f"WITH {_P} SELECT {_SUM} FROM p")
def pair_ratio_summary(spark, d):
    return _rounded(paired.summary(materialise(_pairs(spark, d)), []))


@query(f"WITH {_P} SELECT tool, {_SUM} FROM p GROUP BY tool")
def pair_summary_by_tool(spark, d):
    return _rounded(paired.summary(materialise(_pairs(spark, d)), ["tool"]))


@query(f"WITH {_P} SELECT repo_name, tool, {_SUM} FROM p GROUP BY GROUPING SETS ((), (repo_name), (tool))")
def multi_level_report(spark, d):
    return _rounded(paired.report(materialise(_pairs(spark, d)), [[], ["repo_name"], ["tool"]]))


@query(f"WITH {_P} SELECT repo_name, round(exp(avg(ln(base / cand))), 6) AS geomean_ratio FROM p GROUP BY repo_name")
def pair_geomean(spark, d):
    return _pairs(spark, d).groupBy("repo_name").agg(r(paired.geomean(paired.ratio())).alias("geomean_ratio"))


@query(f"""WITH {_T}, g AS (SELECT repo_name, "case", min(wall_ms) FILTER (mode = 'baseline_full') AS b_min, max(wall_ms) FILTER (mode = 'baseline_full') AS b_max,
  min(wall_ms) FILTER (mode = 'generation_safe_hybrid') AS c_min, max(wall_ms) FILTER (mode = 'generation_safe_hybrid') AS c_max FROM t GROUP BY ALL)
  SELECT repo_name, "case", b_min, b_max, c_min, c_max, (c_max < b_min OR b_max < c_min) AS separated, CASE WHEN c_max < b_min THEN 'gain' WHEN b_max < c_min THEN 'regression' ELSE 'none' END AS direction
  FROM g WHERE b_min IS NOT NULL AND c_min IS NOT NULL""")
def range_separated(spark, d):
    s = paired.separation(_timings(spark, d), keys=["repo_name", "case"], mode="mode", value="wall_ms", baseline="baseline_full", candidate="generation_safe_hybrid")
    return s.select("repo_name", "case", "b_min", "b_max", "c_min", "c_max", "separated", "direction")


@query(f"""WITH {_P}, s AS (SELECT tool, sum(base - cand) AS saved FROM p GROUP BY tool), k AS (SELECT *, row_number() OVER (ORDER BY saved DESC, tool) AS rank FROM s)
  SELECT tool, round(saved, 4) AS saved, rank, round(saved / sum(saved) OVER (), 6) AS share, round(sum(saved) FILTER (rank <= 3) OVER () / sum(saved) OVER (), 6) AS top_share FROM k""")
def savings_share(spark, d):
    return paired.savings_share(_pairs(spark, d), by="tool").withColumns({"saved": r("saved", 4), "share": r("share"), "top_share": r("top_share")})


@query(f"WITH {_P} SELECT *, round(base - cand, 6) AS saved FROM p ORDER BY base - cand, repo_name, tool, \"case\", repetition LIMIT 15")
def top_regressions(spark, d):
    p = _pairs(spark, d).withColumn("saved", r(F.col("base") - F.col("cand")))
    return p.orderBy(F.col("base") - F.col("cand"), "repo_name", "tool", "case", "repetition").limit(15)


@query(f"WITH {_P} SELECT *, round(base / cand, 6) AS speedup FROM p ORDER BY base / cand DESC, repo_name, tool, \"case\", repetition LIMIT 15")
def top_speedups(spark, d):
    p = _pairs(spark, d).withColumn("speedup", r(paired.ratio()))
    return p.orderBy(paired.ratio().desc(), "repo_name", "tool", "case", "repetition").limit(15)


@query(f"WITH {_P} SELECT tool, count(*) FILTER (base - cand >= 10 AND 100 * (base - cand) / base >= 10) AS wins, count(*) AS n FROM p GROUP BY tool")
def meaningful_wins(spark, d):
    win = (F.col("base") - F.col("cand") >= 10) & (100 * (F.col("base") - F.col("cand")) / F.col("base") >= 10)
    return _pairs(spark, d).groupBy("tool").agg(F.count_if(win).alias("wins"), F.count("*").alias("n"))


@query(f"""WITH {_T} SELECT mode, round(quantile_cont(wall_ms, 0.5), 6) AS p50, round(quantile_cont(wall_ms, 0.95), 6) AS p95, round(max(wall_ms), 6) AS top,
  count(*) FILTER (wall_ms > 50 AND wall_ms <= 200) AS in_band, count(*) FILTER (wall_ms BETWEEN 50 AND 200) AS in_closed FROM t GROUP BY mode""")
def percentile_bands(spark, d):
    w = F.col("wall_ms")
    t = materialise(_timings(spark, d))
    q = exact_quantiles(t, keys=["mode"], value="wall_ms", quantiles={"p50": 0.5, "p95": 0.95})
    g = t.groupBy("mode").agg(r(F.max(w)).alias("top"), F.count_if((w > 50) & (w <= 200)).alias("in_band"), F.count_if(w.between(50, 200)).alias("in_closed"))
    return g.join(q, "mode").withColumns({"p50": r("p50"), "p95": r("p95")})


_PARITY = f"""par AS (SELECT tool, count(*) FILTER (h > 1) / count(*) AS broken FROM (SELECT tool, repo_name, "case", count(DISTINCT canonical_response_hash) AS h FROM {CALLS}
  WHERE regexp_full_match(canonical_response_hash, '[0-9a-f]{{64}}') GROUP BY ALL) GROUP BY tool)"""


@query(f"""WITH {_P}, {_PARITY}, g AS (SELECT tool, median(base / cand) AS speedup, count(*) FILTER (cand > base) / count(*) AS breadth, count(*) FILTER (cand > base * 1.5 AND cand - base >= 10) / count(*) AS genuine FROM p GROUP BY tool)
  SELECT tool, CASE WHEN broken > 0.05 THEN 'fail' WHEN genuine > 0.005 THEN 'fail' WHEN breadth > 0.25 THEN 'fail' WHEN breadth > 0.10 THEN 'design_answer_required' WHEN speedup < 1.2 THEN 'design_answer_required' ELSE 'pass' END AS verdict,
    broken <= 0.05 AS parity_ok, round(genuine, 6) AS genuine, round(breadth, 6) AS breadth FROM g JOIN par USING (tool)""")
def gate_verdict(spark, d):
    """Parity: at most a twentieth of a tool's cases with more than one well
    formed hash. Genuine: slower by half and by ten milliseconds."""
    p = materialise(_pairs(spark, d))
    slow = (F.col("cand") > F.col("base") * 1.5) & (F.col("cand") - F.col("base") >= 10)
    g = paired.summary(p, ["tool"]).join(p.groupBy("tool").agg((F.count_if(slow) / F.count("*")).alias("genuine")), "tool")
    h = table(spark, d, CALLS).where(F.col("canonical_response_hash").rlike("^[0-9a-f]{64}$")).groupBy("tool", "repo_name", "case").agg(F.count_distinct("canonical_response_hash").alias("h"))
    par = h.groupBy("tool").agg((F.count_if(F.col("h") > 1) / F.count("*")).alias("broken"))
    breadth, ok = F.col("slower") / F.col("n_pairs"), F.col("broken") <= 0.05
    return g.join(par, "tool").select("tool", paired.verdict(ok, breadth, F.col("genuine"), F.col("median_ratio"), speed=1.2).alias("verdict"), ok.alias("parity_ok"), r("genuine").alias("genuine"), r(breadth).alias("breadth"))


@query(f"""SELECT repo_name, "case", repetition, count(*) AS n, count(DISTINCT canonical_response_hash) + max((canonical_response_hash IS NULL)::INT) AS n_hashes,
  count(DISTINCT canonical_response_hash) + max((canonical_response_hash IS NULL)::INT) = 1 AS parity FROM {CALLS} GROUP BY ALL""")
def parity_groups(spark, d):
    return paired.parity(table(spark, d, CALLS), keys=["repo_name", "case", "repetition"], hashed="canonical_response_hash")


@query(f"""WITH x AS (SELECT mode, order_position, count(*) AS n FROM {CALLS} GROUP BY ALL), k AS (SELECT count(DISTINCT order_position) AS k FROM {CALLS})
  SELECT mode, max(n) - CASE WHEN count(*) = max(k) THEN min(n) ELSE 0 END AS spread, max(n) - CASE WHEN count(*) = max(k) THEN min(n) ELSE 0 END <= 100 AS balanced FROM x, k GROUP BY mode""")
def order_balance(spark, d):
    return paired.order_balance(table(spark, d, CALLS), mode="mode", position="order_position", tolerance=100)


@query(f"""WITH {_T} SELECT tool, count(*) AS n, count(DISTINCT "case") AS n_cases, max_by(wall_ms, measurement_id) AS last_wall, min_by(wall_ms, measurement_id) AS first_wall FROM t GROUP BY tool""")
def last_wins(spark, d):
    return _timings(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("case").alias("n_cases"), F.max_by("wall_ms", "measurement_id").alias("last_wall"), F.min_by("wall_ms", "measurement_id").alias("first_wall"))


@query(f"""SELECT tool, string_agg(mode || '=' || n, ',' ORDER BY mode) AS counts FROM (SELECT tool, mode, count(*) AS n FROM {CALLS} GROUP BY ALL) GROUP BY tool""")
def counts_map(spark, d):
    c = table(spark, d, CALLS).groupBy("tool", "mode").agg(F.count("*").alias("n"))
    return c.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_list(F.concat("mode", F.lit("="), F.col("n").cast("string")))), ",").alias("counts"))


@query(f"""SELECT measurement_id, rss_after_bytes, max(rss_after_bytes) OVER (PARTITION BY repo_name, "case", mode ORDER BY repetition, measurement_id, load_id ROWS UNBOUNDED PRECEDING) AS peak FROM {CALLS}""")
def running_peak(spark, d):
    t = table(spark, d, CALLS).select("measurement_id", "rss_after_bytes", "repo_name", "case", "mode", "repetition", "load_id")
    r = ordered.running_max(t, keys=["repo_name", "case", "mode"], piece=F.floor(F.col("repetition") / 256), order=["repetition", "measurement_id", "load_id"], value=F.col("rss_after_bytes"), out="peak")
    return r.select("measurement_id", "rss_after_bytes", "peak")


# --- selective reads -------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7")


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 800)")
def in_list_lookup(spark, d):
    return reads.in_list(table(spark, d, "orders"), "o_orderkey", [1, 2, 3, 5, 800])


@query("SELECT * FROM orders WHERE false")
def empty_in_list(spark, d):
    return reads.in_list(table(spark, d, "orders"), "o_orderkey", [])


@query("SELECT id, name, file FROM symbols WHERE lower(name) LIKE 'snapshot.%' AND lower(file) = lower('SRC/tools/FETCH_10.py') OR lower(name) = 'session.rebuild_001'")
def casefold_lookup(spark, d):
    s = table(spark, d, "symbols").select("id", "name", "file")
    return s.where((F.lower("name").startswith("snapshot.") & reads.same_text("file", "SRC/tools/FETCH_10.py")) | reads.same_text("name", "Session.Rebuild_001"))


@query("SELECT id, name, file FROM symbols WHERE file ILIKE 'src/s%'")
def prefix_scan(spark, d):
    return reads.prefix_scan(table(spark, d, "symbols").select("id", "name", "file"), "file", "SRC/s")


@query("SELECT ord, id, name, file FROM symbols WHERE id <> '' AND name <> '' AND file <> '' ORDER BY ord")
def ordered_projection(spark, d):
    s = table(spark, d, "symbols")
    return s.where(reads.nonempty(F.col("id")) & reads.nonempty(F.col("name")) & reads.nonempty(F.col("file"))).select("ord", "id", "name", "file").orderBy("ord")


@query("SELECT id, file FROM symbols WHERE file IN (SELECT file FROM symbols WHERE summary LIKE '%snapshot%')")
def two_phase_semi(spark, d):
    s = table(spark, d, "symbols")
    return reads.two_phase(s.select("id", "file"), "file", s.where(F.contains("summary", F.lit("snapshot"))), "file")


@query("SELECT id, name FROM symbols WHERE id IN (SELECT symbol_id FROM symbol_embeddings WHERE embedding IS NOT NULL)")
def embedded_symbols(spark, d):
    e = table(spark, d, "symbol_embeddings").where("embedding IS NOT NULL").select(F.col("symbol_id").alias("id"))
    return table(spark, d, "symbols").select("id", "name").join(e, "id", "left_semi")


@query("SELECT s.id, len(e.embedding) AS dim, round(e.embedding[1]::DOUBLE, 6) AS first_value FROM symbols s JOIN symbol_embeddings e ON s.id = e.symbol_id WHERE e.embedding IS NOT NULL AND isfinite(e.embedding[1])")
def lookup_join(spark, d):
    e = table(spark, d, "symbol_embeddings").where(F.col("embedding").isNotNull())
    first = F.get("embedding", F.lit(0))
    j = table(spark, d, "symbols").join(e, F.col("id") == F.col("symbol_id")).where(first.isNotNull() & ~F.isnan(first) & (F.abs(first) != float("inf")))
    return j.select("id", F.size("embedding").alias("dim"), r(first.cast("double"), 6).alias("first_value"))


_DELTA = "delta AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority, CASE o_orderkey % 10 WHEN 1 THEN 'modify' WHEN 2 THEN 'delete' END AS action FROM orders WHERE o_orderkey % 10 IN (1, 2))"


def _delta(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 10 IN (1, 2)")
    return o.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "action": F.when(F.col("o_orderkey") % 10 == 1, "modify").otherwise("delete")})


@query(f"WITH {_DELTA} SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta) UNION ALL SELECT * EXCLUDE (action) FROM delta WHERE action = 'modify'")
def overlay_merge(spark, d):
    return reads.overlay(table(spark, d, "orders"), _delta(spark, d), key="o_orderkey", action="action")


@query(f"WITH {_DELTA} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta)")
def anti_overlay(spark, d):
    return table(spark, d, "orders").join(_delta(spark, d), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE o_totalprice END AS price FROM orders")
def upsert_union(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return reads.upsert(o, o.where("o_orderkey % 10 = 3").withColumn("price", F.lit(0.0)), "o_orderkey")


@query(f"""WITH {_DELTA}, new AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta) UNION ALL SELECT o_orderkey, o_totalprice FROM delta WHERE action = 'modify'),
  old AS (SELECT o_orderkey, o_totalprice FROM orders)
  SELECT *, 'left' AS side FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT *, 'right' FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)""")
def snapshot_diff(spark, d):
    cols = ["o_orderkey", "o_totalprice"]
    return reads.differences(table(spark, d, "orders").select(*cols), overlay_merge(spark, d).select(*cols))


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS n FROM customer)
  SELECT c_custkey, c_name, position FROM n WHERE position IN (SELECT round_even(i * (n - 1) / 4.0, 0)::BIGINT FROM range(5) t(i))""")
def stride_sample(spark, d):
    return reads.stride_sample(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 5)


@query("""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS n FROM customer),
  w AS (SELECT s AS start, j AS step FROM (SELECT unnest([0, 10, 149]) AS s), range(3) t(j))
  SELECT w.start::INT AS start, w.step::INT AS step, n.position, n.c_custkey FROM w JOIN n ON n.position = (w.start + w.step) % n.n""")
def wraparound_batch(spark, d):
    return reads.wraparound(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], [0, 10, 149]).select("start", "step", "position", "c_custkey")


@query("SELECT file, count(*) AS cnt FROM symbols GROUP BY file HAVING count(*) > 1 ORDER BY cnt DESC, file LIMIT 20")
def group_having_limit(spark, d):
    return table(spark, d, "symbols").groupBy("file").agg(F.count("*").alias("cnt")).where("cnt > 1").orderBy(F.col("cnt").desc(), "file").limit(20)


@query("SELECT string_agg(r_name || '=' || r_regionkey, ';' ORDER BY r_name) AS pairs FROM region")
def kv_map(spark, d):
    m = reads.key_values(table(spark, d, "region").withColumn("v", F.col("r_regionkey").cast("string")), "r_name", "v")
    return m.select(F.array_join(F.transform(F.map_entries("pairs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("pairs"))


# --- graph -----------------------------------------------------------------

def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), x AS (SELECT 's' || src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT 'p' || dst, 0, 1 FROM e)
  SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, round(sum(o) / (sum(o) + sum(i)), 6) AS instability FROM x GROUP BY node""")
def degree_metrics(spark, d):
    return graph.degrees(_edges(spark, d)).withColumn("instability", r("instability"))


_NATIONS = """g AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


def _nations(spark, d):
    """Which nation's customers bought from which nation's suppliers."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    o = l.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = o.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    return c.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("s_suppkey") == F.col("l_suppkey")).select("src", "dst").distinct()


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem), d1 AS (SELECT DISTINCT p AS node FROM e WHERE s = 's1'),
  d2 AS (SELECT DISTINCT s AS node FROM e WHERE p IN (SELECT node FROM d1) AND s <> 's1')
  SELECT 's1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def bfs_reach(spark, d):
    """Both ways along the edges of suppliers and parts, two steps from one."""
    e = _edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.reach(both, spark.createDataFrame([("s1",)], "node string"), 2)


@query(f"""WITH RECURSIVE {_NATIONS}, c AS (SELECT src, dst, 1 AS n FROM g UNION SELECT c.src, g.dst, n + 1 FROM c JOIN g ON c.dst = g.src WHERE n < 4)
  SELECT src AS node, min(n)::INT AS length FROM c WHERE src = dst GROUP BY src""")
def dependency_cycles(spark, d):
    return graph.cycles(_nations(spark, d), 4)


@query(f"""WITH RECURSIVE {_NATIONS}, c AS (SELECT src, dst, 1 AS n FROM g UNION SELECT c.src, g.dst, n + 1 FROM c JOIN g ON c.dst = g.src WHERE n < 3)
  SELECT src, dst, min(n)::INT AS depth FROM c GROUP BY ALL""")
def dependency_graph(spark, d):
    return graph.closure(_nations(spark, d), 3)


@query(f"""WITH {_NATIONS} SELECT src, dst, a.r_name AS src_layer, b.r_name AS dst_layer FROM g JOIN nation x ON x.n_nationkey = src JOIN region a ON a.r_regionkey = x.n_regionkey
  JOIN nation y ON y.n_nationkey = dst JOIN region b ON b.r_regionkey = y.n_regionkey WHERE a.r_regionkey > b.r_regionkey""")
def layer_violations(spark, d):
    layers = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("layer"))
    order = [x["r_name"] for x in table(spark, d, "region").orderBy("r_regionkey").collect()]
    return graph.violations(_nations(spark, d), layers, order).select("src", "dst", "src_layer", "dst_layer")


def _deliveries(spark, d):
    """From every part to the supplier that delivered it last, and from every
    supplier to the part it delivered last, over all lineitems."""
    l = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("at"))
    last = lambda a, b: l.groupBy(F.col(a).alias("src")).agg(F.max_by(b, "at").alias("dst"))
    return last("p", "s").unionByName(last("s", "p"))


_LAST = "ROW(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey)"
_DELIVERIES = f"e AS (SELECT 'p' || l_partkey AS src, 's' || arg_max(l_suppkey, {_LAST}) AS dst FROM lineitem GROUP BY l_partkey UNION ALL SELECT 's' || l_suppkey, 'p' || arg_max(l_partkey, {_LAST}) FROM lineitem GROUP BY l_suppkey)"


@query(f"""WITH RECURSIVE {_DELIVERIES}, c AS (SELECT src, dst, 1 AS n FROM e UNION SELECT c.src, e.dst, n + 1 FROM c JOIN e ON c.dst = e.src WHERE c.src <> c.dst AND n < 2 * (SELECT count(*) FROM supplier))
  SELECT src AS node, min(n)::INT AS length FROM c WHERE src = dst GROUP BY src""")
def supply_cycles(spark, d):
    """Cycles of any length among last deliveries."""
    return graph.all_cycles(_deliveries(spark, d))


@query()
def supply_components(spark, d):
    """Strongly connected components of all deliveries: from every supplier to
    every part it delivered, and back from a part to its last supplier."""
    last = _deliveries(spark, d).where(F.startswith("src", F.lit("p")))
    return graph.components(_edges(spark, d).unionByName(last))


@query(f"""WITH RECURSIVE {_DELIVERIES}, c AS (SELECT src, dst, 1 AS n FROM e UNION SELECT c.src, e.dst, n + 1 FROM c JOIN e ON c.dst = e.src WHERE n < 3) SELECT src, dst, min(n)::INT AS depth FROM c GROUP BY ALL""")
def supply_graph(spark, d):
    """What is reached in at most three steps along last deliveries, from every
    supplier and part."""
    return graph.closure(_deliveries(spark, d), 3)


@query("""WITH x AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)
  SELECT src, dst, ra.r_name AS src_layer, rb.r_name AS dst_layer FROM x JOIN nation na ON na.n_nationkey = a JOIN region ra ON ra.r_regionkey = na.n_regionkey JOIN nation nb ON nb.n_nationkey = b JOIN region rb ON rb.r_regionkey = nb.n_regionkey WHERE ra.r_regionkey > rb.r_regionkey""")
def supply_violations(spark, d):
    """Customers who bought, in any lineitem, from a supplier of a region above
    theirs."""
    o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("layer"))
    place = lambda t, k, n, c: table(spark, d, t).join(regions, F.col(n) == F.col("n_nationkey")).select(F.concat(F.lit(c), k).alias("node"), "layer")
    order = [x["r_name"] for x in table(spark, d, "region").orderBy("r_regionkey").collect()]
    layers = place("customer", "c_custkey", "c_nationkey", "c").unionByName(place("supplier", "s_suppkey", "s_nationkey", "s"))
    return graph.violations(edges, layers, order).select("src", "dst", "src_layer", "dst_layer")


_DELIVERED = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _pagerank_sql(edges: str, rounds: int) -> str:
    """PageRank in SQL, one step after the other."""
    steps = [f"e AS ({edges}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v), o AS (SELECT src AS node, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for i in range(rounds):
        steps.append(f"""g{i} AS (SELECT e.dst AS node, sum(r.rank / o.deg) AS got FROM e JOIN r{i} r ON r.node = e.src JOIN o ON o.node = e.src GROUP BY e.dst),
          l{i} AS (SELECT coalesce(sum(r.rank), 0) AS lost FROM r{i} r ANTI JOIN o USING (node)),
          r{i + 1} AS (SELECT v.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + lost / n) AS rank FROM v LEFT JOIN g{i} g USING (node), n, l{i})""")
    return ", ".join(steps)


@query(f"WITH {_pagerank_sql(_DELIVERED, 6)} SELECT node, round(rank, 12) AS rank FROM r6")
def symbol_importance(spark, d):
    """PageRank over suppliers and parts."""
    return graph.importance(_edges(spark, d), rounds=6).withColumn("rank", r("rank", 12))


@query("""SELECT DISTINCT file AS path FROM symbols WHERE list_has_any(list_transform([split_part(name, '.', 1)], lambda x: lower(x)), ['snapshot', 'walk_10']) OR
  lower(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '')) IN ('snapshot', 'walk_10') ORDER BY path LIMIT 50""")
def reference_files(spark, d):
    """Files whose imports, here the owners of their symbols, name a wanted one."""
    s = table(spark, d, "symbols").where("file IS NOT NULL")
    imports = F.to_json(F.array(F.struct(F.col("file").alias("specifier"), F.array(F.substring_index("name", ".", 1)).alias("names"))))
    f = s.select("file", imports.alias("imports")).distinct()
    return graph.reference_files(f, path="file", imports="imports", wanted=["Snapshot", "walk_10"], limit=None).distinct().orderBy("path").limit(50)


# --- JSON, identity, canonical forms ---------------------------------------


@query("SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def json_extract_group(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


def _decoded_sql(x: str, times: int = 3) -> str:
    """JSON in SQL, decoded while it is a string that holds JSON."""
    for _ in range(times):
        x = f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END ELSE {x} END)"
    return x


_TRACES = f"""raw AS (SELECT DISTINCT probe_id, repo_name, parity_debug_json::JSON AS r FROM {PROBES} WHERE json_valid(parity_debug_json)), r1 AS (SELECT probe_id, repo_name, {_decoded_sql("r")} AS r FROM raw),
  r2 AS (SELECT probe_id, repo_name, r -> 'hydration_trace' AS t FROM r1), r3 AS (SELECT probe_id, repo_name, {_decoded_sql("t", 2)} AS t FROM r2), r4 AS (SELECT *, t -> 'load_results' AS l FROM r3 WHERE json_type(t) = 'OBJECT'),
  r5 AS (SELECT * EXCLUDE (l), {_decoded_sql("l", 2)} AS l FROM r4), r6 AS (SELECT * EXCLUDE (l), CASE json_type(l) WHEN 'ARRAY' THEN l::JSON[] WHEN 'OBJECT' THEN [l] ELSE []::JSON[] END AS l FROM r5),
  r7 AS (SELECT * EXCLUDE (l), list_filter(list_transform(l, lambda x: {_decoded_sql("x", 1)}), lambda x: json_type(x) = 'OBJECT') AS l FROM r6),
  tr AS (SELECT probe_id, repo_name, list_contains(list_transform(l, lambda x: x ->> 'requested_hydration'), 'full') AS is_full, len(l) AS n_loads,
    {", ".join(f"coalesce(try_cast(t ->> '{c}' AS INT), 0) AS {c}" for c in canonical.TRACE_COUNTERS)} FROM r7)"""


@query(f"""WITH {_TRACES}, x AS (SELECT coalesce(is_full, false) AS f, lazy_full_materializations > 0 AS l, sparse_by_id_calls + sparse_by_file_calls + sparse_by_name_calls + sparse_by_files_calls > 0 AS s FROM tr)
  SELECT CASE WHEN f AND s THEN 'explicit_full_plus_sparse' WHEN f THEN 'explicit_full' WHEN l AND s THEN 'lazy_full_plus_sparse' WHEN l THEN 'lazy_full' WHEN s THEN 'sparse_only' ELSE 'metadata_or_file_state_only' END AS label, count(*) AS n FROM x GROUP BY label""")
def trace_classify(spark, d):
    """Label of each probe's hydration trace, and how often."""
    p = table(spark, d, PROBES).select("probe_id", "parity_debug_json").distinct()
    return p.select(canonical.traces("parity_debug_json").alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {_TRACES} SELECT repo_name, count(*) AS n_traces, sum(n_loads)::BIGINT AS n_loads, {', '.join(f'sum({c})::BIGINT AS {c}' for c in canonical.TRACE_COUNTERS)} FROM tr GROUP BY repo_name")
def trace_totals(spark, d):
    """Counters of the hydration traces, added up by repository."""
    p = table(spark, d, PROBES).select("probe_id", "repo_name", "parity_debug_json").distinct()
    return canonical.trace_counters(p, "parity_debug_json", ["repo_name"])


@query()
def canonical_hash(spark, d):
    """Hash of each probe's record without its volatile parts."""
    p = table(spark, d, PROBES).select("probe_id", "parity_debug_json").distinct()
    c = canonical.canonical_json(F.col("parity_debug_json"), drop=("process_cpu_ms", "peak_rss_bytes"), drop_prefix=("cost_avoided",))
    return p.select("probe_id", canonical.digest(c).alias("digest"))


@query(f"""WITH c AS (SELECT DISTINCT measurement_id, mode, repetition, target_value::JSON AS t FROM {CALLS}),
  x AS (SELECT measurement_id, '{{"a":' || to_json(mode)::VARCHAR || ',"b":[{{' || array_to_string(list_transform(list_sort(json_keys(t)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(t, '$."' || k || '"')::VARCHAR), ',') || '}},{{"n":' || repetition || '}}]}}' AS canonical FROM c)
  SELECT measurement_id, canonical, sha256(canonical) AS digest FROM x""")
def canonical_rows(spark, d):
    """Answers made up around each call's target, with volatile parts at two
    depths, in canonical form and hashed."""
    c = table(spark, d, CALLS).select("measurement_id", "mode", "repetition", "target_value").distinct()
    text = F.concat(F.lit('{"cost_avoided_x": 1, "b": [ '), "target_value", F.lit(', {"process_cpu_ms": 7, "n": '), F.col("repetition").cast("string"), F.lit(', "cost_avoided": {}}], "a": "'), "mode", F.lit('"}'))
    x = c.select("measurement_id", canonical.canonical_json(text, drop=("process_cpu_ms", "peak_rss_bytes"), drop_prefix=("cost_avoided",)).alias("canonical"))
    return x.withColumn("digest", canonical.digest(F.col("canonical")))


@query("SELECT event_id, left(sha256(user_id || chr(31) || event_type || chr(31) || event_id), 24) AS row_id FROM events")
def row_identity(spark, d):
    return table(spark, d, "events").select("event_id", T.row_identity(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("row_id"))


_SIZED = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


@query(f"""WITH h AS (SELECT row_number() OVER (ORDER BY c_custkey, c_name, c_nationkey, c_mktsegment) - 1 AS i, sha256({" || ".join(map(_SIZED, ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))}) AS h FROM customer),
  a AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM h GROUP BY 1)
  SELECT (SELECT count(*) FROM customer) AS n, CASE WHEN count(*) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS digest FROM a""")
def table_digest(spark, d):
    return canonical.table_digest(table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query(f"""WITH p AS (SELECT DISTINCT probe_id, symbol_count FROM {PROBES}) SELECT probe_id, probe_id % 3 = 0 AND symbol_count IS NOT NULL AS full_parity, probe_id % 3 < 2 AND symbol_count IS NOT NULL AS core_parity,
  CASE WHEN probe_id % 3 = 1 AND symbol_count IS NOT NULL THEN '_meta.verdict.channels.index' ELSE '' END AS difference FROM p""")
def core_parity(spark, d):
    """Answers of two modes that differ in nothing, in the index channel only, or
    in what they hold. The answers are made up from the probes' columns."""
    p = table(spark, d, PROBES).select("probe_id", "symbol_count").distinct()
    kind = F.pmod("probe_id", F.lit(3))
    answer = lambda channel, extra: F.concat(F.lit('{"rows": ['), F.col("symbol_count").cast("string"), extra, F.lit('], "_meta": {"verdict": {"channels": {"text": "ok", "index": "'), channel, F.lit('"}}}}'))
    a = p.select("probe_id", F.lit("baseline").alias("mode"), answer(F.lit("fresh"), F.lit("")).alias("detail"))
    b = p.select("probe_id", F.lit("candidate").alias("mode"), answer(F.when(kind == 0, "fresh").otherwise("rebuilding"), F.when(kind == 2, ", 1").otherwise("")).alias("detail"))
    return canonical.core_parity(a.unionByName(b), keys=["probe_id"], mode="mode", text="detail", baseline="baseline", candidate="candidate", path=("_meta", "verdict", "channels", "index"))


@query(f"""WITH s AS (SELECT repo_name, list_sort(list(DISTINCT left(jcodemunch_source_sha, 8)) FILTER (jcodemunch_source_sha <> '')) AS shas FROM {CALLS} GROUP BY repo_name), c AS (SELECT left(max(jcodemunch_source_sha), 8) AS now FROM {CALLS})
  SELECT repo_name, CASE WHEN coalesce(len(shas), 0) = 0 THEN 'empty' WHEN list_contains(shas, now) AND len(shas) = 1 THEN 'current_only' WHEN list_contains(shas, now) THEN 'mixed' ELSE 'older_only' END AS class, array_to_string(shas, ',') AS shas FROM s, c""")
def provenance_class(spark, d):
    t = table(spark, d, CALLS)
    now = t.agg(F.max("jcodemunch_source_sha")).first()[0] or ""
    return canonical.provenance(t, group=["repo_name"], sha="jcodemunch_source_sha", current=now)


@query(f"""SELECT probe_id, max(json_extract_string(parity_debug_json, '$.order_position')::INT) AS position, max(coalesce(json_extract_string(parity_debug_json, '$.snapshot_consistent'), '')) AS consistent
  FROM {PROBES} WHERE json_valid(parity_debug_json) AND json_type(parity_debug_json) = 'OBJECT' GROUP BY probe_id""")
def json_path_read(spark, d):
    p = table(spark, d, PROBES).select("probe_id", F.try_parse_json("parity_debug_json").alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    consistent = F.coalesce(F.try_variant_get("v", "$.snapshot_consistent", "string"), F.lit(""))
    return p.groupBy("probe_id").agg(F.max(F.try_variant_get("v", "$.order_position", "int")).alias("position"), F.max(consistent).alias("consistent"))


@query(f"""WITH p AS (SELECT DISTINCT probe_id, CASE WHEN json_valid(source_dirty_paths) AND json_type(source_dirty_paths::JSON) = 'ARRAY' THEN json_extract_string(source_dirty_paths, '$[*]') END AS ps FROM {PROBES}),
  k AS (SELECT DISTINCT split_part(x, '/', 1) AS head FROM (SELECT unnest(ps[2:]) AS x FROM p)), f AS (SELECT probe_id, split_part(ps[1], '/', 1) AS head FROM p)
  SELECT probe_id, coalesce(head NOT IN (SELECT head FROM k) AND head IN (SELECT substr(head, 2) FROM k WHERE length(head) > 1), false) AS clipped FROM f""")
def clipped_paths(spark, d):
    """Probes whose first dirty path begins with a folder that no later path has,
    but for the first letter."""
    p = table(spark, d, PROBES).select("probe_id", "source_dirty_paths").distinct()
    return integrity.clipped_first(p, "source_dirty_paths").select("probe_id", "clipped")


# --- scalar functions ------------------------------------------------------


@query("""SELECT id, regexp_extract(file, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '' END AS head,
  split_part(file, '-', 1) AS short, replace(id, '::', '@') AS replaced, instr(id, '#') AS mark, left(sha256(id), 8) AS short_hash, length(name) AS n_chars, strlen(name) AS n_bytes,
  (file <> '' AND NOT starts_with(file, '/') AND NOT list_contains(string_split(file, '/'), '..')) AS safe, regexp_replace(name, '([A-Za-z]+)_[0-9a-z]+', '\\1<x>', 'g') AS masked FROM symbols""")
def text_functions(spark, d):
    f = F.col("file")
    return table(spark, d, "symbols").select(
        "id", T.basename(f).alias("base"), T.stem(f).alias("stem"), T.head(f).alias("head"), T.short_name(f).alias("short"), F.replace("id", F.lit("::"), F.lit("@")).alias("replaced"),
        F.instr("id", "#").alias("mark"), F.substring(F.sha2("id", 256), 1, 8).alias("short_hash"), F.length("name").alias("n_chars"), F.octet_length("name").alias("n_bytes"), T.safe_path(f).alias("safe"), T.masked(F.col("name"), "([A-Za-z]+)_[0-9a-z]+").alias("masked"),
    )


@query("""SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 6) AS log, ceil(o_totalprice)::BIGINT AS up, floor(o_totalprice)::BIGINT AS down, round_even(o_totalprice / 10, 0)::BIGINT AS even,
  o_orderkey % 7 AS rest, o_orderkey // 7 AS whole, printf('%.2fx', o_totalprice / 777) AS shown, abs(o_totalprice - 1000) <= 0.01 * greatest(o_totalprice, 1000) AS near, greatest(o_totalprice, 1000) AS most FROM orders WHERE o_totalprice > 0""")
def number_functions(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, d, "orders").where("o_totalprice > 0").select(
        "o_orderkey", r(F.sqrt(p)).alias("root"), r(F.ln(p)).alias("log"), F.ceil(p).alias("up"), F.floor(p).alias("down"), F.bround(p / 10, 0).cast("long").alias("even"), F.pmod(k, F.lit(7)).alias("rest"), F.expr("o_orderkey div 7").alias("whole"),
        T.times(p / 777).alias("shown"), T.close(p, F.lit(1000.0)).alias("near"), F.greatest(p, F.lit(1000.0)).alias("most"),
    )


@query("""SELECT vec_id, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 6) AS top, list_position(embedding, list_max(embedding)) AS at, len(list_filter(embedding, lambda x: x > 0)) AS n_positive,
  len(list_filter(embedding, lambda x: x > 0)) > 0 AS some, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite FROM (SELECT symbol_id AS vec_id, embedding FROM symbol_embeddings WHERE len(embedding) > 0)""")
def array_functions(spark, d):
    e = F.col("embedding")
    return table(spark, d, "symbol_embeddings").where("size(embedding) > 0").select(
        F.col("symbol_id").alias("vec_id"), F.size(e).alias("n"), r(F.array_max(e).cast("double")).alias("top"), F.array_position(e, F.array_max(e)).alias("at"), F.size(F.filter(e, lambda x: x > 0)).alias("n_positive"), F.exists(e, lambda x: x > 0).alias("some"),
        r(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2"), T.finite(e).alias("finite"),
    )


# --- integrity -------------------------------------------------------------


@query("""WITH x AS (SELECT event_type, ts::DATE::VARCHAR AS day, hour(ts)::INT AS hour FROM events), g AS (SELECT * FROM (SELECT DISTINCT event_type FROM x), (SELECT DISTINCT day FROM x), (SELECT DISTINCT hour FROM x))
  SELECT event_type, day, hour FROM g ANTI JOIN (SELECT DISTINCT event_type, day, hour FROM x) USING (event_type, day, hour)""")
def matrix_completeness(spark, d):
    """Kinds of events that no event of an hour of a day has."""
    e = table(spark, d, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("hour"))
    return integrity.missing_cells(e, ["event_type", "day", "hour"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return integrity.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {_P}, s AS (SELECT tool, sum(base) / sum(cand) AS x, count(*) FILTER (cand < base) / count(*) AS f FROM p GROUP BY tool)
  SELECT tool, printf('%.2fx', x) AS speedup, printf('%.1f%%', 100 * f) AS faster FROM s""")
def claim_format(spark, d):
    s = _pairs(spark, d).groupBy("tool").agg((F.sum("base") / F.sum("cand")).alias("x"), (F.count_if(F.col("cand") < F.col("base")) / F.count("*")).alias("f"))
    return s.select("tool", T.times(F.col("x")).alias("speedup"), T.percent(F.col("f"), 1).alias("faster"))


@query("""SELECT c_mktsegment AS key, count(*)::VARCHAR AS computed, (count(*) + (c_mktsegment = 'BUILDING')::INT)::VARCHAR AS stated FROM customer GROUP BY c_mktsegment HAVING c_mktsegment = 'BUILDING'""")
def claim_reconcile(spark, d):
    """Claims in a document against what the data say; one was tampered with."""
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("n"))
    stated = F.concat(F.lit("<!-- claim:"), "key", F.lit("="), (F.col("n") + (F.col("key") == "BUILDING").cast("int")).cast("string"), F.lit(" -->"))
    return integrity.reconcile(c.select("key", F.col("n").cast("string").alias("value")), integrity.claims_in(c.select(stated.alias("t")), "t"))


_MARKERS = ["baseline", "lock file", "src/", "local/"]
_TEXTS = {"documents": ["text", "lang", "source", "repo_name"], "symbols": ["id", "name", "file", "summary"], "eval_items": ["suite", "passage", "answer"], "review_labels": ["rater", "category"], "mix_targets": ["source"], "customer": ["c_name", "c_mktsegment"]}


def _marker_sql(tables: dict, allow: str = "true") -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS \"column\", m AS marker, count(*) FILTER (contains({c}, m) AND {allow if (t, c) == ('documents', 'text') else 'true'}) AS hits FROM {t}, (SELECT unnest({_MARKERS}) AS m) GROUP BY m" for t, cs in tables.items() for c in cs]
    return " UNION ALL ".join(parts)


@query(f"SELECT \"column\", marker, hits FROM ({_marker_sql({'documents': _TEXTS['documents']})}) WHERE hits > 0")
def marker_scan(spark, d):
    return integrity.marker_scan(table(spark, d, "documents"), _MARKERS)


@query(f"SELECT * FROM ({_marker_sql(_TEXTS, 'coalesce(lang <> ' + chr(39) + 'en' + chr(39) + ', true)')}) WHERE hits > 0")
def marker_audit(spark, d):
    """Markers in all text columns of several tables; English texts may have
    them."""
    return integrity.marker_audit({t: table(spark, d, t) for t in _TEXTS}, _MARKERS, {"documents": {"text": "lang = 'en'"}})


_AUDITED = ["customer", "documents", "eval_items", "events", "lineitem", "mix_targets", "nation", "orders", "part", "region", "review_labels", "supplier", "symbols"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}')::INT AS n_columns, {n} AS n_null FROM {t}" for t, n in [
    (t, {"documents": "5 * count(*) - count(text) - count(lang) - count(source) - count(n_chars) - count(repo_name) + count(*) - count(collected_at)", "symbols": "2 * count(*) - count(summary) - count(byte_length)", "review_labels": "count(*) - count(category)"}.get(t, "0")) for t in _AUDITED]))
def table_audit(spark, d):
    """Rows, columns and NULL cells of all core tables."""
    return integrity.table_audit({t: table(spark, d, t) for t in _AUDITED})


@query("""SELECT 'text' AS column, count(*) FILTER (contains(text, 'src/')) AS n_changed FROM documents UNION ALL SELECT 'lang', count(*) FILTER (contains(lang, 'src/')) FROM documents
  UNION ALL SELECT 'source', count(*) FILTER (contains(source, 'src/')) FROM documents UNION ALL SELECT 'repo_name', count(repo_name) FROM documents""")
def redact_count(spark, d):
    return integrity.redact(table(spark, d, "documents"), {"src/": "<path>/"}, {"repo_name": "<repo>"})[1]


@query("SELECT doc_id, md5(replace(text, 'src/', '<path>/')) AS text, lang, source, n_chars, CASE WHEN repo_name IS NOT NULL THEN '<repo>' END AS repo_name FROM documents")
def redacted(spark, d):
    """The redacted table itself, its texts by their hash."""
    docs = integrity.redact(table(spark, d, "documents").drop("collected_at"), {"src/": "<path>/"}, {"repo_name": "<repo>"})[0]
    return docs.withColumn("text", F.md5("text"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'see /home/me/' WHEN 1 THEN 'C:\work\' WHEN 2 THEN 'https://x.org/home/' WHEN 3 THEN 'a/tmp/' ELSE '' END || coalesce(text, '') AS text FROM documents)
  SELECT doc_id FROM t WHERE regexp_matches(text, '(^|[^A-Za-z0-9:/.])(/(home|Users|root|tmp)/|[A-Za-z]:\\)')""")
def absolute_paths(spark, d):
    """Texts with absolute paths; some are put in front, with what only looks
    like one."""
    heads = F.array(*map(F.lit, ("see /home/me/", "C:\\work\\", "https://x.org/home/", "a/tmp/", "")))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.element_at(heads, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("text"))
    return integrity.absolute_paths(t, "text").select("doc_id")


@query("SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null, min(len(embedding))::INT AS min_length, max(len(embedding))::INT AS max_length, count(*) FILTER (len(embedding) <> 96) AS n_wrong FROM symbol_embeddings")
def vector_audit(spark, d):
    return integrity.audit_vectors(table(spark, d, "symbol_embeddings"), "embedding", 96)


#: The names of types on either side.
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP WITH TIME ZONE": "timestamp", "FLOAT[]": "array<float>"}


@query(f"SELECT table_name, column_name, CASE data_type {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in _TYPES.items())} ELSE data_type END AS data_type FROM information_schema.columns WHERE table_schema = 'main'")
def catalog_scan(spark, d):
    """All tables of the folder and their columns."""
    return files.catalog(spark, d)


@query(f"SELECT measurement_id, load_id, source_dirty_paths, parity_debug_json, wall_ms FROM {CALLS}")
def csv_roundtrip(spark, d):
    """Cells with line breaks, quotes, blanks and NULL numbers through CSV."""
    t = table(spark, d, CALLS).select("measurement_id", "load_id", "source_dirty_paths", "parity_debug_json", "wall_ms")
    path = scratch(spark)
    files.write_csv(t, path)
    return files.read_csv(spark, path, "measurement_id long, load_id int, source_dirty_paths string, parity_debug_json string, wall_ms double")


@query("SELECT region.r_regionkey AS key, r_name AS name, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def fragment_scan(spark, d):
    """One JSON document per region, written and read as fragments."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.count("*").alias("n_nations"))
    one = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).join(n, "key")
    path = scratch(spark)
    one.repartition(5, "key").write.json(path)
    return files.read_fragments(spark, path, "key", "key int, name string, n_nations bigint", multi_line=False)


@query("SELECT c_custkey, c_acctbal, 1 AS pinned, 2 AS newest FROM customer")
def pinned_version(spark, d):
    """A version read while the next one is written stays what it was."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    root = scratch(spark)
    first = files.publish(c, root)
    mine = files.pinned(spark, root, first)
    files.publish(c.withColumn("c_acctbal", F.lit(0.0)), root)
    return mine.select("c_custkey", "c_acctbal", F.lit(first).alias("pinned"), F.lit(files.latest(spark, root)).alias("newest"))


@query(f"SELECT * EXCLUDE (recorded_at, ingested_at), strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM (SELECT 'calls' AS family, * FROM {CALLS} UNION ALL BY NAME SELECT 'probes' AS family, * FROM {PROBES})")
def schema_union(spark, d):
    """Both measurement families with all columns of either."""
    a, b = (table(spark, d, t).withColumn("family", F.lit(n)) for t, n in ((CALLS, "calls"), (PROBES, "probes")))
    return a.unionByName(b, allowMissingColumns=True).withColumn("at", T.utc_stamp(F.date_trunc("second", "recorded_at"))).drop("recorded_at", "ingested_at")


@query("SELECT user_id, ts, event_id, event_type FROM events ORDER BY user_id, ts, event_id")
def multi_key_sort(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type").orderBy("user_id", "ts", F.col("event_id").cast("int"))


@query("SELECT event_id, event_type, ((event_id - 1) % 3 + 3) % 3 + 1 AS turn FROM events")
def rotation(spark, d):
    """Whose turn is first, rotated from row to row."""
    return table(spark, d, "events").select("event_id", "event_type", (F.pmod(F.col("event_id") - 1, F.lit(3)) + 1).alias("turn"))


# --- extensions beyond the reference ---------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events"), at="ts", by="event_type", value="value").withColumn("total", r("total", 3))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
  y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM y GROUP BY user_id, s""")
def ext_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), at="ts", by="user_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT c.event_id, c.ts, max_by(v.event_id, (v.ts, v.event_id)) AS last_view FROM events c LEFT JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view' AND v.ts <= c.ts WHERE c.event_type = 'click' GROUP BY ALL""")
def ext_asof(spark, d):
    """Each click with the last view of the same user up to then."""
    e = table(spark, d, "events")
    clicks, views = (e.where(F.col("event_type") == k).select("event_id", "ts", "user_id") for k in ("click", "view"))
    return ordered.as_of(clicks, views, key="user_id", at="ts", carry="event_id", out="last_view").drop("user_id")


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL")
def ext_distinct_by_day(spark, d):
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.count_distinct("l_orderkey").alias("n"))
