"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import abuse
from tidemark.llm import percentiles as pct
from tidemark.llm.leakage import leaks
from tidemark.llm.mixing import mixture, source_name
from tidemark.llm.neighbours import search, similar_pairs
from tidemark.session import materialise, table

CALLS = "generation_safe_hybrid_concurrency_v1"
METRICS = ["wall_ms", "load_phase_ms"]
ERROR = 0.005


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return pct.calls(table(spark, d, CALLS), key="measurement_id", keep=["tool", "mode"], metrics=METRICS, day="recorded_at")


def p1_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The form that combines: bucket counts per tool, mode and day."""
    return pct.sketch(_calls(spark, d), groups=["tool", "mode", "day"], metrics=METRICS, error=ERROR).withColumn("day", F.col("day").cast("string"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    p = pct.percentiles(p1_sketch(spark, d), groups=["tool", "mode"], quantiles=q, error=ERROR)
    return p.withColumns({c: F.round(c, 6) for c in ("value", "low", "high")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose 90th percentile of wall_ms is at least four times their
    median. The sketch's bounds decide all groups but those near the limit,
    which are settled by exact percentiles."""
    sketches = materialise(p1_sketch(spark, d).where("metric = 'wall_ms'"))
    p = pct.percentiles(sketches, groups=["tool", "mode"], quantiles=[0.5, 0.9], error=ERROR)
    at = lambda q, c: F.max(F.when(F.col("q") == q, F.col(c)))
    b = p.groupBy("tool", "mode").agg(at(0.5, "low").alias("m_low"), at(0.5, "high").alias("m_high"), at(0.9, "low").alias("p_low"), at(0.9, "high").alias("p_high"))
    b = materialise(b)
    sure = b.where(F.col("p_low") >= 4 * F.col("m_high")).select("tool", "mode")
    open_groups = b.where((F.col("p_low") < 4 * F.col("m_high")) & (F.col("p_high") >= 4 * F.col("m_low"))).select("tool", "mode")
    same = lambda x: [F.col(f"x.{k}").eqNullSafe(F.col(f"o.{k}")) for k in ("tool", "mode")]
    if open_groups.isEmpty():
        return sure
    near = lambda df: df.alias("x").join(open_groups.alias("o"), same("x"), "left_semi")
    e = pct.exact(near(_calls(spark, d)), near(sketches), groups=["tool", "mode"], metric="wall_ms", quantiles=[0.5, 0.9], error=ERROR)
    e = e.groupBy("tool", "mode").agg(at(0.5, "value").alias("m"), at(0.9, "value").alias("p"))
    return sure.unionByName(e.where(F.col("p") >= 4 * F.col("m")).select("tool", "mode"))


DIM = 96


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs among each other's five most similar, with their cosine."""
    p = similar_pairs(table(spark, d, "symbol_embeddings"), id_col="symbol_id", vector="embedding", dim=DIM)
    return p.select(F.col("a").alias("symbol_id_a"), F.col("b").alias("symbol_id_b"), F.round("cosine", 6).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("symbol_id_a", "symbol_id_b")


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every symbol whose number is divisible by 100,
    exactly, against all vectors."""
    v = table(spark, d, "symbol_embeddings")
    asked = table(spark, d, "symbols").where("ord % 100 = 0").select(F.col("id").alias("symbol_id"))
    found = search(v.join(asked, "symbol_id", "left_semi"), v, id_col="symbol_id", vector="embedding", dim=DIM)
    return found.select(F.col("query").alias("symbol_id"), "rank", F.col("id").alias("neighbour_id"), F.round("cosine", 5).alias("cosine"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its alignment score and the share of the item's words."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", "covered", "size", F.round("share", 6).alias("share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Rate and copies of every document."""
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and share reached of every source."""
    return _mixture(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share."""
    return p8_shares(spark, d).where("NOT enough").select("source")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "review_labels")
    model = abuse.fit(*abuse.labelled(docs, labels))
    return abuse.score(docs.withColumn("source", source_name(F.col("source"))), model, carry=("source",))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document, with the sentence most to blame."""
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of every source, spellings joined."""
    return abuse.rates(_scored(spark, d), by="source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_sketch, p1_percentiles, p1_found, p5_pairs, p5_found, p5_search, p7_leaks, p7_found, p8_mixture, p8_shares, p8_found, p9_scores, p9_rates, p9_found)}

_G = (1 + ERROR) / (1 - ERROR)
_USABLE = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

#: All pairs, to compare the index with. Its design recall is 0.99 for each
#: pair at the limit; on the test table of scale 0.01 it misses none.
_PAIRS_SQL = f"""v AS (SELECT symbol_id, embedding::DOUBLE[] AS e FROM symbol_embeddings WHERE symbol_id IS NOT NULL AND {_USABLE}),
      p AS (SELECT a.symbol_id AS x, b.symbol_id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.symbol_id <> b.symbol_id),
      t AS (SELECT * FROM p WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(c, 12) DESC, y) <= 5)"""

SQL = {
    # the middles and ends of buckets stand in the order of the values, so their order statistics are those of the values
    "p1_percentiles": f"""WITH calls AS (SELECT DISTINCT measurement_id, tool, mode, wall_ms, load_phase_ms FROM {CALLS}),
      long AS (SELECT tool, mode, 'wall_ms' AS metric, wall_ms AS v FROM calls UNION ALL SELECT tool, mode, 'load_phase_ms', load_phase_ms FROM calls),
      b AS (SELECT tool, mode, metric, CASE WHEN v = 0 THEN 0 ELSE sign(v) * pow({_G!r}, ceil(ln(abs(v)) / ln({_G!r}))) * 2 / (1 + {_G!r}) END AS m FROM long WHERE v IS NOT NULL),
      a AS (SELECT tool, mode, metric, count(*) AS n, list(m ORDER BY m) AS ms FROM b GROUP BY ALL), q AS (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q),
      p AS (SELECT tool, mode, metric, q, n, (n - 1) * q - floor((n - 1) * q) AS share, ms[floor((n - 1) * q)::BIGINT + 1] AS x, ms[least(floor((n - 1) * q)::BIGINT + 2, n)] AS y FROM a, q),
      w AS (SELECT *, (1 + {_G!r}) / 2 / ({_G!r} * (1 + 1e-9)) AS inner_end, (1 + {_G!r}) / 2 / (1 - 1e-9) AS outer_end FROM p),
      e AS (SELECT *, CASE WHEN x > 0 THEN x * inner_end ELSE x * outer_end END AS xl, CASE WHEN x > 0 THEN x * outer_end ELSE x * inner_end END AS xh, CASE WHEN y > 0 THEN y * inner_end ELSE y * outer_end END AS yl, CASE WHEN y > 0 THEN y * outer_end ELSE y * inner_end END AS yh FROM w)
      SELECT tool, mode, metric, q, n, round(x + (y - x) * share, 6) AS value, round(xl + (yl - xl) * share, 6) AS low, round(xh + (yh - xh) * share, 6) AS high FROM e""",
    "p5_search": f"""WITH v AS (SELECT symbol_id, embedding::DOUBLE[] AS e FROM symbol_embeddings WHERE symbol_id IS NOT NULL AND {_USABLE}), q AS (SELECT v.* FROM v JOIN symbols s ON s.id = v.symbol_id WHERE s.ord % 100 = 0),
      x AS (SELECT q.symbol_id, v.symbol_id AS neighbour_id, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.symbol_id <> v.symbol_id)
      SELECT symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY round(c, 9) DESC, neighbour_id) AS rank, neighbour_id, round(c, 5) AS cosine FROM x QUALIFY rank <= 5""",
    "p5_pairs": f"""WITH {_PAIRS_SQL} SELECT least(x, y) AS symbol_id_a, greatest(x, y) AS symbol_id_b, round(max(c), 6) AS cosine FROM t GROUP BY ALL""",
    "p5_found": f"WITH {_PAIRS_SQL} SELECT DISTINCT least(x, y) AS symbol_id_a, greatest(x, y) AS symbol_id_b FROM t",
    "p1_sketch": f"""WITH calls AS (SELECT DISTINCT measurement_id, tool, mode, recorded_at::DATE::VARCHAR AS day, wall_ms, load_phase_ms FROM {CALLS}),
      long AS (SELECT tool, mode, day, 'wall_ms' AS metric, wall_ms AS v FROM calls UNION ALL SELECT tool, mode, day, 'load_phase_ms', load_phase_ms FROM calls)
      SELECT tool, mode, day, metric, sign(v)::INT AS sign, CASE WHEN v = 0 THEN 0 ELSE (sign(v) * ceil(ln(abs(v)) / ln(1.005 / 0.995)))::INT END AS idx, count(*) AS n
      FROM long WHERE v IS NOT NULL GROUP BY ALL""",
    "p1_found": f"""WITH calls AS (SELECT DISTINCT measurement_id, tool, mode, wall_ms FROM {CALLS})
      SELECT tool, mode FROM calls GROUP BY ALL HAVING quantile_cont(wall_ms, 0.9) >= 4 * quantile_cont(wall_ms, 0.5)""",
}
