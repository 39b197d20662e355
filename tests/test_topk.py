import numpy as np
import pytest

from tidemark.operators import topk

S = "id long, v array<float>, lex double, score double, query long"


def frame(spark, vectors, ids=None, lex=None):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], (lex or {}).get(i, 0.0), 9.0, 7) for i, v in zip(ids or range(len(vectors)), vectors)], S)


def top(spark, vectors, query, k=2, ids=None, **o):
    df = frame(spark, vectors, ids, o.pop("lex", None))
    t, c = topk.topk(df, frame(spark, [query], [99]), id_col="id", vector="v", k=k, **o)
    return [(r["id"], r["score"]) for r in sorted(t.collect(), key=lambda r: r["rank"])], c.first()


@pytest.mark.parametrize("dim", [1, 17, 96, 700])
def test_bounds_hold_the_exact_score(dim):
    g = np.random.default_rng(dim)
    x = (g.standard_t(2, size=(200, dim)) * g.uniform(1e-3, 1e3, (200, 1))).astype(np.float32)
    q = np.concatenate([x[:3] * 2, g.uniform(-1, 1, (2, dim)).astype(np.float32)])
    _, low, up = topk.estimate(x, q)
    for c in range(len(q)):
        exact = topk.exact_rows(x, np.broadcast_to(q[c], x.shape))
        assert ((low[:, c] <= exact) & (exact <= up[:, c])).all()
    assert (up - low).max() < 0.02


def test_zero_vectors_and_wrong_input():
    e = topk.estimate(np.zeros((3, 4), np.float32), np.ones((1, 4), np.float32))
    assert all((x == 0).all() for x in e)
    with pytest.raises(ValueError):
        topk.estimate(np.ones((2, 3), np.float32), np.ones((1, 4), np.float32))
    with pytest.raises(ValueError):
        topk.estimate(np.full((1, 2), np.nan, np.float32), np.ones((1, 2), np.float32))


@pytest.mark.parametrize("mode", ["exact_tiebreak_baseline", "float32_certified_candidate", "bounded_exact_fallback"])
def test_lanes_agree(spark, mode):
    g = np.random.default_rng(8)
    x = g.normal(size=(300, 12)).astype(np.float32)
    x[40] = x[41] = x[42]
    got, c = top(spark, x, x[42], k=6, ids=list(range(300, 0, -1)), mode=mode)
    s = topk.exact_rows(x, np.broadcast_to(x[42], x.shape))
    assert [i for i, _ in got] == [300 - i for i in sorted(range(300), key=lambda i: (-s[i], 300 - i))[:6]]
    assert c["rescored"] == 300 if mode != "float32_certified_candidate" else c["rescored"] < 60


def test_ties_go_to_the_smaller_id_whatever_the_order(spark):
    v = [[1, 1], [1, 1], [1, 1], [1, 0]]
    for ids in ([9, 4, 6, 1], [4, 9, 1, 6]):
        equal = sorted(ids[:3])
        assert [i for i, _ in top(spark, v, [2, 2], ids=ids)[0]] == equal[:2]


def test_only_positive_scores_and_nulls_left_out(spark):
    assert [i for i, _ in top(spark, [[1, 0], [-1, 0], None, [0, 0], [0, 1]], [1, 0], k=5)[0]] == [0]
    assert top(spark, [], [1, 0])[0] == []


def test_fallback_reasons_and_the_work_they_take(spark, monkeypatch):
    g = np.random.default_rng(12)
    x = np.concatenate([np.tile([[3.0, 1.0, 2.0]], (60, 1)), g.normal(size=(140, 3))])
    want, _ = top(spark, x, [3, 1, 2], k=4, mode="exact_tiebreak_baseline")

    def seen(**o):
        got, c = top(spark, x, [3, 1, 2], k=4, **o)
        assert got == want
        return c["fallback_reason"], c["lane"], c["n"], c["rescored"]

    assert seen(max_fraction=0.1) == ("certification_fraction_limit", "exact", 200, 200)
    reason, lane, n, rescored = seen(max_fraction=0.5)
    assert (reason, lane, n) == ("", "certified", 200) and 60 <= rescored < 200
    assert seen(memory_cap=11) == ("memory_cap_refusal", "exact", 200, 200)
    assert seen(mode="bounded_exact_fallback") == ("forced_exact_fallback_mode", "exact", 200, 200)
    with monkeypatch.context() as m:
        m.setattr(topk, "np", None)
        assert seen() == ("numpy_unavailable", "exact", 200, 200)
    with pytest.raises(ValueError):
        top(spark, x, [3, 1, 2], weight=-1.0)
    with pytest.raises(ValueError):
        top(spark, x, [3, 1, 2], mode="other")


def test_a_failed_allocation_falls_back(monkeypatch):
    import pyarrow as pa

    def fail(*_):
        raise MemoryError

    monkeypatch.setattr(topk, "estimate", fail)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1.0, 0.0], [0.0, 1.0]], pa.list_(pa.float32())), pa.array([0.0, 0.0])], ["id", "v", "base"])
    (out,) = topk._certify(iter([batch]), [7], np.ones((1, 2), np.float32), 1, 1.0, 10**9)
    assert out.to_pylist() == [{"query": 7, "id": None, "low": None, "up": None, "score": None, "n": 2, "reason": "allocation_failure"}]


def test_against_brute_force_with_fusion(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 16)).astype(np.float32)
    lex = {i: float(i % 5) / 10 for i in range(400)}
    got, c = top(spark, x, x[7], k=10, weight=0.5, lexical="lex", lex=lex)
    s = np.array([lex[i] for i in range(400)]) + 0.5 * topk.exact_rows(x, np.repeat(x[7:8], 400, axis=0))
    want = sorted(range(400), key=lambda i: (-s[i], i))[:10]
    assert [i for i, _ in got] == want
    # each of four tasks scores what may be among its own ten
    assert c["lane"] == "certified" and c["uncertain"] < 40 and c["uncertain"] <= c["rescored"] < 80


def test_buckets_add_up(spark):
    g = np.random.default_rng(4)
    x = np.repeat(g.normal(size=(30, 8)), 2, axis=0)
    df = frame(spark, x)
    r = topk.certification(topk.pair_scores(df, df.where("id < 3"), id_col="id", vector="v"), k=5).collect()
    assert len(r) == 3
    for b in r:
        assert b["total"] == 60 and b["ties"] == 60 and b["certified"] == b["near"] + b["genuine"] and b["other"] == 0


def test_cosine_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(topk.exact_cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    g = np.random.default_rng(6)
    x = g.normal(size=(80, 5)).astype(np.float32)
    df = frame(spark, x)
    t, c = topk.topk(df, df.where("id < 7"), id_col="id", vector="v", k=3)
    assert c.count() == 7 and t.count() == 21 and {r["id"] for r in t.where("rank = 1").collect()} == set(range(7))


def test_lexical_scores(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import lexical

    df = spark.createDataFrame([(1, "Cache the lock, cache"), (2, "lock"), (3, None), (4, "")], "id long, t string").withColumn("tm_n", F.lit(1))
    got = {r["id"]: r["score"] for r in lexical.bm25(df, key="id", text="t", words=["cache", "LOCK", "lock"]).collect()}
    part = lambda d, f, n: np.log(1 + (4 - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / 1.25))
    assert got == pytest.approx({1: part(1, 2, 4) + part(2, 1, 4), 2: part(2, 1, 1)})
    assert lexical.bm25(df, key="id", text="t", words=[]).count() == 0
    names = spark.createDataFrame([("Lock",), ("lock_b",), ("a.lock",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(lexical.identity(F.col("n"), "LOCK")).collect()] == [3.0, 2.0, 1.0, 0.0, 0.0]
    s = spark.createDataFrame([(2.0, 0.0), (1.0, 0.0), (None, 0.0)], "a double, b double")
    assert [r["base"] for r in lexical.lexical_base(s, ["a", "b"], 0.25).collect()] == [0.75, 0.375, 0.0]
