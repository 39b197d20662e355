import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import percentiles as pct

S = "g string, day int, v double, n long, idx int, sign int"
Q = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def frame(spark, rows):
    return spark.createDataFrame([(g, d, None if v is None else float(v), 1, 2, 3) for g, d, v in rows], S)


def values(df):
    return {(r["g"], r["q"]): r for r in df.collect()}


def skewed(n=4000, seed=0):
    g = np.random.default_rng(seed)
    x = np.where(g.random(n) < 0.3, 7.25, np.exp(g.normal(0, 4, n)) * np.where(g.random(n) < 0.3, -1, 1))
    x[g.random(n) < 0.05] = 0
    return [("hot" if g.random() < 0.8 else "cold", int(g.integers(0, 5)), v) for v in x]


def test_error_is_bounded_and_bounds_hold(spark):
    rows = skewed()
    df = frame(spark, rows).select("g", "day", "v")
    got = values(pct.percentiles(pct.sketch(df, groups=["g", "day"], metrics=["v"]), groups=["g"], quantiles=Q))
    for g in ("hot", "cold"):
        x = np.array([v for k, _, v in rows if k == g])
        for q in Q:
            r, s = got[g, q], np.sort(x)
            want = np.quantile(x, q)
            lo, hi = s[int(np.floor((len(s) - 1) * q))], s[int(np.ceil((len(s) - 1) * q))]
            assert abs(r["value"] - want) <= 0.005 * 1.001 * max(abs(lo), abs(hi)) + 1e-12
            assert r["low"] <= want <= r["high"] and r["n"] == len(x)


def test_parts_combine_in_any_order(spark):
    df = frame(spark, skewed(1000)).select("g", "day", "v")
    whole = pct.sketch(df, groups=["g"], metrics=["v"])
    a, b = (pct.sketch(df.where(c), groups=["g", "day"], metrics=["v"]) for c in ("day < 2", "day >= 2"))
    key = lambda d: sorted(map(tuple, d.select("g", "metric", "sign", "idx", "n").collect()))
    assert key(pct.merge(a.union(b), groups=["g"])) == key(pct.merge(b.union(a), groups=["g"])) == key(whole)


@pytest.mark.parametrize("error", [0.005, 0.3])
def test_exact(spark, error):
    rows = skewed(2000, seed=3)
    df = frame(spark, rows).select("g", "v")
    s = pct.sketch(df, groups=["g"], metrics=["v"], error=error)
    got = values(pct.exact(df, s, groups=["g"], metric="v", quantiles=Q, error=error))
    for g in ("hot", "cold"):
        for q in Q:
            assert got[g, q]["value"] == pytest.approx(np.quantile([v for k, _, v in rows if k == g], q), rel=1e-12, abs=1e-300)


def test_nulls_nan_infinity_and_empty(spark):
    inf = float("inf")
    df = frame(spark, [(None, 1, None), (None, 1, 5.0), ("x", 1, float("nan")), ("y", 1, inf), ("y", 1, -inf), ("y", 1, 1.0), ("z", 1, 0.0)]).select("g", "v")
    s = pct.sketch(df, groups=["g"], metrics=["v"])
    got = values(pct.percentiles(s, groups=["g"], quantiles=[0.0, 0.5, 1.0]))
    assert {g for g, _ in got} == {None, "y", "z"}
    assert got[None, 0.5]["value"] == pytest.approx(5, rel=0.005) and got["z", 0.5]["value"] == 0
    assert (got["y", 0.0]["value"], got["y", 1.0]["value"]) == (-inf, inf)
    assert pct.percentiles(pct.sketch(df.limit(0), groups=["g"], metrics=["v"]), groups=["g"], quantiles=[0.5]).count() == 0


def test_a_call_counts_once_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "t", 5.0, 9), (1, "t", 5.0, 8), (2, "t", None, 8), (3, None, 1.0, 8)], "id long, tool string, v double, metric int")
    assert {tuple(r) for r in pct.calls(df, key="id", keep=["tool"], metrics=["v"]).collect()} == {("t", 5.0), ("t", None), (None, 1.0)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=30))
def test_any_values(spark, xs):
    df = frame(spark, [("g", 0, x) for x in xs]).select("g", "v")
    r = values(pct.percentiles(pct.sketch(df, groups=["g"], metrics=["v"]), groups=["g"], quantiles=[0.5]))["g", 0.5]
    want = np.quantile(xs, 0.5)
    assert r["low"] - 1e-9 * abs(want) <= want <= r["high"] + 1e-9 * abs(want)
