import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.profile import Check, departures, profile

SCHEMA = "load int, a long, b double, c string, n long, i long, col int"


def make(spark, n=3000, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        load = int(g.integers(1, 5))
        a = None if g.random() < 0.1 else int(g.integers(-5, 6)) if g.random() < 0.4 else int(g.integers(-(10**12), 10**12))
        b = None if g.random() < 0.2 else float(g.normal(load))
        c = None if g.random() < 0.1 else "hot" if g.random() < 0.4 else f"w{g.integers(0, 300)}"
        rows.append((load, a, b, c, 1, 2, 3))
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=["load", "a", "b", "c", "n", "i", "col"])


def ks(x, y):
    x, y = np.sort(x), np.sort(y)
    z = np.unique(np.r_[x, y])
    return np.abs(np.searchsorted(x, z, "right") / len(x) - np.searchsorted(y, z, "right") / len(y)).max()


def test_against_brute_force(spark):
    df, d = make(spark)
    p = profile(df, load="load", columns=["a", "b", "c"], checks={"c": Check(pattern="w[0-9]+"), "a": Check(low=-10, high=10)})
    cols = {(r["load_id"], r["column_name"]): r for r in p.columns.collect()}
    qs = {(r["load_id"], r["column_name"], r["q"]): r["value"] for r in p.quantiles.collect()}
    ds = {(r["load_id"], r["column_name"]): r for r in p.distances.collect()}
    assert len(cols) == 12 and len(qs) == 24 and len(ds) == 8
    for load in range(1, 5):
        x = d[d.load == load]
        for c in "abc":
            v, r = x[c].dropna(), cols[str(load), c]
            assert (r["n_rows"], r["n_null"], r["n_distinct"]) == (len(x), x[c].isna().sum(), v.nunique())
            assert r["min_value"] == (str(int(v.min())) if c == "a" else str(v.min())) or c == "b"
        assert cols[str(load), "c"]["n_wrong"] == (x.c.dropna() == "hot").sum()
        assert cols[str(load), "a"]["n_wrong"] == (x.a.dropna().abs() > 10).sum()
        for c in "ab":
            for q in (0.25, 0.5, 0.75):
                assert qs[str(load), c, q] == pytest.approx(x[c].quantile(q), rel=1e-9)
            assert ds[str(load), c]["ks_rest"] == pytest.approx(ks(x[c].dropna(), d[d.load != load][c].dropna()), abs=1e-12)
            if load > 1:
                assert ds[str(load), c]["ks_before"] == pytest.approx(ks(x[c].dropna(), d[d.load == load - 1][c].dropna()), abs=1e-12)
            else:
                assert ds[str(load), c]["ks_before"] is None


def test_nulls_nan_and_a_null_load(spark):
    rows = [(None, None, float("nan"), None, 0, 0, 0), (None, None, 1.0, "", 0, 0, 0), (1, None, None, None, 0, 0, 0)]
    p = profile(spark.createDataFrame(rows, SCHEMA), load="load", columns=["a", "b", "c"])
    cols = {(r["load_id"], r["column_name"]): r for r in p.columns.collect()}
    assert cols[None, "b"]["n_distinct"] == 2 and math.isnan(float(cols[None, "b"]["max_value"]))
    assert cols[None, "c"]["n_null"] == 1 and cols[None, "c"]["n_distinct"] == 1
    assert cols["1", "a"]["n_distinct"] == 0 and cols["1", "a"]["min_value"] is None
    assert {r["load_id"] for r in p.distances.collect()} == {None}


def test_empty_table(spark):
    p = profile(spark.createDataFrame([], SCHEMA), load="load", columns=["a", "c"])
    assert p.columns.count() == p.quantiles.count() == p.distances.count() == 0
    assert departures(p).count() == 0


def test_departures(spark):
    rows = []
    for load in range(1, 10):
        for k in range(200):
            a = 100 + k
            if load == 3:
                a *= 20
            rows.append((load, None if load == 5 and k < 100 else a, float(k), "XX" if load == 7 and k < 50 else f"w{k % 3 if load == 8 else k}", 0, 0, 0))
    p = profile(spark.createDataFrame(rows, SCHEMA), load="load", columns=["a", "b", "c"], checks={"c": Check(pattern="w[0-9]+"), "b": Check(high=180.0)})
    got = {tuple(r) for r in departures(p, pattern_columns=("c",), range_columns=("b",), distinct_columns=("c",), median_columns=("a",)).collect()}
    wrong = {(str(x), "b", "range") for x in range(1, 10)}
    assert got == wrong | {("3", "a", "distribution"), ("5", "a", "null_rate"), ("7", "c", "pattern"), ("8", "c", "distinct")}


def distances_of(d, load, c, order):
    """ks_before and ks_rest by brute force; order without loads that have no
    value."""
    part = lambda x: d[d[load].isna() if x is None else d[load] == x][c].dropna()
    rank = {v: k for k, v in enumerate(sorted(set(d[c].dropna())))}
    own = {x: part(x).map(rank) for x in order}
    out, kept = {}, [x for x in order if len(own[x])]
    for k, x in enumerate(kept):
        rest = [own[y] for y in kept if y is not x]
        out[x] = (ks(own[x], own[kept[k - 1]]) if k else None, ks(own[x], pd.concat(rest)) if rest else None)
    return out


def check_distances(frame, want, c, name=lambda x: None if x is None else str(x)):
    got = {r["load_id"]: (r["ks_before"], r["ks_rest"]) for r in frame.where(f"column_name = '{c}'").collect()}
    assert set(got) == {name(x) for x in want}
    for x, pair in want.items():
        for a, b in zip(got[name(x)], pair):
            assert a is None and b is None or a == pytest.approx(b, abs=1e-12)


def test_text_columns_have_distances_and_quantiles(spark):
    df, d = make(spark)
    for parts in (1, 5):
        p = profile(df, load="load", columns=["a", "b", "c"], parts=parts)
        check_distances(p.text_distances, distances_of(d, "load", "c", [1, 2, 3, 4]), "c")
        q = {(r["load_id"], r["column_name"], r["q"]): r["value"] for r in p.text_quantiles.collect()}
        assert len(q) == 12
        for load in range(1, 5):
            x = sorted(d[d.load == load].c.dropna())
            for at in (0.25, 0.5, 0.75):
                assert q[str(load), "c", at] == x[math.ceil(len(x) * at) - 1]
        assert {r["column_name"] for r in p.distances.collect()} == {r["column_name"] for r in p.quantiles.collect()} == {"a", "b"}


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, "40")
    yield
    spark.conf.set(key, kept)


def test_a_null_load_counts_as_one_over_many_batches(spark, small_batches):
    df, d = make(spark, 1500)
    df = df.withColumn("load", F.when(F.col("load") != 2, F.col("load")))
    d = d.assign(load=d.load.where(d.load != 2))
    p = profile(df, load="load", columns=["a", "b", "c"], parts=2)
    for frame, c in ((p.distances, "a"), (p.distances, "b"), (p.text_distances, "c")):
        check_distances(frame, distances_of(d, "load", c, [None, 1, 3, 4]), c)
    p = profile(df, load="load", columns=["a"], parts=2, order=["4", None, "3", "1"])
    check_distances(p.distances, distances_of(d, "load", "a", [4, None, 3, 1]), "a")


def test_the_load_before_is_the_last_with_values(spark):
    df, d = make(spark, 1500)
    df = df.withColumn("a", F.when(~F.col("load").isin(1, 3), F.col("a")))
    d = d.assign(a=d.a.where(~d.load.isin([1, 3])))
    p = profile(df, load="load", columns=["a", "b"])
    want = distances_of(d, "load", "a", [1, 2, 3, 4])
    assert set(want) == {2, 4} and want[4][0] is not None
    check_distances(p.distances, want, "a")
    check_distances(p.distances, distances_of(d, "load", "b", [1, 2, 3, 4]), "b")


def test_loads_that_python_spells_otherwise(spark):
    df, d = make(spark, 500)
    df, d = df.withColumn("load", F.col("load") > 2), d.assign(load=d.load > 2)
    p = profile(df, load="load", columns=["b"])
    check_distances(p.distances, distances_of(d, "load", "b", [False, True]), "b", lambda x: str(x).lower())


def test_empty_table_has_no_text_figures(spark):
    p = profile(spark.createDataFrame([], SCHEMA), load="load", columns=["a", "c"])
    assert p.text_quantiles.count() == p.text_distances.count() == 0
