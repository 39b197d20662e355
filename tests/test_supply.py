"""The graph queries over all lineitems against brute force."""

import pandas as pd

from tidemark.operators import graph
from tidemark.plans import catalog


def read(sf, name):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def step(sf):
    l = read(sf, "lineitem").sort_values(["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    s, p = "s" + l.l_suppkey.astype(str), "p" + l.l_partkey.astype(str)
    return dict(zip(p, s)) | dict(zip(s, p))


def run(spark, sf, name):
    return {tuple(r) for r in catalog.queries()[name](spark, sf).collect()}


def test_cycles(spark, sf):
    to, want = step(sf), set()
    for node in to:
        at, n = to[node], 1
        while at != node and n <= len(to):
            at, n = to[at], n + 1
        if at == node:
            want.add((node, n))
    assert want and run(spark, sf, "supply_cycles") == want


def test_graph(spark, sf):
    to, want = step(sf), {}
    for node in to:
        at = node
        for n in range(1, 4):
            at = to[at]
            want.setdefault((node, at), n)
    assert run(spark, sf, "supply_graph") == {(*k, n) for k, n in want.items()}


def test_violations(spark, sf):
    x = read(sf, "lineitem").merge(read(sf, "orders"), left_on="l_orderkey", right_on="o_orderkey").merge(read(sf, "customer"), left_on="o_custkey", right_on="c_custkey").merge(read(sf, "supplier"), left_on="l_suppkey", right_on="s_suppkey")
    region = read(sf, "nation").set_index("n_nationkey").n_regionkey
    x = x[x.c_nationkey.map(region) > x.s_nationkey.map(region)]
    want = set(zip("c" + x.o_custkey.astype(str), "s" + x.l_suppkey.astype(str)))
    assert want and {r[:2] for r in run(spark, sf, "supply_violations")} == want


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 11) for i in range(11)] + [(20, 21), (21, 22), (22, 20), (3, 20), (30, 30), (40, 0), (22, 50)]
    got = {tuple(r) for r in graph.all_cycles(spark.createDataFrame([*ring, (None, 1)], "src int, dst int")).collect()}
    assert got == {(i, 11) for i in range(11)} | {(20, 3), (21, 3), (22, 3), (30, 1)}
    assert graph.all_cycles(spark.createDataFrame([], "src int, dst int")).count() == 0
