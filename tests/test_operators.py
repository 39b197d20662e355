import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import canonical, graph, integrity, paired, reads


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# reads


def test_lists_prefixes_and_maps(spark):
    df = spark.createDataFrame([("A_b/x", 1), ("a_B/y", 2), ("aXb", 3), (None, 4), ("", 5)], "p string, n int")
    assert reads.in_list(df, "n", []).count() == 0
    assert rows(reads.in_list(df, "n", [1, 3]), "n") == rows(reads.in_list(df, "n", [1, 3, *range(100, 1200)]), "n") == [(1,), (3,)]
    assert rows(reads.prefix_scan(df, "p", "a_b"), "n") == [(1,), (2,)]
    assert rows(reads.prefix_scan(df, "p", "a_B", ignore_case=False), "n") == [(2,)]
    assert rows(df.where(reads.nonempty(F.col("p"))), "n") == [(1,), (2,), (3,)]
    m = reads.key_values(spark.createDataFrame([("embed_a", "1"), ("b", "2"), (None, "3")], "k string, v string"), "k", "v", like="embed_%")
    assert m.first()["pairs"] == {"embed_a": "1"}


def test_stride_and_wraparound(spark):
    assert reads.stride_positions(6, 3) == [0, 2, 5] and reads.stride_positions(9, 1) == [4]
    with pytest.raises(ValueError):
        reads.stride_positions(2, 3)
    df = spark.range(1000).repartition(7).withColumn("position_", F.lit(1))
    assert [r[0] for r in rows(reads.stride_sample(df, ["id"], 5), "id")] == [0, 250, 500, 749, 999]
    assert rows(reads.wraparound(df, ["id"], [998]), "step", "id") == [(0, 998), (1, 999), (2, 0)]
    assert reads.wraparound(spark.range(0), ["id"], [0]).count() == 0


def test_overlay_has_the_seven_equalities(spark):
    base = spark.createDataFrame([("m.py", "old"), ("d.py", "gone"), ("k.py", "kept")], "file string, body string")
    delta = spark.createDataFrame([("m.py", "new", "modify"), ("d.py", None, "delete"), ("a.py", "added", "add"), (None, "lost", "delete")], "file string, body string, action string")
    out = dict(rows(reads.overlay(base, delta, key="file", action="action")))
    assert out == {"m.py": "new", "k.py": "kept", "a.py": "added"}
    assert reads.overlay(base, delta.limit(0), key="file", action="action").count() == 3
    assert dict(rows(reads.upsert(base, spark.createDataFrame([("m.py", "2"), ("z", "3")], "file string, body string"), "file"))) == {"m.py": "2", "d.py": "gone", "k.py": "kept", "z": "3"}
    assert rows(reads.differences(base, base.union(base.limit(1))), "side") == [("right",)]


def test_profiles(spark):
    imports = json.dumps([{"specifier": "a.py", "names": ["F"]}])
    files = spark.createDataFrame([("a.py", None), ("b.py", imports), ("c_d.py", "[]"), (None, imports)], "path string, imports string")
    symbols = spark.createDataFrame([("1", "F", "a.py"), ("2", "g", "b.py"), ("3", "h", None), ("4", "f", "c_d.py")], "id string, name string, file string")

    def got(p, **k):
        f, s = reads.load_profile(files, symbols, p, **k)
        return sorted(r["path"] for r in f.where("path IS NOT NULL").collect()), sorted(r["id"] for r in s.collect())

    every = ["a.py", "b.py", "c_d.py"]
    assert got("metadata") == ([], []) and got("all_files") == (every, []) and reads.load_profile(files, symbols, "all_files")[0].count() == 4
    # the files of the symbols come with them, and those asked for beside
    assert got("target_symbols", ids=["1", "3", "none"]) == (["a.py"], ["1", "3"])
    assert got("target_symbols", ids=["1"], paths=["b.py", "a.py"]) == (["a.py", "b.py"], ["1"])
    assert got("target_symbols") == ([], []) and got("target_files", paths=["a.py"]) == (["a.py"], [])
    assert got("target_file_symbols", paths=["a.py", "zz"]) == (["a.py"], ["1"])
    assert got("all_files_target_symbols", ids=["2"]) == (every, ["2"]) and got("all_files_target_file_symbols", paths=["b.py"]) == (every, ["2"])
    assert got("all_files_definitions", identifiers=["f"]) == (every, ["1", "4"]) and got("all_files_definitions") == (every, [])
    assert got("prefix_files", prefix="C_") == (["c_d.py"], ["4"]) and got("prefix_files", prefix="%") == ([], [])
    assert got("reference_call_chain", identifiers=["f"]) == (every, ["2"]) and got("reference_call_chain", identifiers=["f"], limit=0)[1] == []
    assert got("blast_enrichment", ids=["1"]) == (every, ["1", "2"]) and got("blast_enrichment", ids=["4"]) == (every, ["4"])
    assert got("blast_enrichment", ids=["1", "2"]) == (every, ["1", "2"]) and got("blast_enrichment") == (every, [])
    with pytest.raises(KeyError):
        reads.load_profile(files, symbols, "other")


def test_overlay_and_upsert_keep_their_order(spark):
    base = spark.createDataFrame([("m", "old"), ("k", "kept")], "file string, body string")
    delta = spark.createDataFrame([("z", "1", "add", 2), ("m", "2", "modify", 1), (None, "3", "add", 0)], "file string, body string, action string, at int")
    out = reads.overlay(base, delta, key="file", action="action", order="at").orderBy(F.col("tm_at").asc_nulls_first())
    assert [r["file"] for r in out.collect()] == ["k", None, "m", "z"]
    a = spark.createDataFrame([("x", 1, "a"), (None, 2, "b"), ("y", 3, "c")], "k string, at int, v string")
    b = spark.createDataFrame([("w", 0, "d"), ("y", 9, None), (None, 8, "e")], "k string, at int, v string")
    got = reads.upsert(a, b, "k", position="at").orderBy("tm_late", "at").collect()
    assert [(r["k"], r["v"]) for r in got] == [("x", "a"), (None, "e"), ("y", None), ("w", "d")]
    assert sorted(map(str, map(tuple, reads.upsert(a, b, "k").collect()))) == sorted(map(str, [("x", 1, "a"), ("w", 0, "d"), ("y", 9, None), (None, 8, "e")]))


# graphs


def test_graphs_with_cycles_nulls_and_repeats(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), (None, "a"), ("d", None)], "src string, dst string")
    start = spark.createDataFrame([("a",), (None,)], "node string")
    assert rows(graph.reach(e, start, 9), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reach(e, start, 1, reverse=True), "node") == [("a",), ("c",)]
    assert rows(graph.cycles(e, 5)) == [("a", 3), ("b", 3), ("c", 3)]
    assert {r["node"]: (r["n_out"], r["n_in"]) for r in graph.degrees(e).collect()} == {"a": (1, 1), "b": (1, 1), "c": (2, 1), "d": (0, 1)}
    assert graph.reach(e.limit(0), start, 3).count() == 1 and graph.cycles(e.limit(0), 3).count() == 0


def tarjan(edges):
    """Components by a plain depth-first search, named by their greatest node."""
    out, index, low, stack, on = {}, {}, {}, [], set()
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b), after.setdefault(b, [])

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v), on.add(v)
        for w in after[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while not part or part[-1] != v:
                part.append(stack.pop())
                on.discard(part[-1])
            out.update({w: max(part) for w in part})

    for v in after:
        if v not in index:
            visit(v)
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 30, 40), (2, 60, 70), (3, 12, 60)])
def test_components_against_a_depth_first_search(spark, seed, n, m):
    import random

    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame(edges + [(None, 1), edges[0]], "src int, dst int")
    want = tarjan(edges)
    assert {x["node"]: x["component"] for x in graph.components(df).collect()} == want
    on_cycle = {v for v in want if sum(want[w] == want[v] for w in want) > 1 or (v, v) in edges}
    got = {x["node"]: x["length"] for x in graph.all_cycles(df).collect()}
    assert set(got) == on_cycle and all(got[v] == 9 for v in range(100, 109))
    assert graph.components(df.limit(0)).count() == 0 and graph.all_cycles(df.limit(0)).count() == 0


def test_importance_against_plain_iteration(spark):
    pairs = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3)]
    got = {r["node"]: r["rank"] for r in graph.importance(spark.createDataFrame(pairs, "src int, dst int"), rounds=20).collect()}
    rank = {n: 0.25 for n in range(1, 5)}
    for _ in range(20):
        new = {n: 0.15 / 4 for n in rank}
        for s, t in pairs:
            new[t] += 0.85 * rank[s] / sum(x == s for x, _ in pairs)
        rank = new
    assert got == pytest.approx(rank)


def test_imports(spark):
    js = json.dumps([{"specifier": "pkg/Alpha.py", "names": ["Foo"]}, {"specifier": ".hidden", "names": []}])
    f = spark.createDataFrame([("z.py", js), ("y.py", "[]"), ("x.py", "broken"), (None, None)], "path string, imports string")
    assert rows(graph.import_edges(f, path="path", imports="imports")) == [("z.py", ".hidden"), ("z.py", "pkg/Alpha.py")]
    for wanted, n in ((["foo"], 1), (["ALPHA"], 1), ([".hidden"], 1), (["beta"], 0), ([], 0)):
        assert graph.reference_files(f, path="path", imports="imports", wanted=wanted).count() == n


# pairs


def test_pairs_strict_and_lenient(spark):
    t = spark.createDataFrame([("k", "b", 30.0), ("k", "c", 10.0), ("l", "b", 5.0), (None, "b", 8.0), (None, "c", 4.0), ("m", "b", None), ("m", "c", 1.0), ("k", "other", 1.0)], "key string, mode string, v double")
    p = dict(keys=["key"], mode="mode", value="v", baseline="b", candidate="c")
    assert {tuple(r) for r in paired.pairs(t, **p).collect()} == {(None, 8.0, 4.0), ("k", 30.0, 10.0)}
    with pytest.raises(Exception, match="not exactly one pair"):
        paired.pairs(t, **p, strict=True).collect()
    s = paired.summary(paired.pairs(t, **p), []).first()
    assert (s["n_pairs"], s["ratio_of_sums"], s["median_ratio"], s["meaningful_wins"]) == (2, 38 / 14, 2.5, 1)
    assert s["geomean_ratio"] == pytest.approx(6**0.5)
    empty = paired.summary(paired.pairs(t.limit(0), **p), []).first()
    assert (empty["n_pairs"], empty["median_ratio"], empty["base_total"]) == (0, 0.0, None)
    every = paired.pairs(t, **p)
    levels = {(r["key"], r["n_pairs"], r["median_ratio"]) for r in paired.report(every, [[], ["key"]]).collect()}
    assert levels == {(None, 2, 2.5), (None, 1, 2.0), ("k", 1, 3.0)}
    none = paired.report(every.limit(0), [[], ["key"]]).collect()
    assert [(r["key"], r["n_pairs"], r["median_ratio"], r["base_total"]) for r in none] == [(None, 0, 0.0, None)]


def test_exact_quantiles_of_hot_groups_and_ties(spark):
    import numpy as np

    from tidemark.operators.quantiles import exact_quantiles

    g = np.random.default_rng(0)
    data = [(None if g.random() < 0.7 else "k", int(g.integers(0, 2)), None if g.random() < 0.1 else 5.0 if g.random() < 0.4 else float(g.normal())) for _ in range(4000)]
    df = spark.createDataFrame(data, "a string, b int, v double").withColumns({"g": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    qs = {"lo": 0.0, "q1": 0.137, "mid": 0.5, "hi": 1.0}
    got = {(r["a"], r["b"]): r for r in exact_quantiles(df, keys=["a", "b"], value="v", quantiles=qs).collect()}
    assert len(got) == 4
    for (a, b), r in got.items():
        x = [v for k, m, v in data if (k, m) == (a, b) and v is not None]
        assert [r[n] for n in qs] == pytest.approx([np.quantile(x, q) for q in qs.values()])
    assert exact_quantiles(df, keys=[], value="v", quantiles=qs).count() == 1
    assert exact_quantiles(df.limit(0), keys=["a"], value="v", quantiles=qs).count() == 0


def test_touching_ranges_are_not_separated(spark):
    t = spark.createDataFrame([("a", "b", 3.0), ("a", "b", 5.0), ("a", "c", 3.0), ("z", "b", 3.0), ("z", "c", 2.9), ("y", "b", 1.0)], "key string, mode string, v double")
    got = paired.separation(t, keys=["key"], mode="mode", value="v", baseline="b", candidate="c")
    assert rows(got, "key", "separated", "direction") == [("a", False, "none"), ("z", True, "gain")]


def test_verdicts_in_order(spark):
    v = lambda *a: paired.verdict(*[F.lit(x) for x in a])
    r = spark.range(1).select(v(False, 0.0, 0.0, 9.0).alias("a"), v(True, 0.1, 0.0, 9.0).alias("b"), v(True, 0.11, 0.0, 9.0).alias("c"), v(True, 0.26, 0.0, 9.0).alias("d"), v(True, 0.0, 0.01, 9.0).alias("e")).first()
    assert tuple(r) == ("fail", "pass", "design_answer_required", "fail", "fail")


def test_parity_and_balance(spark):
    t = spark.createDataFrame([("a", "h"), ("a", "h"), ("b", "h"), ("b", None)], "k string, h string")
    assert rows(paired.parity(t, keys=["k"], hashed="h"), "k", "parity") == [("a", True), ("b", False)]
    o = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 1), ("y", 1)], "mode string, at int")
    assert rows(paired.order_balance(o, mode="mode", position="at")) == [("x", 0, True), ("y", 3, False)]


# canonical forms, integrity


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"x":[{"t":1,"é":2}]},"cost_avoided_y":1}',), ("bad",), (None,)], "t string")
    c = canonical.canonical_json(F.col("t"), drop=("t",), drop_prefix=("cost_avoided",))
    assert [r[0] for r in df.select(c).collect()] == ['{"a":{"x":[{"é":2}]},"b":1}', None, None]


def test_core_parity_leaves_out_one_path(spark):
    def answer(index, rows=1, deep=False):
        x = {"_meta": {"verdict": {"channels": {"index": index, "text": "t"}}}, "rows": rows}
        return json.dumps([x] if deep else x)

    rows_ = [("same", "b", answer("f")), ("same", "c", answer("f")), ("flag", "b", answer("f")), ("flag", "c", answer("r")), ("deep", "b", answer("f", deep=True)), ("deep", "c", answer("r", deep=True)), ("other", "b", answer("f")), ("other", "c", answer("f", 2)), ("broken", "b", "{"), ("broken", "c", "{"), ("null", "b", None), ("null", "c", None), ("alone", "b", answer("f"))]
    df = spark.createDataFrame(rows_, "k string, mode string, t string")
    got = {r["k"]: (r["full_parity"], r["core_parity"], r["difference"]) for r in canonical.core_parity(df, keys=["k"], mode="mode", text="t", baseline="b", candidate="c", path=("_meta", "verdict", "channels", "index")).collect()}
    flag = (False, True, "_meta.verdict.channels.index")
    assert got == {"same": (True, True, ""), "flag": flag, "deep": flag, "other": (False, False, ""), "broken": (False, False, ""), "null": (False, False, "")}


def test_table_digest_is_in_order_of_the_key_and_sees_changes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, v string")
    d = lambda x: canonical.table_digest(x, "k", ["v"]).first()["digest"]
    assert d(df) == d(df.orderBy(F.col("k").desc()).repartition(3))
    swapped = spark.createDataFrame([(1, None), (2, "a"), (3, "")], "k int, v string")
    assert len({d(df), d(swapped), d(df.fillna("")), d(df.union(df.limit(1))), d(df.limit(0))}) == 5
    long = spark.range(50).selectExpr("id AS k", "'v' || id AS v")
    monkeypatch.setattr(canonical, "FAN", 4)
    assert d(long) == d(long.repartition(7)) != d(long.where("k != 33")) and canonical.table_digest(long, "k", ["v"]).first()["n"] == 50


def test_provenance_and_traces(spark):
    p = spark.createDataFrame([("a", "1" * 40), ("b", "1" * 40), ("b", "2" * 40), ("c", "2" * 40), ("d", ""), ("d", None)], "g string, sha string")
    assert rows(canonical.provenance(p, group=["g"], sha="sha", current="1" * 40), "g", "class") == [("a", "current_only"), ("b", "mixed"), ("c", "older_only"), ("d", "empty")]
    t = lambda **k: json.dumps({"hydration_trace": {"load_results": [{"requested_hydration": k.pop("how", "lazy")}, None, {}], **k}})
    want = {
        t(how="full"): "explicit_full", t(how="full", sparse_by_files_calls=1): "explicit_full_plus_sparse", t(lazy_full_materializations=1): "lazy_full",
        t(lazy_full_materializations=1, sparse_by_name_calls=3): "lazy_full_plus_sparse", t(sparse_by_id_calls=2): "sparse_only", t(lazy_ensure_calls=4): "metadata_or_file_state_only",
        json.dumps({"hydration_trace": json.dumps({"sparse_by_id_calls": 1})}): "sparse_only", '{"hydration_trace": {}}': "metadata_or_file_state_only",
        "{}": None, '{"hydration_trace": []}': None, "{": None, None: None,
    }
    df = spark.createDataFrame([(x,) for x in want], "t string")
    assert [r[0] for r in df.select(canonical.traces("t")).collect()] == list(want.values())
    c = canonical.trace_counters(df, "t", []).first()
    assert (c["n_traces"], c["n_loads"], c["lazy_full_materializations"], c["sparse_by_id_calls"], c["lazy_ensure_calls"]) == (8, 12, 2, 3, 4)


def test_schema_claims_and_markers(spark):
    df = spark.createDataFrame([("x <!-- claim:a.b=1.5x --> y <!-- claim:c=2 -->", "s"), (None, None)], "t string, u string")
    assert rows(integrity.claims_in(df, "t")) == [("a.b", "1.5x"), ("c", "2")]
    c = spark.createDataFrame([("a.b", "1.5x"), ("c", "3"), ("d", "1")], "key string, value string")
    assert rows(integrity.reconcile(c, integrity.claims_in(df, "t")), "key") == [("c",), ("d",)]
    with pytest.raises(ValueError, match=r"missing columns \['z'\], unknown columns \['u'\]"):
        integrity.expect_columns(df, ["t", "z"])
    assert rows(integrity.marker_scan(df, ["claim", "zz"])) == [("t", "claim", 1)]
    assert integrity.marker_scan(df, ["claim"], {"t": "u = 's'"}).count() == 0
    assert integrity.marker_scan(df, []).count() == 0


def test_redaction_and_paths(spark):
    df = spark.createDataFrame([("/home/me/x", "r"), ("see src/x", None), (None, "r")], "t string, repo string")
    out, changes = integrity.redact(df, {"/home/me": "<home>"}, {"repo": "<repo>"})
    assert rows(changes) == [("repo", 2), ("t", 1)]
    assert integrity.absolute_paths(df, "t").count() == 1 and integrity.absolute_paths(out, "t").count() == 0
    assert [integrity.valid_member(n) for n in ("indexes/example.db", "../example.db", "/indexes/example.db", "")] == [True, False, False, False]


def test_grid_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 1)], "x string, y int")
    assert rows(integrity.missing_cells(df, ["x", "y"])) == [("a", 2), ("b", 1)]
    assert integrity.duplicates(df, ["x", "y"]).count() == 1
    with pytest.raises(ValueError, match="a grid of 4 cells"):
        integrity.missing_cells(df, ["x", "y"], most=3)


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b.c.py",), (".bashrc",), ("a/.env.local",), ("plain",), (None,)], "p string")
    assert [r[0] for r in df.select(T.stem(F.col("p"))).collect()] == ["b.c", ".bashrc", ".env", "plain", None]
    assert [r[0] for r in df.select(T.head(F.col("p"))).collect()][:2] == ["a", ""]
    assert T.quoted("a`b") == "`a``b`"
    ident = df.select(T.row_identity(F.col("p"), F.lit(1))).collect()
    assert len(ident[0][0]) == 24 and ident[4][0] is None


def test_clipped_paths_and_audits(spark):
    rows_ = [(1, '["rc/a.py", "tests/b.py"]'), (2, '["src/a.py", "src/c.py"]'), (3, '["other/x"]'), (4, "[]"), (5, None), (6, "no list"), (7, '["ests/q"]')]
    df = spark.createDataFrame([(*r, "src") for r in rows_], "id int, p string, tm_h string")
    assert {r["id"] for r in integrity.clipped_first(df, "p").where("clipped").collect()} == {1, 7}
    assert integrity.clipped_first(df, "p").count() == 7 and integrity.clipped_first(df.limit(0), "p").count() == 0
    tables = {"a": df.select("id", "p"), "b": spark.createDataFrame([("src", 1.0), (None, 2.0)], "s string, x double")}
    assert rows(integrity.marker_audit(tables, ["src"])) == [("a", "p", "src", 1), ("b", "s", "src", 1)]
    assert rows(integrity.marker_audit(tables, ["src"], {"b": {"s": "x < 2"}})) == [("a", "p", "src", 1)]
    assert rows(integrity.table_audit(tables)) == [("a", 7, 2, 1), ("b", 2, 2, 1)]


def test_number_and_time_formats(spark):
    df = spark.createDataFrame([("2026-01-31 08:05:09.9", 7, 1.5, "pre_x"), (None, None, None, None)], "t string, n int, x double, s string").withColumn("t", F.col("t").cast("timestamp"))
    got = df.select(T.utc_stamp(F.col("t")).alias("a"), T.padded(F.col("n")).alias("b"), T.milliseconds(F.col("x")).alias("c"), T.without_prefix(F.col("s"), "pre_").alias("d"), T.without_prefix(F.col("s"), "x").alias("e")).collect()
    assert tuple(got[0]) == ("2026-01-31T08:05:09Z", "007", "1.500 ms", "x", "pre_x")
    assert tuple(got[1]) == (None,) * 5
