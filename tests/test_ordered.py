import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import index_tools, ordered


def test_running_max_over_pieces_of_a_hot_key(spark):
    g = np.random.default_rng(0)
    rows = [("hot" if g.random() < 0.8 else None, int(i), None if g.random() < 0.2 else int(g.integers(0, 10**6)), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v long, tm_x int").repartition(3)
    got = {r["i"]: r["top"] for r in ordered.running_max(df, keys=["k"], piece=F.floor(F.col("i") / 100), order=["i"], value=F.col("v"), out="top").collect()}
    best = {}
    for k, i, v, _ in rows:
        if v is not None:
            best[k] = max(best.get(k, v), v)
        assert got[i] == best.get(k)


def test_as_of_with_ties_nulls_and_nothing_before(spark):
    t = "timestamp '2024-01-0{} 10:00:00'"
    left = spark.sql(f"SELECT * FROM VALUES (1, 'a', {t.format(1)}), (2, 'a', {t.format(3)}), (3, 'b', {t.format(3)}), (4, null, {t.format(3)}), (5, 'a', null) AS v(id, k, ts)")
    right = spark.sql(f"SELECT * FROM VALUES (10, 'a', {t.format(2)}), (11, 'a', {t.format(3)}), (12, 'a', {t.format(3)}), (13, 'a', {t.format(4)}), (14, null, {t.format(1)}) AS v(rid, k, ts)")
    got = {r["id"]: r["matched"] for r in ordered.as_of(left, right, key="k", at="ts", carry="rid").collect()}
    assert got == {1: None, 2: 12, 3: None, 4: None, 5: None}
    assert ordered.as_of(left.limit(0), right, key="k", at="ts", carry="rid").count() == 0


def test_index_tools_on_nulls_and_empty_tables(spark):
    s = spark.createDataFrame([(1, "Foo.bar", "src/a.py", 10), (2, "foo", "src/a.py", None), (3, None, None, 5), (4, "Baz.foo", "tests/b.py", 7), (4, "Baz.foo", "tests/b.py", 7)], "id int, name string, file string, size int")
    for df, n in ((s, 1), (s.limit(0), 0)):
        assert index_tools.winnow(df, [F.col("size") > 5], F.col("size"), "id").count() == 3 * n
        assert [r["grade"] for r in index_tools.search_names(df, "name", "foo", "id").collect()] == [3, 2, 1, 1][: 4 * n]
        assert index_tools.tree(df, "file").count() == 2 * n
        assert index_tools.corrections(df, "name", "fooo").count() == 3 * n
        assert index_tools.hot_spots(df, "file", "size").count() == 3 * n
        assert index_tools.untested(df, "file", index_tools.owner(F.col("name"))).count() == 2 * n
        assert index_tools.outline(df, "file", "name", "id", ["src/a.py"]).count() == 2 * n
        assert index_tools.outline(df, "file", "name", "id", []).count() == 0
