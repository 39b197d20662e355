import numpy as np
import pytest

from tidemark.llm.neighbours import search, similar_pairs, tables_for

S = "name string, v array<float>, id long, key long, h1 long"


def frame(spark, x, names=None):
    names = names or [f"n{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(n, None if v is None else [None if a is None else float(a) for a in v], 1, 2, 3) for n, v in zip(names, x)], S)


def clusters(n, dim, seed=0):
    g = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = g.normal(size=dim)
        for _ in range(int(g.choice([1, 1, 2, 4, 8]))):
            out.append((c + g.normal(size=dim) * g.uniform(0.05, 0.25)) * g.uniform(0.1, 9))
    return np.array(out[:n])


def truth(x, names, k=5, least=0.85):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 10), names[j]))[:k]:
            if s[i, j] >= least:
                out.add(tuple(sorted((names[i], names[j]))))
    return out


def planted(x, k=5, least=0.85):
    """truth() for names in the order of the rows, quickly."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 10)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(f"n{min(i, j):05d}", f"n{max(i, j):05d}") for i in range(len(x)) for j in best[i] if s[i, j] >= least}


def found(df, **o):
    return {(r["a"], r["b"]): r["cosine"] for r in similar_pairs(df, id_col="name", vector="v", **o).collect()}


def test_recall_and_precision(spark):
    x = clusters(2500, 96)
    names = [f"n{i:05d}" for i in range(len(x))]
    got, want = found(frame(spark, x), dim=96), truth(x.astype(np.float32).astype(float), names)
    assert len(want) > 1000
    assert len(want & got.keys()) / len(want) >= 0.97
    assert len(got.keys() - want) / len(got) <= 0.02
    assert all(c >= 0.85 and a < b for (a, b), c in got.items())


def test_many_exact_copies(spark):
    g = np.random.default_rng(1)
    x = [g.normal(size=16)] * 60 + [g.normal(size=16) for _ in range(40)]
    names = [f"n{i:02d}" for i in range(100)]
    want = {tuple(sorted((names[i], names[j]))) for i in range(60) for j in [j for j in range(60) if j != i][:5]}
    assert found(frame(spark, x, names), dim=16).keys() == want


def test_unusable_vectors_and_small_tables(spark):
    a = [1.0] * 8
    x = [a, [2.0] * 8, None, [1.0] * 7, [float("nan")] + a[1:], [float("inf")] + a[1:], [0.0] * 8, [None] + a[1:], [-1.0] * 8]
    assert found(frame(spark, x), dim=8).keys() == {("n00000", "n00001")}
    assert found(frame(spark, []), dim=8) == found(frame(spark, [a]), dim=8) == found(frame(spark, [None]), dim=8) == {}
    assert found(frame(spark, [a, a], [None, "b"]), dim=8) == {}
    tiny = [[1e-38] * 8, [1e38] * 8]
    assert found(frame(spark, tiny), dim=8).keys() == {("n00000", "n00001")}


def test_search_is_exact(spark):
    x = np.random.default_rng(5).normal(size=(700, 12)).astype(np.float32)
    df = frame(spark, x).repartition(5)
    got = search(df.where("name < 'n00030'"), df, id_col="name", vector="v", dim=12, block=7).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    np.fill_diagonal(s, -2)
    assert len(got) == 150
    for r in got:
        i = int(r["query"][1:])
        assert int(r["id"][1:]) == np.argsort(-s[i])[r["rank"] - 1]
    assert search(df.limit(0), df, id_col="name", vector="v", dim=12).count() == 0


def test_tables_grow_slowly():
    assert tables_for(2) >= 4
    assert tables_for(10**8) / tables_for(10**5) == pytest.approx(1000**0.2, rel=0.3)


@pytest.mark.parametrize("kind", ["noise 0.2", "noise 0.3", "rescaled"])
def test_a_third_of_all_are_near_copies(spark, kind):
    g = np.random.default_rng(11)
    c, n = g.normal(size=96), 3000
    if kind == "rescaled":
        near = c * g.uniform(0.01, 50, size=(n // 3, 1))
    else:
        near = (c + g.normal(size=(n // 3, 96)) * float(kind.split()[1])) * g.uniform(0.1, 9, size=(n // 3, 1))
    x = np.concatenate([near, clusters(n - n // 3, 96)])[g.permutation(n)].astype(np.float32)
    got, want = found(frame(spark, x), dim=96), planted(x.astype(float))
    assert len(want & got.keys()) / len(want) >= 0.97
    assert len(got.keys() - want) / len(got) <= 0.02


def test_recall_near_the_limit(spark):
    """Planted pairs at cosines from 0.85 to 0.90 among 10,000 vectors."""
    g = np.random.default_rng(3)
    n = 10_000
    a = g.normal(size=(n // 2, 96))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = g.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cos = g.uniform(0.8501, 0.9, size=(n // 2, 1))
    x = np.empty((n, 96))
    x[0::2], x[1::2] = a, cos * a + np.sqrt(1 - cos**2) * b
    got = found(frame(spark, x), dim=96)
    hit = np.array([(f"n{i:05d}", f"n{i + 1:05d}") in got for i in range(0, n, 2)])
    low = hit[cos[:, 0] < 0.86]
    print(hit.mean(), low.mean())
    assert hit.mean() >= 0.97 and low.mean() >= 0.95


@pytest.mark.parametrize("parts", ["1", "64", "200"])
def test_recall_does_not_depend_on_the_number_of_ranges(spark, parts):
    x = clusters(96, 96, seed=4).astype(np.float32)
    want, before = planted(x.astype(float)), spark.conf.get("spark.sql.shuffle.partitions")
    df = frame(spark, x)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = found(df, dim=96).keys()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    print(parts, len(want & got), len(want))
    assert len(want & got) / len(want) >= 0.97


@pytest.mark.parametrize("cosine", [0.90, 0.93, 0.98])
def test_recall_in_clusters_of_any_size(spark, cosine):
    """All pairs of a cluster are about as near, so the five nearest of each are
    hard to tell from the rest of it."""
    g = np.random.default_rng(int(cosine * 100))
    sizes, parts = [8] * 30 + [200] * 2 + [1000, 3000], []
    for size in sizes:
        c = g.standard_normal(96)
        c /= np.linalg.norm(c)
        z = g.standard_normal((size, 96))
        z -= (z @ c)[:, None] * c
        parts.append(np.sqrt(cosine) * c + np.sqrt(1 - cosine) * z / np.linalg.norm(z, axis=1, keepdims=True))
    x = np.concatenate([*parts, g.standard_normal((2000, 96))])
    x = (x * g.uniform(0.5, 3, (len(x), 1))).astype(np.float32)
    owner = np.repeat([*sizes, 0], [*sizes, 2000])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true: dict[int, set] = {s: set() for s in {*sizes, 0}}
    for lo in range(0, len(u), 1000):
        c = u[lo : lo + 1000] @ u.T
        c[np.arange(len(c)), np.arange(lo, lo + len(c))] = -2
        for i, near in enumerate(np.argpartition(-c, 5, axis=1)[:, :5]):
            true[owner[lo + i]] |= {(min(lo + i, int(j)), max(lo + i, int(j))) for j in near if c[i, j] >= 0.85}
    df = spark.createDataFrame([(f"{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, v array<float>")
    got = {(int(r["a"]), int(r["b"])) for r in similar_pairs(df, id_col="id", vector="v", dim=96).collect()}
    for size in set(sizes):
        assert len(true[size] & got) >= 0.97 * len(true[size]), size
