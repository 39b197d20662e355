import numpy as np
import pytest

from tidemark.llm.mixing import count_tokens, mixture

DOCS, TARGETS = "doc_id long, text string, source string, tokens long, tilt double", "source string, target_weight double, max_repeats int, n int"


def run(spark, docs, targets):
    d = spark.createDataFrame([(i, t, s, 9, 9.0) for i, (s, t) in enumerate(docs)], DOCS)
    t = spark.createDataFrame([(*x, 5) for x in targets], TARGETS)
    documents, shares = mixture(d, t)
    return {r["doc_id"]: r for r in documents.collect()}, {r["source"]: r for r in shares.collect()}


def corpus(seed=0):
    g = np.random.default_rng(seed)
    return [(s, " ".join(["word"] * int(g.integers(5, 200)))) for s, n in (("big", 600), ("Mid Size", 250), ("mid-size", 50), ("small", 60), ("tiny", 4)) for _ in range(n)]


def test_shares_are_reached_and_caps_kept(spark):
    docs = corpus() + [(None, "word " * 300), ("stray", "word " * 200)]
    goals = [("big", 0.4, 1), ("mid_size", 0.35, 2), ("small", 0.15, 5), ("tiny", 0.05, 3), ("absent", 0.05, 9)]
    documents, shares = run(spark, docs, goals)
    total = sum(len(t.split()) for _, t in docs)  # " word" is one token
    assert [s for s, r in sorted(shares.items()) if not r["enough"]] == ["absent", "tiny"]
    for s in ("big", "mid_size", "small"):
        assert shares[s]["copies_tokens"] == pytest.approx(shares[s]["target_weight"] * total, rel=0.02)
    assert shares["mid_size"]["documents"] == 300 and shares["absent"]["copies_tokens"] == 0
    assert sum(r["reached_weight"] for r in shares.values()) == pytest.approx(1)
    caps = {s: c for s, _, c in goals}
    assert all(0 <= r["copies"] <= caps[r["source"]] and abs(r["copies"] - r["rate"]) < 1 + 1e-9 for r in documents.values())
    assert {r["copies"] for r in documents.values() if r["source"] == "tiny"} == {3}
    assert len(documents) == len(docs) - 2


def test_rates_are_the_exponential_tilt(spark):
    documents, shares = run(spark, corpus(1), [("big", 0.2, 1), ("small", 0.3, 9)])
    for s in ("big", "small"):
        own = [r for r in documents.values() if r["source"] == s and 0 < r["rate"] < {"big": 1, "small": 9}[s] - 1e-9]
        slope = np.array([np.log(r["rate"]) / r["tokens"] for r in own])
        assert len(own) > 20 and np.ptp(slope) < 1e-9
        assert sum(r["rate"] * r["tokens"] for r in documents.values() if r["source"] == s) == pytest.approx(shares[s]["target_tokens"], rel=1e-6)


def test_nulls_empty_texts_and_empty_tables(spark):
    documents, shares = run(spark, [("a", None), ("a", ""), ("a", "word"), (None, "word word"), ("", "word")], [("a", 0.6, 2), ("b", 0.0, 2)])
    assert [documents[i]["tokens"] for i in range(3)] == [0, 0, 1] and set(documents) == {0, 1, 2}
    assert not shares["a"]["enough"] and shares["b"]["enough"]
    none, shares = run(spark, [], [("a", 1.0, 2)])
    assert none == {} and shares["a"]["reached_weight"] == 0
    assert run(spark, [("a", "word")], []) == ({}, {})


def test_a_source_has_one_target(spark):
    with pytest.raises(ValueError, match="two targets"):
        run(spark, [("a", "x")], [("a b", 0.5, 1), ("A-B", 0.5, 1)])


def test_whole_texts_are_counted(spark):
    df = spark.createDataFrame([("word " * 50_000,), (None,), ("<|endoftext|>",)], "t string").coalesce(1)
    n = [r["tokens"] for r in count_tokens(df, "t").collect()]
    assert n[0] >= 50_000 and n[1] == 0 and n[2] > 1
