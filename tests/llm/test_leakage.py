import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.leakage import align, around, leaks, own_passages, plain, rare_runs, stretches

DOCS, ITEMS = "doc_id long, text string, item long, h long", "item_id long, passage string, text string"


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(999)}" for _ in range(n)]


def found(spark, docs, items, **o):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], DOCS)
    e = spark.createDataFrame([(i, p, "x") for i, p in enumerate(items)], ITEMS)
    return sorted((r["doc"], r["item"]) for r in leaks(d, e, **o).collect())


ITEM = words(40, 1)
P = " ".join(ITEM)


def test_whole_and_partial_leaks_in_any_dress(spark):
    html = "see &lt;p&gt;" + " ".join(ITEM[:20]) + "&lt;/p&gt; &amp;amp; <b>" + " ".join(ITEM[20:30]) + "</b>"
    comment = "\n".join("# " + " ".join(ITEM[i : i + 6]) for i in range(0, 40, 6))
    escaped = '{"prompt": "' + "\\n ".join(ITEM[:25]) + '"}'
    loud = (" ,\n ".join(ITEM)).upper().replace("E", "E​")
    swapped = " ".join(ITEM[:12] + ["other"] + ITEM[13:30])
    assert found(spark, [P, html, comment, escaped, loud, swapped], [P]) == [(i, 0) for i in range(6)]


def test_what_is_no_leak(spark):
    quote = "he said " + " ".join(ITEM[3:14])
    broken = " ".join(w for i in range(0, 40, 7) for w in [*ITEM[i : i + 7], "cut"])  # stretches of seven
    backwards = " ".join(ITEM[26:40] + ["x"] + ITEM[12:26] + ["y"] + ITEM[:12])
    assert found(spark, [quote, broken, backwards, None, "", "   ", " ".join(words(60, 2))], [P]) == []


def test_shared_instructions_are_left_out(spark):
    head = "Read the text below with great care and pick just one of the answers given there. "
    items = [head + P, head + " ".join(words(40, 5)), "Short text."]
    assert found(spark, [head + "nothing else is here", head + P], items) == [(1, 0)]
    own = {r["item"]: len(r["words"]) for r in own_passages(spark.createDataFrame([(i, p, "") for i, p in enumerate(items)], ITEMS), item="item_id", passage="passage").collect()}
    assert own == {0: 40, 1: 40, 2: 2}


def test_equal_items_repeated_documents_and_long_texts(spark):
    long = " ".join(words(20_000, 9)) + " " + P
    assert found(spark, [P, P, long], [P, P, None, ""]) == [(d, i) for d in range(3) for i in range(2)]


def test_many_seeds_are_joined_by_shuffle(spark, monkeypatch):
    from tidemark.llm import leakage

    docs, items = [P, " ".join(ITEM[:30]), " ".join(words(50, 3)), None], [P, " ".join(words(40, 4))]
    small = found(spark, docs, items)
    monkeypatch.setattr(leakage, "BROADCAST_SEEDS", 0)
    assert found(spark, docs, items) == small == [(0, 0), (1, 0)]


def test_empty_tables(spark):
    assert found(spark, [], [P]) == found(spark, [P], []) == found(spark, [], []) == []


def test_plain(spark):
    df = spark.createDataFrame([("A&nbsp;b&#39;c <br/>D_e\\n\\u00e9 f", ), (None,)], "t string")
    assert [r[0] for r in df.select(plain(df["t"])).collect()] == ["a b c d e f", ""]


def brute(doc, item, least):
    """Greatest chain of common stretches, by dynamic programming over ends."""
    n, m = len(doc), len(item)
    run = np.zeros((n + 1, m + 1), int)
    best = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            run[i, j] = run[i - 1, j - 1] + 1 if doc[i - 1] == item[j - 1] else 0
            best[i, j] = max(best[i - 1, j], best[i, j - 1])
            for size in range(least, run[i, j] + 1):
                best[i, j] = max(best[i, j], best[i - size, j - size] + size)
    return best[n, m]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=18), st.lists(st.integers(0, 2), min_size=1, max_size=12))
def test_stretches_against_brute_force(doc, item):
    assert stretches(np.array([doc + [-1] * 3], int), np.array([item + [-2]]), 3)[0] == brute(doc, item, 3)
    near = around(np.array([w if w in item else -1 for w in doc], np.int32), np.array(item, np.int32), 3)
    assert stretches(near[None, :], np.array([item]), 3)[0] == brute(doc, item, 3)


def smith_waterman(a, b):
    """With skips of any length for 4."""
    h, top = np.zeros((len(a) + 1, len(b) + 1), int), np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            equal = a[i - 1] == b[j - 1]
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if equal else -1), h[i - 1, j] - 1, h[i, j - 1] - 1, top[i - 1, j - 1] - 2 if equal else 0)
            top[i, j] = max(h[i, j], top[i - 1, j], top[i, j - 1])
    return h.max()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=15), st.lists(st.integers(0, 3), min_size=1, max_size=15))
def test_alignment_against_the_textbook(a, b):
    assert align(np.array([a + [-1]], int), np.array([b + [-2]]))[0] == smith_waterman(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=60), st.integers(0, 10**6))
def test_a_leak_always_shows_a_rare_run(counts, seed):
    size = len(counts) + 7
    keep = rare_runs(np.arange(len(counts)), np.array(counts), size, 0.5)
    r = np.random.default_rng(seed)
    for _ in range(20):  # stretches that show no seed
        covered, i = np.zeros(size, bool), 0
        while i < len(keep):
            if not keep[i] and r.random() < 0.9:
                covered[i : i + 8] = True
            i += 1
        assert covered.sum() < 0.5 * size
    assert keep.any() and all(keep[i] for i in range(len(keep)) if counts[i] == 0)


def test_standing_instructions_of_any_length(spark):
    head = " ".join(f"Rule {k} says that you shall not look at line {k} of it." for k in range(9)) + " "
    items = [head + P, head + " ".join(words(40, 5))]
    assert found(spark, [head + "nothing else is here", head + P], items) == [(1, 0)]


def test_frequent_runs_lose_no_leak(spark):
    common = " ".join(ITEM[:18])
    docs = [common + " and more"] * 50 + [" ".join(ITEM[:24]), " ".join(ITEM[16:38]), P]
    assert found(spark, docs, [P]) == [(50, 0), (51, 0), (52, 0)]
