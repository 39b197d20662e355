import numpy as np
import pytest

from tidemark.llm import abuse

BAD = ["you are a worthless idiot", "shut up you pathetic moron", "go away you stupid clown", "I will smash your face you pig"]
GOOD = ["the cache was rebuilt after the second pass", "this stupid test is an idiot of a test", "please check the parser", "rows are sorted before the lock is taken", "the blocklist holds idiot and moron as data"]


def corpus(n=240, seed=0):
    g = np.random.default_rng(seed)
    texts, y = [], []
    for k in range(n):
        s = [GOOD[i] + f" {g.integers(0, 99)}" for i in g.integers(0, len(GOOD), 5)]
        bad = k % 5 == 0
        if bad:
            s[int(g.integers(0, 5))] = BAD[int(g.integers(0, len(BAD)))]
        texts.append(". ".join(s) + ".")
        y.append(float(bad))
    return texts, np.array(y)


@pytest.fixture(scope="module")
def model():
    return abuse.fit(*corpus())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 0.5, "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, score double, worst_sentence string").select("doc_id", "text", "source")


def scores(spark, model, texts):
    return [(r["score"], r["worst_sentence"]) for r in sorted(abuse.score(frame(spark, texts), model, carry=("source",)).collect(), key=lambda r: r["doc_id"])]


def test_held_out_documents_and_sentences(spark, model):
    texts, y = corpus(100, seed=9)
    got = scores(spark, model, texts)
    assert np.mean([(s >= 0.5) == (l > 0) for (s, _), l in zip(got, y)]) >= 0.97
    assert all(any(b in w for b in BAD) for (_, w), l in zip(got, y) if l > 0)


def test_disguises_count_like_the_plain_words(spark, model):
    hidden = ["you are a w0rthl3ss idiоt", "YOU ARE A WORTHLESS ID​IOT", "you are a worthless i d i o t", "you are a worthless i.d.i.o.t", "you are a woooorthless idiot", "you are a worthless i***t"]
    assert all(s >= 0.5 for s, _ in scores(spark, model, hidden))


def test_undisguised_words():
    w = lambda t: [a for a, _ in abuse.words(t)]
    assert w("1d107") == w("iiidiot") == w("i d i o t") == w("ID​IOT") == ["idiot"]
    assert w("see src/a_b.py and @me or 9e3779b1 at 12") == ["see", "<code>", "and", "<user>", "or", "<hex>", "at", "<number>"]


def test_empty_texts_long_texts_and_tables(spark, model):
    long = "please check the parser. " * 20_000
    got = scores(spark, model, [None, "", "  \n ", "...", long + BAD[0] + "."])
    assert [g for g in got[:4]] == [(0.0, None)] * 4
    assert got[4][1].startswith("you are a worthless idiot")
    assert scores(spark, model, []) == []


def test_no_labels_of_one_kind_learn_nothing():
    for y in ([], [0, 0], [1, 1]):
        m = abuse.fit(["a b", "c d"][: len(y)], np.array(y, float))
        assert not m.weights.any()


def test_noisy_or():
    p = abuse.noisy_or(np.array([0.0, 0.0, -50.0]), np.array([0, 0, 1]), 3)
    assert p == pytest.approx([0.75, 0, 0])


def test_labels_are_joined_and_bounded(spark):
    docs = frame(spark, ["a", "b", None, "d"])
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 1), (1, 0), (2, 1), (9, 1), (None, 1), (3, None)], "doc_id long, is_abusive int")
    texts, y = abuse.labelled(docs, labels)
    assert (texts, list(y)) == (["a", "b"], [pytest.approx(2 / 3), 0.0])
    assert len(abuse.labelled(docs, labels, limit=2)[0]) <= 2


def test_rates(spark, model):
    d = abuse.score(frame(spark, [BAD[0], GOOD[0]]), model, carry=("source",))
    r = abuse.rates(d, by="source").first()
    assert (r["documents"], r["abusive"], r["rate"]) == (2, 1, 0.5)


def test_training_is_bounded_in_rows_and_bytes(spark):
    from tidemark.llm.abuse import labelled

    docs = spark.createDataFrame([(i, None if i == 3 else "x" * 100) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 1), (5, None)], "doc_id long, is_abusive int")
    texts, y = labelled(docs, labels)
    assert len(texts) == 19 and sorted(set(y)) == [0.0, 0.5, 1.0]
    assert len(labelled(docs, labels, limit=7)[0]) in (6, 7)
    some, _ = labelled(docs, labels, most=550)
    assert len(some) == 5 and labelled(docs, labels, most=550)[0] == some
    assert labelled(docs.limit(0), labels)[0] == []
