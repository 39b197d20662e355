"""Abusive, hateful or sexual language, by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a
logistic model on hashed features; the document's is their noisy-or, one minus
the chance that no sentence offends. Training follows the gradient of the
documents' labels through the noisy-or, so it learns which sentences are to
blame without labels for sentences. Disguises (look-alike letters, digits for
letters, stretched, spaced and starred-out words) are undone first.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Features are hashed into 2**BITS weights.
BITS = 18
#: A document counts as abusive from this score on. With ample labels, abusive
#: documents score above 0.95; what lies between holds more harmless ones.
THRESHOLD = 0.7
#: The model is fitted on at most so many labelled documents (those with the
#: least hash of their id), which bounds what comes to the driver.
MAX_TRAIN = 20_000
#: And on at most so many bytes of text, again in the order of the hash.
MAX_BYTES = 512 * 1024 * 1024

#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
_LATIN = str.maketrans(LOOK_ALIKE)
_DIGIT = str.maketrans(DIGITS)
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_SPLIT = re.compile(r"\n+|(?<=[.!?;])\s+|(?<=[.!?;][\"')])\s+")
#: A line end is a token too: sentences have none inside, and are read together.
_TOKEN = re.compile(r"\n|`[^`\n]*`|@\w+|[^\W_]+(?:[*.\-_'’$@!/][^\W_]+|\*+[^\W_]*)*|\*+[^\W_]+|[?!]")
_CODE = re.compile(r"[a-z0-9]+(?:[._/][a-z0-9]+)+")
_HEX = re.compile(r"[0-9a-f]{7,}")
_SPACED = re.compile(r"(?<![^\W_])((?:[^\W\d_])(?:[ ]+|[.\-_*])(?:[^\W\d_](?:[ ]+|[.\-_*])){1,}[^\W\d_])(?![^\W_])")


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SPLIT.split(text)) if s]


@lru_cache(maxsize=200_000)
def _word(w: str) -> tuple[str, str]:
    """(word, kind): undisguised word, or what stands for it. A word with stars
    comes out as its shape."""
    if w[0] == "`":
        return "<code>", "code"
    if w[0] == "@":
        return "<user>", "user"
    if w in "?!":
        return w, "sign"
    if "*" in w:
        head, tail = w[0], w[-1]
        return (f"{head}{len(w)}{tail}" if head != "*" and len(w) > 2 else "<stars>"), "shape"
    if w.isdigit() or re.fullmatch(r"\d+(?:[.,]\d+)*", w):
        return "<number>", "number"
    if _HEX.fullmatch(w) and any(c.isdigit() for c in w):
        return "<hex>", "number"
    if any(c in "._/" for c in w) and _CODE.fullmatch(w):
        parts = re.split(r"[._/]", w)
        if all(len(p) == 1 for p in parts):
            return "".join(parts), "word"
        return "<code>", "code"
    if any(c.isdigit() for c in w):
        w = w.translate(_DIGIT)
    w = w.replace("$", "s").replace("!", "").replace("’", "'")
    w = re.sub(r"(.)\1{2,}", r"\1", w)
    return w, "word"


def _even(sentence: str) -> str:
    """Lower case, Latin letters for those that look like them."""
    s = sentence.lower()
    return s if s.isascii() else unicodedata.normalize("NFKC", _HIDDEN.sub("", sentence)).lower().translate(_LATIN)


def _tokens(lines: str) -> list[str]:
    return _TOKEN.findall(_SPACED.sub(lambda m: re.sub(r"[ .\-_*]+", "", m[1]), lines))


def words(sentence: str) -> list[tuple[str, str]]:
    return [_word(w) for w in _tokens(_even(sentence))]


_MASK = (1 << BITS) - 1
#: Stand before the first and after the last word of a sentence.
_BEGIN, _END = zlib.crc32(b"<s>"), zlib.crc32(b"</s>")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & _MASK


def _plain(w: str) -> str:
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def _own_slots(token: str) -> tuple[str, tuple[int, ...]]:
    """(what stands in word pairs, slots) of one token."""
    w, kind = _word(token)
    w = _plain(w)
    if kind == "word":
        out = ["w " + w]
        if len(w) > 2:
            out.append(f"x {w[0]}{len(w)}{w[-1]}")
        if len(w) > 5:
            out.append("p " + w[:5])
        return w, tuple(map(_slot, out))
    if kind == "shape":
        return "<x>", (_slot("x " + w), _slot("<starred>"))
    return w, (_slot(w),)


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Slots of word pairs, from the words' hashes."""
    return ((before * np.uint64(0x9E3779B1) + after) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS)


def features(said: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, sizes, lengths) of sentences: their slots in turn, each once a
    sentence and in order, how many there are of each sentence, and how many
    tokens. Slots stand for words, their shapes (which starred-out words share),
    their beginnings, and word pairs. Sentences that say the same in other
    spelling have the same slots. Tokens are looked at once, however often they
    come; all else is done for all sentences together."""
    if not said:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = pa.array(_tokens("\n".join(map(_even, said)) + "\n")).dictionary_encode()
    known = [("", ()) if t == "\n" else _own_slots(t) for t in found.dictionary.to_pylist()]
    at = found.indices.to_numpy()
    end = np.array([not x[1] for x in known])[at]
    row = np.cumsum(end) - end
    name = np.array([zlib.crc32(x[0].encode()) for x in known], np.uint64)
    own = np.full((len(known), 3), -1, np.int64)
    for k, (_, slots) in enumerate(known):
        own[k, : len(slots)] = slots
    # each token with the one before; a sentence's first with its beginning, its end with the last
    here = np.where(end, np.uint64(_END), name[at])
    before = np.r_[np.uint64(_BEGIN), np.where(end, np.uint64(_BEGIN), here)[:-1]]
    every = np.concatenate([_pair(before, here).astype(np.int64)[:, None], own[at]], axis=1)
    key = (row[:, None] << BITS | every)[every >= 0]
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return key & _MASK, np.bincount(key >> BITS, minlength=len(said)), np.bincount(row[~end], minlength=len(said))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, said: list[str]) -> np.ndarray:
        """Minus infinity for a sentence without a word."""
        slots, sizes, lengths = features(said)
        if not len(said):
            return np.zeros(0)
        total = np.add.reduceat(self.weights[slots], np.r_[0, np.cumsum(sizes)[:-1]])
        return np.where(lengths > 0, self.bias + total / np.sqrt(sizes), -np.inf)


def noisy_or(logits: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
    """Probability of each bag: one minus the product of (1 - p). Bags without
    sentences have 0."""
    clear = np.bincount(bag, weights=np.logaddexp(0, logits), minlength=bags)  # -log(1 - p), summed
    return -np.expm1(-clear)


def fit(texts: list[str], labels: np.ndarray, *, steps: int = 250, rate: float = 0.25, decay: float = 0.05, start: float = -7.0, common: float = 0.03, least: int = 1, noise: float = 0.02) -> Model:
    """Fit by Adam on the documents' log-likelihood. labels: share of raters who
    call the document abusive; positive documents weigh as much as the others
    together up to a factor of 8. noise: share of verdicts that are taken to be
    wrong, which keeps single ones from being learned by heart. common: share of
    documents from which on a feature has little leverage. Without both kinds of labels nothing can be
    learned, and every score is the one of the starting bias."""
    y = np.asarray(labels, float)
    weights, bias = np.zeros(1 << BITS), start
    if not len(y) or y.max() < 0.5 or y.min() >= 0.5:
        return Model(weights, bias)
    said = [(k, x) for k, t in enumerate(texts) for x in sentences(t)]
    slots, sizes, lengths = features([x for _, x in said])
    if not len(said) or not lengths.any():
        return Model(weights, bias)
    # equal sentences are one instance with one set of features
    key: dict[bytes, int] = {}
    uniq, inst, bag = [], [], []
    for (k, _), f, n in zip(said, np.split(slots, np.cumsum(sizes)[:-1]), lengths):
        if n:
            i = key.setdefault(f.tobytes(), len(key))
            if i == len(uniq):
                uniq.append(f)
            inst.append(i), bag.append(k)
    inst, bag = np.array(inst), np.array(bag)
    lens = np.array([len(f) for f in uniq])
    flat = np.concatenate(uniq)
    used, flat = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(uniq)), lens)
    scale = 1 / np.sqrt(lens)
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    # leverage: what many documents have tells little about any; what only one has, nothing
    each = np.unique(bag.astype(np.int64) * len(uniq) + inst)  # instances of each document
    doc_of, of = each // len(uniq), each % len(uniq)
    first = np.r_[0, np.cumsum(lens)[:-1]]
    take = np.repeat(first[of] - np.r_[0, np.cumsum(lens[of])[:-1]], lens[of]) + np.arange(lens[of].sum())
    pairs = np.unique(np.repeat(doc_of, lens[of]) * len(used) + flat[take])
    df = np.bincount(pairs % len(used), minlength=len(used))
    lever = np.where(df >= least, 1 / np.sqrt(1 + df / (common * len(y))), 0.0)
    value = lever[flat]
    w = np.zeros(len(used))
    heavy = min(8.0, max(1.0, (y < 0.5).sum() / max(1, (y >= 0.5).sum())))
    load = np.where(y >= 0.5, heavy, 1.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z_inst = bias + np.add.reduceat(w[flat] * value, starts) * scale
        z = z_inst[inst]
        prob = 1 / (1 + np.exp(-z))
        total = np.clip(noisy_or(z, bag, len(y)), 1e-9, 1 - 1e-9)
        # a share of verdicts is wrong either way: labels are 1 with probability noise + (1 - 2 noise) P
        seen = noise + (1 - 2 * noise) * total
        g = prob * (load * (1 - total) * (1 - 2 * noise) * ((1 - y) / (1 - seen) - y / seen))[bag]
        g_inst = np.bincount(inst, weights=g, minlength=len(uniq)) / load.sum()
        gw = np.bincount(flat, weights=(g_inst * scale)[row] * value, minlength=len(w)) + decay * w / len(y)
        gb = g_inst.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    weights[used] = w * lever
    return Model(weights, float(bias))


def labelled(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "is_abusive", limit: int = MAX_TRAIN, most: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and mean verdicts of at most limit labelled documents with at most
    most bytes of text together, whole texts, those with the least hash of their
    id first. A document with a NULL text or without verdict is left out."""
    votes = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc).alias("tm_doc")).agg(F.avg(label).alias("tm_y"))
    # at most limit rows, so they may be broadcast, and texts stay where they are
    votes = votes.orderBy(F.xxhash64("tm_doc"), "tm_doc").limit(limit)
    rows = docs.select(F.col(doc).alias("tm_doc"), F.col(text).alias("tm_text")).join(F.broadcast(votes), "tm_doc").where("tm_text IS NOT NULL").select("tm_doc", "tm_text", "tm_y")
    rows = materialise(rows.withColumn("tm_size", F.octet_length("tm_text")))
    if (rows.agg(F.sum("tm_size")).first()[0] or 0) > most:  # sizes alone are put in order
        upto = F.sum("tm_size").over(Window.orderBy(F.xxhash64("tm_doc"), "tm_doc"))
        rows = rows.join(rows.select("tm_doc", upto.alias("tm_upto")).where(F.col("tm_upto") <= most), "tm_doc", "left_semi")
    got = rows.orderBy("tm_doc").collect()
    return [r["tm_text"] for r in got], np.array([r["tm_y"] for r in got])


def score(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, score, worst_sentence, worst_score: for every
    row, its text read whole. A text that is NULL, blank or without words has
    the score 0 and no worst sentence. The model goes to the executors once, by
    broadcast: its size is fixed (2**BITS weights)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column("tm_text").to_pylist()
            split = [sentences(t) if t else [] for t in texts]
            said = [s for x in split for s in x]
            g = np.repeat(np.arange(len(texts)), [len(x) for x in split])
            z = m.sentence_logits(said)
            with_words = np.flatnonzero(z > -np.inf)
            z, g = z[with_words], g[with_words]
            p = noisy_or(z, g, b.num_rows) if len(g) else np.zeros(b.num_rows)
            worst: list = [None] * b.num_rows
            top = np.full(b.num_rows, -np.inf)
            np.maximum.at(top, g, z)
            lead = np.flatnonzero(z == top[g])
            for i in lead[::-1].tolist():  # the first of equal ones stays
                worst[g[i]] = said[with_words[i]]
            cols = [b.column(c) for c in b.schema.names if c != "tm_text"]
            tops = [None if x == -np.inf else float(1 / (1 + np.exp(-x))) for x in top]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array(worst, pa.string()), pa.array(tops, pa.float64())], [*[c for c in b.schema.names if c != "tm_text"], "score", "worst_sentence", "worst_score"])

    schema = ", ".join([f"doc_id {kinds[doc]}", *(f"`{c}` {kinds[c]}" for c in carry), "score double, worst_sentence string, worst_score double"])
    return docs.select(F.col(doc).alias("doc_id"), *carry, F.col(text).alias("tm_text")).mapInArrow(run, schema)


def rates(scored: DataFrame, *, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, abusive ones, their rate, mean score. NULL is a
    source of its own."""
    hit = F.col("score") >= threshold
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(hit).alias("abusive"), (F.count_if(hit) / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
