"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Both classes have their own counts of byte n-grams of the highest order; all lower orders are continuation counts that
the classes share, so an expression that is rare in both gets the same likelihood from both. A word's evidence is the
difference of its two log-likelihoods; a text's score is a logistic function of evidence per word.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, logistic, sigmoid, string_bytes, with_scores, words

ORDER = 8
DISCOUNT = 0.75
#: The models are fitted on the whole texts of so many labelled rows of each class at most, chosen by a hash of their id.
MAX_ROWS = 2200
#: Parts of the sample that are scored by models of the other parts, so that the scale of evidence is that of new texts.
FOLDS = 3


def grams(flat: pa.Array, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """As _grams(), so many words at a time."""
    parts = [_grams(flat.slice(a, step)) for a in range(0, max(len(flat), 1), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))


def _grams(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bytes up to and including each byte of each word and of the space behind it, as uint64 (a word begins
    after a space and zero bytes), and where each word's grams begin."""
    data, at = string_bytes(flat)
    length = np.diff(at)
    begin = np.concatenate(([0], np.cumsum(length + 2)))
    out = np.full(int(begin[-1]), 32, np.uint64)
    if len(flat):
        inside = np.arange(int(length.sum()))
        where = inside + np.repeat(begin[:-1] + 1 - (at[:-1] - at[0]), length)
        out[where] = data[at[0] : at[-1]]
    first = begin[:-1]
    whole = out.copy()
    place = np.arange(len(out)) - np.repeat(first, length + 2)
    for k in range(1, ORDER):
        back = np.zeros_like(out)
        back[k:] = out[:-k]
        back[place < k] = 0
        whole |= back << np.uint64(8 * k)
    keep = place > 0
    return whole[keep], np.concatenate(([0], np.cumsum(length + 1)))


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return keys & np.uint64((1 << (8 * n)) - 1) if n < 8 else keys


def _totals(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weight, len(u))


def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def fit(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """Log-likelihood ratios of all seen 8-byte grams (counts by class given), and of unseen bytes after seen contexts.

    Where a byte after a context is in neither class, the shared probability cancels, so two tables hold all.
    """
    shared = np.full(len(keys), 1 / 256)
    for n in range(1, ORDER):  # continuation counts: distinct grams of one byte more that end in these n bytes
        seen = np.unique(_low(keys, n + 1))
        ends, cont = _totals(_low(seen, n), np.ones(len(seen)))
        heads, head_total = _totals(ends >> np.uint64(8), cont)
        _, head_kinds = _totals(ends >> np.uint64(8), np.ones(len(ends)))
        own = _low(keys, n)
        c, total, kinds = _find(ends, cont, own), _find(heads, head_total, own >> np.uint64(8)), _find(heads, head_kinds, own >> np.uint64(8))
        shared = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * shared) / total
    context = keys >> np.uint64(8)
    heads, at = np.unique(context, return_inverse=True)
    log, back = [], []
    for count in (toxic, ordinary):
        total, kinds = np.bincount(at, count), np.bincount(at, count > 0)
        left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        back.append(np.log(left))
        log.append(np.log(np.where(total > 0, 1, 0)[at] * np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1) + left[at] * shared))
    return {"grams": keys, "ratio": (log[0] - log[1]).astype(np.float32), "heads": heads, "head_ratio": (back[0] - back[1]).astype(np.float32)}


def word_evidence(model: dict[str, np.ndarray], flat: pa.Array) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    keys, at = grams(flat)
    if not len(keys):
        return np.zeros(0)
    got = _find(model["grams"], model["ratio"], keys, np.nan)
    gone = np.isnan(got)
    got[gone] = _find(model["heads"], model["head_ratio"], keys[gone] >> np.uint64(8))
    return np.add.reduceat(got, at[:-1])


def features(evidence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text: evidence per word, strong positive evidence per word, the square root of strong words per word, strong
    evidence in all up to a bound, and that of the strongest words alone, which ordinary texts lack at any length."""
    n = np.maximum(np.diff(at), 1)
    total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[at])
    strong = np.clip(evidence - 1.5, 0, 6)
    return np.stack([np.clip(total(np.clip(evidence, -2, 6)) / n, -1, 3), total(strong) / n, np.sqrt(total(strong > 0) / n), np.minimum(total(strong), 30) / 10, np.minimum(total(np.clip(evidence - 5, 0, 4)), 12) / 4], axis=1)


def train(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> dict[str, Any]:
    """The model of labelled texts; ``weight`` undoes the sampling of the classes. With one class only, its share is
    the score of every text."""
    if not len(toxic) or toxic.min() == toxic.max():
        return {"constant": float(toxic.mean()) if len(toxic) else 0.0}
    flat, at = words(texts, lower=True)
    coded = pc.dictionary_encode(flat)
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    keys, key_at = grams(distinct)
    word = np.repeat(np.arange(len(distinct)), np.diff(key_at))
    every, place = np.unique(keys, return_inverse=True)
    del keys, flat, coded

    def fitted(rows: np.ndarray) -> dict[str, np.ndarray]:
        counts = [np.bincount(place, np.bincount(ids[(rows & (toxic == c))[doc]], minlength=len(distinct))[word], len(every)) for c in (1, 0)]
        seen = counts[0] + counts[1] > 0
        return fit(every[seen], counts[0][seen], counts[1][seen])

    x = np.zeros((len(texts), 5))
    fold = np.zeros(len(texts), int)
    for c in (0, 1):
        fold[toxic == c] = np.arange(int((toxic == c).sum())) % FOLDS
    for k in range(FOLDS):
        if len(distinct):
            x[fold == k] = features(word_evidence(fitted(fold != k), distinct)[ids], at)[fold == k]
    model = fitted(np.ones(len(texts), bool))
    return model | {"logit": logistic(x, toxic, weight)}


def scores(model: dict[str, Any], texts: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    flat, at = words(texts, lower=True)
    coded = pc.dictionary_encode(flat)
    evidence = word_evidence(model, coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0)
    w, b = model["logit"]
    return sigmoid(features(evidence, at) @ w + b)


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> dict[str, Any]:
    """A model of the labelled rows that are not held out. Rows without a label of 0 or 1 are not used."""
    return train(*labelled_sample(docs, labels, held_out, key, text, label, max_rows))


def score(docs: DataFrame, model: dict[str, Any], text: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted, from their whole texts.

    A null, empty or wordless text has no evidence and gets the score of that; repeated rows get equal scores; an
    empty table stays empty. The columns of ``docs`` pass through, but a clashing score or predicted is replaced.
    """
    return with_scores(docs, docs.sparkSession.sparkContext.broadcast(model), scores, text)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, held_out(key), key, text)
    return score(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text")), model).select("doc_id", "held_out", "score", "predicted")
