"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes. In every chunk learned filters slide over the bytes;
each filter's largest response is a feature of the chunk, a small hidden layer turns features into a chunk's logit, and
the mean of the chunk logits gives the text's probability.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sigmoid, string_bytes, with_scores

CHUNK, STEP = 256, 224
WIDTH, STRIDE = 12, 4
EMBED, FILTERS, HIDDEN = 4, 24, 16
#: The network is fitted on all chunks of so many labelled rows of each class at most, chosen by a hash of their id.
MAX_ROWS = 2500
EPOCHS = 5
SPOTS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(chunk bytes: n x CHUNK, zero behind a text's end; chunks of each text: one at least)."""
    data, at = string_bytes(texts)
    length = np.diff(at)
    count = 1 + np.maximum(0, -(-(length - CHUNK) // STEP))
    doc = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][doc] + nth * STEP
    out = np.zeros((len(doc), CHUNK), np.uint8)
    if len(data):
        padded = np.concatenate((data[at[0] : at[-1]], np.zeros(CHUNK, np.uint8)))
        out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[begin - at[0]]
        room = np.maximum(at[1:][doc] - begin, 0)
        out[np.arange(CHUNK)[None, :] >= room[:, None]] = 0
    return out, count


def start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    zeros = lambda *s: np.zeros(s, np.float32)
    return {"E": draw(256, EMBED, scale=0.5), "W": draw(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "b": zeros(FILTERS), "H": draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), "h": zeros(HIDDEN), "o": draw(HIDDEN, scale=HIDDEN**-0.5), "c": zeros(1)}


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of chunks, and what the gradient needs."""
    n = len(x)
    e = p["E"][x]
    s = e.strides
    patch = np.lib.stride_tricks.as_strided(e, (n, SPOTS, WIDTH * EMBED), (s[0], s[1] * STRIDE, s[2])).reshape(n * SPOTS, -1)
    r = (patch @ p["W"]).reshape(n, SPOTS, FILTERS)
    top = r.max(1)
    z = np.maximum(top + p["b"], 0)
    a = np.maximum(z @ p["H"] + p["h"], 0)
    return a @ p["o"] + p["c"], (patch, r, z, a)


def backward(p: dict[str, np.ndarray], x: np.ndarray, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
    patch, r, z, a = kept
    n = len(x)
    da = d[:, None] * p["o"] * (a > 0)
    dz = (da @ p["H"].T) * (z > 0)
    spot = r.argmax(1)
    rows = (np.arange(n)[:, None] * SPOTS + spot).ravel()
    taken = patch[rows].reshape(n, FILTERS, -1)
    dw = np.einsum("nf,nfk->kf", dz, taken, optimize=True)
    de = np.zeros_like(p["E"])
    dpatch = (dz[:, :, None] * p["W"].T[None]).reshape(n * FILTERS, WIDTH, EMBED)
    where = (spot * STRIDE)[:, :, None] + np.arange(WIDTH)
    letters = x[np.arange(n)[:, None, None], where].reshape(-1)
    for k in range(EMBED):
        de[:, k] = np.bincount(letters, dpatch[:, :, k].ravel(), 256)
    return {"E": de, "W": dw, "b": dz.sum(0), "H": z.T @ da, "h": da.sum(0), "o": a.T @ d, "c": d.sum(keepdims=True)}


def train(texts: pa.Array, good: np.ndarray, weight: np.ndarray, seed: int = 7) -> dict[str, Any]:
    """The network of labelled texts, by Adam; with one class only, its share is the score of every text."""
    if not len(good) or good.min() == good.max():
        return {"constant": float(good.mean()) if len(good) else 1.0}
    r = np.random.default_rng(seed)
    x, count = chunks(texts)
    doc = np.repeat(np.arange(len(texts)), count)
    y = good[doc].astype(np.float32)
    # the chunks of a text weigh as much as those of any other of its class
    w = (weight[doc] / count[doc]).astype(np.float32)
    # both classes weigh the same, so that 0.5 parts texts as likely under either
    for c in (0, 1):
        w[y == c] /= w[y == c].sum()
    w *= len(w) / 2
    p = start(seed)
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    steps = EPOCHS * max(1, -(-len(x) // 128))
    steps = max(steps, 300)
    at = 0
    turn = r.permutation(len(x))
    for _ in range(steps):
        if at >= len(x):
            turn, at = r.permutation(len(x)), 0
        rows = turn[at : at + 128]
        at += 128
        logit, kept = forward(p, x[rows])
        g = backward(p, x[rows], kept, (sigmoid(logit) - y[rows]).astype(np.float32) * w[rows] / len(rows))
        t += 1
        rate = 0.004 * (1 - 0.95 * t / steps)
        for k in p:
            grad = g[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            p[k] = p[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return p


def logits(p: dict[str, np.ndarray], texts: pa.Array, step: int = 512) -> np.ndarray:
    x, count = chunks(texts)
    out = np.concatenate([forward(p, x[a : a + step])[0] for a in range(0, len(x), step)]) if len(x) else np.zeros(0)
    return np.add.reduceat(out, np.cumsum(count) - count) / count if len(count) else np.zeros(0)


def scores(model: dict[str, Any], texts: pa.Array) -> np.ndarray:
    texts = texts.fill_null("")
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    return sigmoid(logits(model, texts).astype(np.float64))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, held: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> dict[str, Any]:
    """A model of the labelled rows that are not held out. Rows without a label of 0 or 1 are not used."""
    return train(*labelled_sample(docs, labels, held, key, text, label, max_rows))


def score(docs: DataFrame, model: dict[str, Any], text: str = "text") -> DataFrame:
    """``docs`` with the columns score and predicted, from all bytes of their texts.

    A null or empty text is one chunk of zero bytes; repeated rows get equal scores; an empty table stays empty. The
    columns of ``docs`` pass through, but a clashing score or predicted is replaced.
    """
    return with_scores(docs, docs.sparkSession.sparkContext.broadcast(model), scores, text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, held_out(key), key, text)
    return score(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text")), model).select("doc_id", "held_out", "score", "predicted")
