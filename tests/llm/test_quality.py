import math
import random

import numpy as np
import pyarrow as pa
from helpers import awkward, documents

from tessera.llm import quality


def test_chunks_cover_every_byte():
    texts = ["", "a", "b" * 256, "c" * 257, "dé" * 1000, "e" * 5000]
    x, count = quality.chunks(pa.array(["skip", *texts]).slice(1))
    at = 0
    for t, n in zip(texts, count):
        raw = t.encode()
        back = bytearray(len(raw))
        for k in range(n):
            piece = raw[k * quality.STEP : k * quality.STEP + quality.CHUNK]
            assert x[at + k].tobytes() == piece.ljust(quality.CHUNK, b"\0")
            back[k * quality.STEP : k * quality.STEP + len(piece)] = piece
        assert bytes(back) == raw
        at += n


def test_gradient():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in quality.start().items()}
    x = r.integers(97, 103, (5, quality.CHUNK), dtype=np.uint8)
    d = r.standard_normal(5)
    _, kept = quality.forward(p, x)
    g = quality.backward(p, x, kept, d)
    for k in p:
        flat = p[k].reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = quality.forward(p, x)[0] @ d
            flat[i] = old - 1e-6
            down = quality.forward(p, x)[0] @ d
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-4


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + ("$$$" if bad and r.random() < 0.5 else "") for _ in range(r.randint(20, 300))]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), 0, "clash"))
    return rows, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    rows, labels = corpus(300, 1)
    odd = [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward()]
    df = documents(spark, rows + odd).selectExpr("*", "1 as score", "'x' as predicted", "lang as label")
    lab = spark.createDataFrame(labels + [(5, None, None, None), (None, 0, 1, "")], "doc_id long, quality int, toxic int, text string")
    out = quality.classify(df, lab).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {d: q for d, q, _, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_without_labels_or_rows(spark):
    rows, labels = corpus(20, 2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(documents(spark, rows), none).collect()} == {1.0}
    lab = spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int")
    assert quality.classify(documents(spark, []), lab).count() == 0


def test_scores_match_plain_loops():
    r = random.Random(5)
    p = {k: v.astype(np.float64) for k, v in quality.start(3).items()}
    p["b"] += 0.1
    p["h"] -= 0.05
    texts = ["", "a", "é" * 200, "".join(r.choice("ab \n日z") for _ in range(900))]

    def chunk_logit(raw):
        top = [-math.inf] * quality.FILTERS
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            patch = [p["E"][raw[at + i]][e] for i in range(quality.WIDTH) for e in range(quality.EMBED)]
            for f in range(quality.FILTERS):
                top[f] = max(top[f], sum(v * p["W"][i][f] for i, v in enumerate(patch)))
        z = [max(t + b, 0) for t, b in zip(top, p["b"])]
        a = [max(sum(z[f] * p["H"][f][k] for f in range(quality.FILTERS)) + p["h"][k], 0) for k in range(quality.HIDDEN)]
        return sum(x * o for x, o in zip(a, p["o"])) + p["c"][0]

    def score(text):
        raw, logits = text.encode(), []
        at = 0
        while True:
            logits.append(chunk_logit(raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")))
            if at + quality.CHUNK >= len(raw):
                return 1 / (1 + math.exp(-sum(logits) / len(logits)))
            at += quality.STEP

    assert np.allclose(quality.scores(p, pa.array(texts + [None])), [score(t) for t in texts] + [score("")], atol=1e-9)


def test_every_chunk_of_a_long_text_is_learned_from():
    """What marks the bad texts is in their last chunks only, far behind the first 32 KB."""
    r = random.Random(8)
    plain = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = [plain(33_000) + ("$$$ " * 800 if i % 2 else "abc " * 800) for i in range(12)]
    y = np.array([1 - i % 2 for i in range(12)])
    p = quality.train(pa.array(texts), y, np.ones(12))
    assert ((quality.scores(p, pa.array(texts)) >= 0.5) == (y == 1)).all()
