import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, awkward, documents, lower

from tessera.llm import lm


def tokens(text):
    return [*WORD.findall(lower(text or "")), ""]


def brute(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(t for r, h in zip(rows, held) if not h for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r, h in zip(rows, held):
        t = tokens(r[1])
        out.append((r[0], h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)))
    return sorted(out, key=str)


def test_counts_and_base_match_brute_force(spark, monkeypatch):
    rows = awkward()
    for short in (32, 2):  # with few tokens among the frequent ones, most go through the join
        monkeypatch.setattr(lm, "SHORT", short)
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(documents(spark, rows)).collect()), key=str)
        want = brute(rows)
        key = lambda x: (str(x[:5]), x[5])
        for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)


@pytest.mark.parametrize("rows", [None, [(1, "alpha beta", "", "", 0)], [(1, "alpha beta beta", "", "", 0)], [(1, None, "", "", 0)], []], ids=["awkward", "once each", "one twice", "only an end", "nothing"])
def test_probabilities_sum_to_one(spark, rows):
    """Of all known tokens and one unknown token of each class that has such, after any context."""
    model, counts = lm.fit(documents(spark, rows).selectExpr("text"))
    c = {r.token: r.c for r in counts.collect()}
    _, _, classes = model.vocabulary.look_up(pa.array(list(c) or [""], pa.string()))
    inside = np.zeros(lm.CLASSES)
    np.add.at(inside, classes, [1.0 if k < lm.SINGLE else (n + 0.5) / 10 ** model.log_class_size[k] for k, n in zip(classes, list(c.values()) or [0])])
    unknown = np.array([0.5 / 10 ** model.log_class_size[k] if k >= lm.SINGLE else 0 for k in range(lm.CLASSES)])
    assert np.allclose((10**model.log_after).sum(1), 1)
    assert np.allclose((10**model.log_after) @ (inside + unknown), 1)
    assert set(np.round(inside[: lm.SINGLE], 9)) <= {0.0, 1.0}


def test_classes_grow_with_the_corpus(spark, monkeypatch):
    assert [lm.class_count(n) for n in (0, 10**8, 10**9, 10**10, 10**14)] == [512, 512, 1024, 4096, 4096]
    rows = awkward()
    small = {r.doc_id: r for r in lm.score(documents(spark, rows)).collect()}
    monkeypatch.setattr(lm, "class_count", lambda n: 1024)
    model, counts = lm.fit(documents(spark, rows).selectExpr("text"))
    c = {r.token: r.c for r in counts.collect()}
    _, _, classes = model.vocabulary.look_up(pa.array(list(c), pa.string()))
    assert model.log_after.shape == (1024, 1024) and classes.max() < 1024
    inside, own = np.zeros(1024), np.arange(1024) < 512
    np.add.at(inside, classes, [1.0 if k < 512 else (n + 0.5) / 10 ** model.log_class_size[k] for k, n in zip(classes, c.values())])
    unknown = np.where(own, 0.0, 0.5 / 10**model.log_class_size)
    assert np.allclose((10**model.log_after) @ (inside + unknown), 1)
    # the counts and the base do not depend on the classes
    for r in lm.score(documents(spark, rows)).collect():
        assert (r.n_known, r.n_tokens) == (small[r.doc_id].n_known, small[r.doc_id].n_tokens) and math.isclose(r.base_score, small[r.doc_id].base_score, rel_tol=1e-9)


def test_training_by_blocks_is_training_at_once(monkeypatch):
    counts = np.random.default_rng(5).poisson(2.0, (96, 96)).astype(float)
    monkeypatch.setattr(lm, "STEPS", 30)
    whole = lm.train(counts)
    monkeypatch.setattr(lm, "ROWS", 40)
    assert np.allclose(lm.train(counts), whole, atol=1e-6)


@pytest.mark.parametrize("rows", [[(3, "alpha beta", "", "", 0)], [(d, "alpha", "", "", 0) for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1]], ids=["one", "none"])
def test_one_or_no_training_rows(spark, rows):
    for r in lm.score(documents(spark, rows)).collect():
        assert r.score <= 0 and r.train_tokens == (0 if r.held_out else 3)


def test_score_of_a_text_by_hand(spark):
    rows = awkward()
    df = documents(spark, rows)
    got = {r.doc_id: r.score for r in lm.score(df).collect()}
    model, counts = lm.fit(df.where(~lm.held_out_column()).select("text"))
    c = {r.token: r.c for r in counts.collect()}
    for d, text, *_ in rows[:20]:
        t = tokens(text)
        k = model.vocabulary.look_up(pa.array(t, pa.string()))[2].tolist()
        want = sum(model.log_after[a, b] for a, b in zip([0, *k], k)) + sum(math.log10(c.get(x, 0) + 0.5) - model.log_class_size[b] for x, b in zip(t, k) if b >= lm.SINGLE)
        assert math.isclose(got[d], want, rel_tol=1e-6)


def test_model_beats_the_base_on_held_out_text(spark):
    r = np.random.default_rng(1)
    left, right = [f"a{i}x" for i in range(12)], [f"b{i}y" for i in range(12)]
    rows = [(i, " ".join(w for _ in range(30) for w in (left[r.integers(12)], right[r.integers(12)])), "", "", 0) for i in range(300)]
    out = lm.score(documents(spark, rows)).where("held_out").collect()
    # words alternate between two groups of twelve: knowing that is worth log10(2) of log10(24) a word
    assert sum(x.score for x in out) > sum(x.base_score for x in out) * 0.85


def test_empty_table(spark):
    assert lm.score(documents(spark, [])).count() == 0
