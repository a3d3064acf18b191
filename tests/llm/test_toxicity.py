import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import awkward, documents

from tessera.llm import toxicity


def test_ratios_match_a_plain_kneser_ney():
    r = random.Random(3)
    make = lambda alphabet, n: ["".join(r.choice(alphabet) for _ in range(r.randint(1, 11))) for _ in range(n)]
    corpora = {1: make("abé", 60), 0: make("abcd", 200)}
    distinct = sorted(set(corpora[0]) | set(corpora[1]))
    keys, at = toxicity.grams(pa.array(distinct))
    row = np.repeat(np.arange(len(distinct)), np.diff(at))
    u, inv = np.unique(keys, return_inverse=True)
    counts = {c: np.bincount(inv, np.array([Counter(corpora[c])[w] for w in distinct])[row], len(u)) for c in (0, 1)}
    model = toxicity.fit(u, counts[1], counts[0])
    K, D = toxicity.ORDER, toxicity.DISCOUNT
    pad = lambda w: bytes(K - 1) + b" " + w.encode() + b" "
    occurrences = lambda w: [pad(w)[i - K + 1 : i + 1] for i in range(K, len(pad(w)))]
    full = {c: Counter(g for w in corpora[c] for g in occurrences(w)) for c in corpora}
    kinds = {K: set(full[0]) | set(full[1])}
    for n in range(K - 1, 0, -1):
        kinds[n] = {g[1:] for g in kinds[n + 1]}
    cont = {n: Counter(g[1:] for g in kinds[n + 1]) for n in range(1, K)}

    def shared(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        total = sum(v for x, v in cont[n].items() if x[:-1] == g[:-1])
        if not total:
            return shared(g[1:])
        t = sum(x[:-1] == g[:-1] for x in cont[n])
        return (max(cont[n][g] - D, 0) + D * t * shared(g[1:])) / total

    def prob(c, g):
        total = sum(v for x, v in full[c].items() if x[:-1] == g[:-1])
        if not total:
            return shared(g[1:])
        t = sum(x[:-1] == g[:-1] for x in full[c])
        return (max(full[c][g] - D, 0) + D * t * shared(g[1:])) / total

    tests = distinct[:15] + ["zz", "abzz", "ééabc"]
    got = toxicity.word_evidence(model, pa.array(tests))
    for w, e in zip(tests, got):
        assert math.isclose(e, sum(math.log(prob(1, g) / prob(0, g)) for g in occurrences(w)), abs_tol=1e-4)


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 80))]
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), "zorgh" + r.choice(["", "a", "ef", "!"]))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad), "clash"))
    return rows, labels


def test_held_out_accuracy_and_awkward_rows(spark):
    rows, labels = corpus(400, 1)
    odd = [((r[0] or 0) + 1000 if r[0] is not None else None, *r[1:]) for r in awkward()]
    df = documents(spark, rows + odd).selectExpr("*", "1 as score", "'x' as held_out", "lang as label")
    lab = spark.createDataFrame(labels + [(5, 1, None, None), (None, 0, 1, ""), (7, 1, 0, "")], "doc_id long, quality int, toxic int, text string")
    out = toxicity.classify(df, lab).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {d: t for d, _, t, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_without_labels_or_rows(spark):
    rows, labels = corpus(20, 2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.classify(documents(spark, rows), none).collect()} == {0.0}
    lab = spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int")
    assert toxicity.classify(documents(spark, []), lab).count() == 0


def test_long_labelled_texts_are_learned_from(spark):
    """Every toxic text of the sample is longer than 32 KB."""
    rows, labels = corpus(200, 6)
    rows = [(i, t + " abc" * 9000 if tox else t, *x) for (i, t, *x), (_, _, tox, _) in zip(rows, labels)]
    lab = spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int")
    model = toxicity.learn(documents(spark, rows), lab, toxicity.held_out())
    assert toxicity.scores(model, pa.array(["zorgh zorgha abc", "abc fed"]))[0] > 0.5 and "constant" not in model
