import hashlib

import numpy as np
import pytest
from helpers import awkward, documents

from tessera.llm import edit_fingerprint as ef
from tessera.llm.common import mix


def naive(text):
    """The walk, one character at a time."""
    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    c = [one(ord(x)) % ef.END for x in text] + [ef.END] * 3
    steps = max(ef.STEPS * len(text), 1)
    at, path = 0, []
    for j in range(steps):
        path.append(at)
        at += 0 if c[at] == ef.END else one(j + (1 << 52)) >> c[at] & 1
    out = []
    for d in range(ef.DIGITS):
        j = min(range(steps), key=lambda s: one(s + ((d + 1) << 40)))
        p = path[j]
        out.append(one((c[p] | c[p + 1] << 6 | c[p + 2] << 12 | d << 18) + 1) >> 60)
    return out


def test_fingerprints_match_the_naive_walk():
    texts = ["", "a", "é🙂", "the quick brown fox " * 6, "x" * 300, "ab" * 40, "日本語"]
    assert ef.fingerprints(texts).tolist() == [naive(t) for t in texts]
    assert len({len(h) for h in ef.hexadecimal(ef.fingerprints(texts))}) == 1


def words(r, n):
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(n))


def test_few_edits_keep_texts_alike():
    r = np.random.default_rng(3)
    near, far = [], []
    for _ in range(40):
        t = words(r, 300)
        k = int(r.integers(len(t)))
        a, b, c = ef.fingerprints([t, t[:k] + "XY" + t[k + 1 :], words(r, 300)])
        near.append(ef.likeness(a[None], b[None])[0])
        far.append(ef.likeness(a[None], c[None])[0])
    assert np.median(near) > 0.9 and max(far) < 0.2


@pytest.mark.parametrize("rows", [awkward(), awkward()[:1], [(5, None, "", "", 0)], [(i * 7 - 20, f"text {i} " * (i % 9), "", "", 0) for i in range(300)]], ids=["awkward", "one", "null", "many"])
@pytest.mark.parametrize("size", [2048, 7])
def test_rows_and_their_next_ones(spark, monkeypatch, rows, size):
    monkeypatch.setattr(ef, "RANGE", size)
    monkeypatch.setattr(ef, "TEXT_BYTES", 4000)
    got = sorted((tuple(r) for r in ef.compared(documents(spark, rows)).collect()), key=str)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = ef.fingerprints([t, edited, nxt])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *ef.hexadecimal(np.stack((a, b))), float(ef.likeness(a[None], b[None])[0]), float(ef.likeness(a[None], c[None])[0])))
    assert got == sorted(want, key=str)


def test_near_classes_match_brute_force(spark):
    r = np.random.default_rng(8)
    base = [words(r, 200) for _ in range(30)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("a", "b", 1), "", "", 0) for i, t in enumerate(base)] + [(200, base[3], "", "", 0), (201, base[3], "", "", 0), (None, base[3], "", "", 0), (202, None, "", "", 0)]
    prints = ef.fingerprint(documents(spark, rows))
    fp = {x.doc_id: x.fingerprint for x in prints.collect() if x.doc_id is not None}
    ids = sorted(fp)
    digits = {i: np.array([int(c, 16) for c in fp[i]]) for i in ids}
    root = {i: i for i in ids}
    for _ in range(4):
        for i in ids:
            root[i] = min([root[j] for j in ids if ef.likeness(digits[i][None], digits[j][None])[0] >= 0.9])
    got = {x.fingerprint: x.class_id for x in ef.near_classes(prints).collect()}
    assert {i: got[fp[i]] for i in ids} == root


def test_a_large_band_is_compared_whole_in_blocks(spark):
    """All fingerprints share their first digits; every other one has a partner that differs in one digit."""
    r = np.random.default_rng(2)
    digits = r.integers(0, 16, (60, ef.DIGITS), dtype=np.uint8)
    digits[:, : ef.BAND] = 7
    twins = digits[::2].copy()
    twins[:, ef.DIGITS - 1] ^= 1
    prints = ef.hexadecimal(np.concatenate((digits, twins)))
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    got = {x.fingerprint: x.class_id for x in ef.near_classes(df, limit=10).collect()}
    assert [got[p] for p in prints] == [*range(60), *range(0, 60, 2)]


def test_classes_of_rows(spark):
    rows = awkward()
    got = ef.classed(documents(spark, rows).selectExpr("*", "1 as class_id", "'f' as fingerprint")).collect()
    assert len(got) == len(rows) and all((r.class_id is None) == (r.doc_id is None) for r in got)
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[r.fingerprint] = min(least.get(r.fingerprint, r.doc_id), r.doc_id)
    assert all(r.class_id <= least[r.fingerprint] for r in got if r.doc_id is not None)


def test_records_of_many_steps():
    """Steps of several runs have the records of one pass over all of them."""
    bits = 18
    steps = np.arange(1 << bits, dtype=np.uint64)
    for d in (0, 5, ef.DIGITS - 1):
        low = np.minimum.accumulate(mix(steps + np.uint64((d + 1) << 40)))
        assert ef._records(bits)[d].tolist() == np.flatnonzero(np.concatenate(([True], low[1:] < low[:-1]))).tolist()


def test_empty_table(spark):
    assert ef.classed(documents(spark, [])).count() == 0
    assert ef.compared(documents(spark, [])).count() == 0
