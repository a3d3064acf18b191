from itertools import combinations

import numpy as np
import pytest
from helpers import WORD, awkward, documents, lower
from xxhash import xxh64_intdigest

from tessera.llm import simhash


def naive(text):
    w = WORD.findall(lower(text or ""))
    h = [xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(keys, links):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_near_duplicates_match_brute_force(spark):
    rows = awkward()
    got = simhash.near_duplicates(documents(spark)).collect()
    assert len(got) == len(rows)
    fp = {r[0]: naive(r[1]) for r in rows}
    root = roots([k for k in fp if k is not None], [(a, b) for a, b in combinations([k for k in fp if k is not None], 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    for r in got:
        assert int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == (root[r.doc_id] if r.doc_id is not None else None)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_tree_loses_no_pair(spark, radius):
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[r.integers(0, 300, 900)] ^ (np.uint64(1) << r.integers(0, 64, 900, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 900, dtype=np.uint64))
    fp = np.unique(np.concatenate((base, near)))
    links = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= radius) if j > i]
    want = roots(range(len(fp)), links)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fp.view(np.int64))], "key long, fingerprint long").repartition(4)
    by = {v: i for i, v in enumerate(fp.view(np.int64).tolist())}
    got = {by[x.fingerprint]: x.component for x in simhash.components(df, radius, leaf=20).collect()}
    assert got == want


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(seed, n=150):
    """Texts, and copies of them with ever more words changed."""
    r = np.random.default_rng(seed)
    word = lambda: f"w{r.integers(4000)}"
    rows = []
    for i in range(n):
        w = [word() for _ in range(int(r.choice([60, 200, 500])))]
        rows.append((1000 * i, " ".join(w), "en", "s", 1))
        for k in range(3):
            v = list(w)
            for j in r.choice(len(w), max(1, int(len(w) * r.choice([0.005, 0.01, 0.03, 0.1]))), replace=False):
                v[j] = word()
            rows.append((1000 * i + 1 + k, " ".join(v), "en", "s", 1))
    return rows


def test_near_documents_against_brute_force(spark):
    rows = edited(1) + [(500_000, None, "", "", 0), (500_001, "", "", "", 0), (None, "x y", "", "", 0), (500_002, "x y", "", "", 0), (500_002, "x y", "", "", 0)]
    got = simhash.near_documents(documents(spark, rows), leaf=60).collect()
    assert len(got) == len(rows)
    c = {r.key: r.component for r in got}
    assert c[None] is None and c[500_001] == 500_000 and c[500_002] == 500_002
    s = {k: shingles(t) for k, t, *_ in rows if k is not None}
    sure = [(a, b) for i in range(150) for a, b in combinations([1000 * i + k for k in range(4)], 2) if jaccard(s[a], s[b]) >= 0.88]
    assert len(sure) > 150 and np.mean([c[a] == c[b] for a, b in sure]) >= 0.95
    roots_ = roots([k for k in s], [(a, b) for i in range(150) for a, b in combinations([1000 * i + k for k in range(4)], 2) if jaccard(s[a], s[b]) >= 0.65])
    assert all(roots_[k] == roots_[v] for k, v in c.items() if k is not None and k < 500_000)


def test_sketches_estimate_the_index():
    import pyarrow as pa

    rows = edited(2, 60)
    s = simhash.sketches(pa.array([t for _, t, *_ in rows]))
    error = [simhash.estimated_jaccard(s[i : i + 1], s[j : j + 1])[0] - jaccard(shingles(rows[i][1]), shingles(rows[j][1])) for i, j in combinations(range(40), 2)]
    assert np.abs(error).max() < 0.2 and np.sqrt(np.mean(np.square(error))) < 0.05
    assert not simhash.sketches(pa.array([None, "", " "])).any()


def test_one_of_each_keeps_clean_rows(spark):
    rows = edited(3, 60)
    kept = {r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()}
    assert {r[0] for r in rows if r[0] % 1000 == 0} <= kept
    assert len(kept) < len(rows)


def test_recall_does_not_fall_with_the_number_of_rows(spark):
    # 2000 pieces to all rows; about 30 GB have 4000
    rows = edited(5, 500)
    c = {r.key: r.component for r in simhash.near_documents(documents(spark, rows), leaf=1).collect()}
    s = {k: shingles(t) for k, t, *_ in rows}
    sure = [(a, b) for i in range(500) for a, b in combinations([1000 * i + k for k in range(4)], 2) if jaccard(s[a], s[b]) >= 0.88]
    assert len(sure) > 500 and np.mean([c[a] == c[b] for a, b in sure]) >= 0.97
    assert all(k // 1000 == v // 1000 for k, v in c.items())


def test_texts_share_a_band_by_their_index():
    import pyarrow as pa

    rows = edited(6, 300)
    keys = simhash.band_keys(simhash.lowest(pa.array([t for _, t, *_ in rows])))
    s = [shingles(t) for _, t, *_ in rows]
    near = [(4 * i + a, 4 * i + b) for i in range(300) for a, b in combinations(range(4), 2) if 0.75 <= jaccard(s[4 * i + a], s[4 * i + b]) <= 0.9]
    assert len(near) > 50 and np.mean([(keys[a] == keys[b]).any() for a, b in near]) >= 0.98
    assert not any((keys[4 * i] == keys[4 * i + 4]).any() for i in range(299))


def test_one_of_each_keeps_unrelated_texts_of_one_id(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(80))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (2, text("b"), "en", "s", 1), (3, text("a") + " end", "en", "s", 1), (4, text("c"), "en", "s", 1), (4, text("c"), "en", "s", 1)]
    got = sorted((r.doc_id, r.text) for r in simhash.one_of_each(documents(spark, rows)).collect())
    assert got == [(1, text("a")), (1, text("b")), (4, text("c"))]
