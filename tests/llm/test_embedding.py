import numpy as np
import pytest

from tessera.llm import embedding


def brute(rows, threshold=0.95):
    usable = [r[0] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if u else None for r, u in zip(rows, usable)]
    near = {i: [j for j in range(len(rows)) if j != i and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(rows))}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen) if r[0] is not None else None
        out.append((r[0], len(near[i]), c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def vectors(seed, n=200, d=12):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d))
    rows = [base[i] for i in range(n)]
    rows += [base[0] + r.standard_normal(d) * 0.12 for _ in range(90)]  # a dense group
    rows += [base[1] + r.standard_normal(d) * s for s in np.linspace(0.01, 0.6, 60)]
    for i in range(40):
        rows.append(base[2 + i] + r.standard_normal(d) * 0.05)
    for k in range(25):  # a chain
        rows.append(np.cos(k * 0.2) * np.eye(d)[0] + np.sin(k * 0.2) * np.eye(d)[1])
    rows += [base[5]] * 30 + [base[5] * 2] * 3
    out = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]
    out += [(900, None), (901, []), (902, [0.0] * d), (903, [float("nan")] * d), (904, [1.0] * (d - 1) + [None]), (905, [float("inf")] + [1.0] * (d - 1)), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, out[0][1]), out[7], out[7]]
    r.shuffle(out)
    return [(i if i is None else int(i), x) for i, x in out]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(a, b, 1, 0, "x") for a, b in rows], f"vec_id long, embedding array<{kind}>, label int, uid int, component string").repartition(4)


@pytest.mark.parametrize("options", [{}, {"chunk": 8}, {"block": 50, "window": 16, "chunk": 20}], ids=["plain", "chunks", "blocks"])
def test_brute_force(spark, options):
    rows = vectors(1)
    got = embedding.near_duplicates(frame(spark, rows), **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_doubles_and_a_threshold(spark):
    rows = vectors(2, 60, 5)
    got = embedding.near_duplicates(frame(spark, rows, "double"), threshold=0.99).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.99)


def test_empty_table(spark):
    assert embedding.near_duplicates(frame(spark, [])).count() == 0


def partners(x, r, cosine=0.951):
    """For each unit vector another one at that cosine, in a random direction."""
    y = r.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x * cosine + y * np.sqrt(1 - cosine**2)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def recall_of_pairs(spark, others, x, r, window):
    """The share of lone pairs that are found among ``others``, which link with nothing."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, partners(x, r), others)))]
    found = embedding.near_duplicates(frame(spark, rows, "double"), window=window).where("n_links > 0").select("vec_id").collect()
    return sum(v.vec_id < 2 * len(x) for v in found) / (2 * len(x))


@pytest.mark.parametrize("window", [64, 16, 4])
def test_recall_of_single_pairs(spark, window):
    """190 to 3000 windows of vectors; as many windows of 512 are 100,000 to 1,500,000 vectors."""
    r = np.random.default_rng(4)
    assert recall_of_pairs(spark, unit(r.standard_normal((8000, 64))), unit(r.standard_normal((2000, 64))), r, window) >= 0.95


@pytest.mark.parametrize("window", [64, 16])
def test_recall_in_a_dense_cone(spark, window):
    """All vectors have a cosine of about .8 with each other, far below a link."""
    r = np.random.default_rng(6)
    centre = unit(r.standard_normal((1, 64)))

    def cone(n):
        away = r.standard_normal((n, 64))
        away -= (away @ centre.T) * centre
        return np.sqrt(0.8) * centre + np.sqrt(0.2) * unit(away)

    assert recall_of_pairs(spark, cone(8000), cone(2000), r, window) >= 0.95


def test_passes_follow_the_number_of_vectors():
    x = unit(np.random.default_rng(7).standard_normal((5000, 32)))
    n = [embedding.passes_for(x, total, 512, 0.95) for total in (100, 10**4, 10**6, 10**8)]
    assert n == sorted(n) and n[0] == embedding.MIN_PASSES < n[-1]


def test_large_pairs_of_chunks_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TILE", 7)
    rows = vectors(3, 80)
    assert sorted(map(tuple, embedding.near_duplicates(frame(spark, rows), chunk=50).collect()), key=str) == brute(rows)
