import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import WORD, awkward, documents

from tessera.llm import substring


def brute(rows, window):
    texts = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out, kept_texts = [], []
    for r, w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        kept_texts.append((r[0], kept if gone else r[1]))
    return sorted(out, key=str), sorted(kept_texts, key=str)


def passages(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    shared = [[word() for _ in range(r.choice([34, 35, 36, 50, 120]))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.choice([0, 10, 60, 300]))]
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            k = r.randrange(len(w) + 1)
            w[k:k] = r.choice(shared)
        rows.append((i, "  ".join(w) if i % 2 else "\n".join(w), "en", "s", 1))
    return rows + [(500 + i, rows[i * 3][1], None, None, None) for i in range(10)]


@pytest.mark.parametrize("rows", [awkward(), passages(1), passages(2)], ids=["awkward", "passages", "more"])
def test_brute_force(spark, rows):
    want, kept = brute(rows, 35)
    assert sorted(map(tuple, substring.remove_repeats(documents(spark, rows)).collect()), key=str) == want
    clean = substring.cleaned(documents(spark, rows))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == kept


def test_frequent_windows_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring, "MOST_FREQUENT", 1000)
    base = passages(3)
    shared = base[5][1] if len(base[5][1].split()) > 60 else " ".join(f"z{i}" for i in range(80))
    rows = base + [(2000 + i, shared + f" tail{i}", "", "", 0) for i in range(130)]
    assert sorted(map(tuple, substring.remove_repeats(documents(spark, rows)).collect()), key=str) == brute(rows, 35)[0]


def test_small_windows_over_few_words(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.choice([0, 3, 8, 20]))), "", "", 0) for i in range(60)]
    got = sorted(map(tuple, substring.remove_repeats(documents(spark, rows), window=9, gram=3).collect()), key=str)
    assert got == brute(rows, 9)[0]


def test_run_hashes_are_of_the_stretch_only():
    h = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    for size in (1, 2, 3, 6, 8, 9, 31, 35):
        a = substring.run_hashes(h, size)
        assert len(a) == 200 - size + 1 and len(np.unique(a)) == len(a)
        assert a[50] == substring.run_hashes(h[50 : 50 + size], size)[0]


def test_empty_table(spark):
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def test_texts_are_not_held_with_windows(spark, tmp_path, monkeypatch):
    """cleaned() writes places of windows and cuts texts in the rows they came in."""
    r = random.Random(5)
    word = lambda: f"{r.getrandbits(60):x}"
    shared = " ".join(word() for _ in range(60))
    rows = [(i, f"{shared} {i} " + " ".join(word() for _ in range(2000)), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, "en", "s", 1)]
    monkeypatch.setattr("tessera.llm.common.shared_dir", lambda spark: str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in substring.cleaned(documents(spark, rows)).collect()), key=str) == brute(rows, 35)[1]
    held = {p.name: sum(x.stat().st_size for x in p.iterdir()) for p in (tmp_path / "tessera").iterdir() if not p.name.startswith("anchors-")}
    assert sum(held.values()) < 0.1 * sum(len(r[1] or "") for r in rows), held


def test_cleaned_takes_other_names_and_any_columns(spark):
    rows = passages(6)
    docs = documents(spark, rows).selectExpr("doc_id as id", "text as hits", "array(lang, null) as gone", "struct(source as s, n_chars) as k1", "cast(doc_id as decimal(20,2)) as c0", "timestamp_seconds(doc_id) as row")
    got = substring.cleaned(docs, "id", "hits")
    assert got.schema == docs.schema
    assert sorted(((r.id, r.hits) for r in got.collect()), key=str) == brute(rows, 35)[1]
    assert sorted(map(str, got.drop("hits").collect())) == sorted(map(str, docs.drop("hits").collect()))
