import pytest
from helpers import awkward, documents

import corpus_pipeline as cp
from tessera.llm import packing, quality, simhash, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    from test_quality import corpus

    rows, labels = corpus(240, 4)
    rows = [(r[0], r[1] + (" zorghful" * 4 if i % 5 == 0 else ""), *r[2:]) for i, r in enumerate(rows)]
    labels = [(d, q, int(d % 5 == 0)) for d, q, _, _ in labels]
    rows += [(1000 + (r[0] or 0), *r[1:]) for r in awkward() if r[0] is not None][:-1] + [(None, "no id at all", "en", "s", 1)]
    d = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def stage_by_stage(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        x = stage(spark, out[-1], d)
        out.append(spark.createDataFrame(x.collect(), x.schema))
    return out


def test_stages_against_their_operators(spark, tables):
    start, safe, good, single, clean, packed = stage_by_stage(spark, tables)
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = lambda df: sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)
    for df in (safe, good, single, clean):
        assert df.columns == COLUMNS
    for before, after, module, want in ((start, safe, toxicity, 0), (safe, good, quality, 1)):
        said = {r.doc_id: r.predicted for r in module.classify(before, labels).collect()}
        assert rows(after) == [r for r in rows(before) if said[r[0]] == want]
        assert 0 < after.count() < before.count()
    root = {r.key: r.component for r in simhash.near_documents(good).collect()}
    firsts = {k for k, c in root.items() if k == c}
    assert {r[0] for r in rows(single)} == firsts | {k for k in root if k is None}
    assert len(rows(single)) == len({r[0] for r in rows(single)})
    left = {r.doc_id: r.n_words - r.n_removed for r in substring.remove_repeats(single).collect()}
    assert {r[0]: len((r[1] or "").split()) for r in rows(clean)}.keys() == left.keys()
    assert sorted(map(str, (tuple(r)[:3] for r in packed.select("doc_id", "start", "length").collect()))) == sorted(map(str, (tuple(r)[:3] for r in packing.pack(clean).select("doc_id", "start", "length").collect())))


def test_run(spark, tables):
    assert cp.run(spark, tables).count() > 0


def test_stages_bear_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], documents(spark).schema)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, tables)
    assert docs.count() == 0


def test_extra_columns_of_any_name_come_through(spark, tables, tmp_path):
    """Values of columns that are named as the operators' own come through every stage but the last."""
    base = spark.read.parquet(f"{tables}/documents.parquet").drop("n_chars")
    extra = base.selectExpr("*", "concat('s', doc_id) as score", "concat('p', doc_id) as predicted", "doc_id + 1 as key", "'r' as row", "doc_id as id", "'x' as component", "1 as k1", "'label' as label", "text as kept")
    docs = extra
    want = {(r.doc_id, r.score, r.predicted, r.key, r.row, r.id, r.component, r.k1, r.label) for r in extra.collect()}
    for i, (name, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == extra.columns, name
    got = [(r.doc_id, r.score, r.predicted, r.key, r.row, r.id, r.component, r.k1, r.label) for r in docs.collect()]
    assert got and set(got) <= want
    assert cp.STAGES[-1][1](spark, docs, tables).count() >= len(got)
