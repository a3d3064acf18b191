"""Scalar functions, filters and message rules on the cases that matter."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import filters as FL
from tessera.functions import scores as S
from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import series as M
from tessera.streaming import queues as K


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], *([F.lit(0).alias("_")] if not values else []))
    return row.select(column).first()[0]


@pytest.mark.parametrize("text,want", [("300s", 300), ("2m", 120), ("1h", 3600), ("500ms", 0.5), ("30", 30), ("", None), ("abc", None), ("10x", None), ("s", None)])
def test_durations(spark, text, want):
    assert one(spark, T.duration_seconds(F.col("t")), t=text) == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("text,want", [("PT1H2M3S", 3723), ("PT45S", 45), ("PT2M", 120), ("P1D", None), ("", None)])
def test_iso_durations(spark, text, want):
    assert one(spark, T.iso8601_seconds(F.col("t")), t=text) == want


@pytest.mark.parametrize("name,want", [("Dr. The  Smith Inc.", "smith"), (" ACME Corp ", "acme"), ("the theatre", "theatre"), (None, "")])
def test_entity_names(spark, name, want):
    assert one(spark, T.normalize_entity_name(F.col("t").cast("string")), t=name) == want


def test_text_functions(spark):
    assert one(spark, T.normalize_newlines(F.col("t")), t=" a\r\nb\r\r\r\rc\\nd ") == "a\nb\n\nc\nd"
    assert one(spark, T.dedup_lower(F.col("t")), t=[" A", "b", "a ", "", None]) == ["a", "b"]
    assert one(spark, T.seconds_to_hhmmss(F.col("t")), t=-5.0) == "00:00:00"
    assert one(spark, T.hhmmss_to_seconds(F.col("t")), t="01:02:03") == 3723
    assert one(spark, T.merge_descriptions(F.col("t")), t=["One. Two.", "two. Three."]) == "One. Two. Three."
    assert one(spark, T.snake_case(F.col("t")), t=" Était -> Là ") == "etait_la"
    assert one(spark, T.stemmed(F.col("t")), t="implements_building") == "implement_build"
    assert one(spark, T.xml_escape(F.col("t")), t="<a b='1'>&") == "&lt;a b=&apos;1&apos;&gt;&amp;"
    assert one(spark, T.query_intent(F.col("t")), t="Show me") == "explanatory"
    assert one(spark, T.compressed_text(F.col("t")), t="a\nb\nc\nd") == "abcd"


def test_scores(spark):
    c = lambda a, b: one(spark, S.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert c([1.0, 0.0], [0.0, 2.0]) == 0 and c([1.0], [1.0, 2.0]) == 0 and c([0.0], [1.0]) == 0 and c([3.0, 4.0], [6.0, 8.0]) == pytest.approx(1)
    assert one(spark, S.engagement_score(F.lit(0), F.lit(1), F.lit(1))) is None
    assert one(spark, S.rerank_score(F.lit(1.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.6 + 0.125 + 0.075)
    for op, want in {"==": True, "!=": False, "<": False, "<=": True, ">": True, ">=": True}.items():
        assert one(spark, S.compare(F.lit(op), F.lit(1.0 + 1e-13), F.lit(1.0))) == want


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "x", ["red", "blue"], 5.0), (2, None, None, None), (3, "y", [], 7.0)], "id int, kind string, tags array<string>, v double")


@pytest.mark.parametrize(
    "spec,want",
    [
        ({"kind": {"$ne": "x"}}, {2, 3}),
        ({"kind": None}, {2}),
        ({"kind": {"$nin": ["x"]}}, {2, 3}),
        ({"kind": {"$in": ["x", None]}}, {1, 2}),
        ({"tags": "red"}, {1}),
        ({"tags": {"$in": ["blue", "green"]}}, {1}),
        ({"tags": {"$all": ["red", "blue"]}}, {1}),
        ({"v": {"$gt": 5, "$lte": 7}}, {3}),
        ({"$or": [{"kind": "x"}, {"v": 7.0}]}, {1, 3}),
        ({"$nor": [{"kind": "x"}]}, {2, 3}),
        ({"kind": {"$exists": False}}, {2}),
        ({"kind": {"$regex": "^X", "$options": "i"}}, {1}),
        ({"v": {"$not": {"$gt": 6}}}, {1, 2}),
        ({}, {1, 2, 3}),
    ],
)
def test_compiled_filters(rows, spec, want):
    assert {r.id for r in rows.where(FL.compile_query(spec, rows.schema)).collect()} == want


def test_refused_filters(rows):
    for spec in ({"$where": "1"}, {"v": {"$function": {}}}):
        with pytest.raises(ValueError):
            FL.compile_query(spec, rows.schema)
    assert FL.validate_filter({"channels": ["a"], "limit": 10}) == []
    assert len(FL.validate_filter({"channels": "a", "limit": 10**6, "sort_by": "x", "duration": {"min_seconds": 5, "max_seconds": 1}, "has_transcript": 3})) == 5


@pytest.mark.parametrize("entries,want", [(None, 0), ([], 0), ([("q.retry.5s", 1)], 1), ([("q.retry.30s", 1), ("q.retry.5s", 1)], 2), ([("q.retry.5s", 1), ("q.retry.30s", 1), ("q.retry.2m", 1)], 3), ([("q", 5), ("other.retry.5s", 4)], 0), ([("q.retry.5s", 2)], 2), ([("q.retry.5s", None)], 0)])
def test_death_counts(spark, entries, want):
    df = spark.createDataFrame([(entries,)], "h array<struct<queue:string,count:bigint>>")
    got = df.select(K.death_count(F.col("h"), F.lit("q")).alias("n")).select("n", K.retry_tier(F.col("n"))).first()
    assert tuple(got) == (want, {0: "5s", 1: "30s", 2: "2m"}.get(want))


def test_routing(spark):
    bodies = ["not json", "{}", '{"id": "1", "type": "email.send", "payload": "{\\"to\\": \\"x\\"}"}', '{"id": "2", "type": "email.send", "payload": "{\\"to\\": \\"x\\", \\"subject\\": \\"s\\"}", "extra": 1}', '{"id": "3", "type": "odd", "payload": "{}"}']
    got = [(r.outcome, r.reason) for r in K.routed(K.decode(spark.createDataFrame([(b,) for b in bodies], "value string"))).collect()]
    assert got == [("dead_letter", "unreadable"), ("dead_letter", "unreadable"), ("dead_letter", "missing subject"), ("accept", None), ("dead_letter", "unknown_type")]


def test_final_status_holds(spark):
    rows = [("d", "processing", 1, 1), ("d", "completed", 2, 2), ("d", "failed", 3, 3), ("e", "odd", 1, 1), ("e", "processing", 2, 2), (None, "completed", 1, 1)]
    df = spark.createDataFrame(rows, "document_id string, status string, ts int, event_id int")
    assert {r.document_id: r.status for r in K.final_status(df).collect()} == {"d": "completed", "e": "processing"}


def test_histograms(spark):
    df = spark.createDataFrame([(v, "m") for v in (0.25, 0.5, 0.75, 2.0)], "value double, name string")
    got = {r.le: r["count"] for r in M.bucket_counts(df, "value", [0.5, 1.0], ["name"]).collect()}
    assert got == {0.5: 2, 1.0: 3, None: 4}
    q = lambda x: M.histogram_quantile(M.bucket_counts(df, "value", [0.5, 1.0], ["name"]), x, ["name"]).first().quantile
    assert q(0.25) == pytest.approx(0.25) and q(0.75) == pytest.approx(1.0) and q(0.99) == pytest.approx(1.0)


def test_counter_resets(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([1.0, 4.0, 2.0, 5.0])], "name string, ts int, value double")
    assert [r.increase for r in M.increases(df, ["name"]).orderBy("ts").collect()] == [0, 3, 2, 3]


def test_splitters(spark):
    text = "one two. three four. " * 40 + "x" * 150
    out = C.recursive_pieces(text, 100, 20)
    assert all(len(p) <= 100 for p in out) and set("".join(out)) == set(text)
    assert C.recursive_pieces("  ", 10, 2) == [] and C.recursive_pieces("abc", 10, 2) == ["abc"]
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, "a b")], "doc_id int, text string")
    got = {(r.doc_id, r.piece): r.text for r in C.token_windows(df, 4, 2).collect()}
    assert got == {(1, 0): "a b c d", (1, 1): "c d e f", (1, 2): "e f g", (3, 0): "a b"}
    units = df.sparkSession.createDataFrame([(["aa", "bb", "c" * 9, "d"],)], "u array<string>")
    assert units.select(C.packed_units(F.col("u"), 5)).first()[0] == ["aa\nbb", "c" * 9, "d"]


def test_package_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_paragraphs_lose_no_letters_but_spaces(spark):
    df = spark.createDataFrame([("x0\n1y1\n 2 \n \nz3",)], "text string")
    assert df.select(C.paragraphs(F.col("text"))).first()[0] == ["x0", "1y1", "2", "z3"]
