"""Composite stages, run control, publishing and splitters, by hand."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import graph as G
from tessera.operators import ingestion as I
from tessera.plans.stages import Runner, Stage
from tessera.sources import connectors as N
from tessera.streaming import queues as K


def test_compression_by_a_model(spark):
    df = spark.createDataFrame([(1, "aa bb.\n\ncc - dd\nee"), (2, "  "), (3, None), (4, "x" * 30 + "\n" + "y" * 5)], "video_id int, transcript string")
    got = {r.video_id: r for r in I.compressed(df, lambda prompts: [p.upper() for p in prompts], limit=12).collect()}
    assert {k: (r.units, r.compressed_text) for k, r in got.items()} == {1: (2, "AA BB. CC-DD EE"), 4: (2, "X" * 30 + " " + "Y" * 5)}
    plain = {r.video_id: r.compressed_text for r in I.compressed(df).collect()}
    assert plain == {1: "aa bb. cc-dd ee", 4: "x" * 30 + " " + "y" * 5}
    assert got[4].ratio == pytest.approx(1)


def test_enrichment_of_readable_and_unreadable_answers(spark):
    answers = {"good": '{"summary": "s", "entities": [{"name": " Ann ", "type": "person", "relevance": 2}, {"name": " "}], "concepts": [{"name": "c"}]}', "bad": "sorry", "other": "[1]"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*answers, " ", None])], "chunk_id int, text string")
    got = {r.chunk_id: r for r in I.enriched_by(df, F.col("text"), lambda prompts: [answers[p] for p in prompts]).collect()}
    assert {k: r.status for k, r in got.items()} == {0: "completed", 1: "failed", 2: "failed"}
    assert [tuple(e) for e in got[0].entities] == [("Ann", "Person", 1.0)] and got[0].quality.score == pytest.approx(0.5)
    assert got[0].embedding_text == "s\nEntities: Ann\nConcepts: c\ngood" and got[1].embedding_text == "bad" and got[1].quality.level == "low"


def _count(n):
    return Stage(f"s{n}", lambda spark, df: df.withColumn("n", F.lit(n)))


def test_a_paused_run_waits(spark, tmp_path):
    runner = Runner(spark, str(tmp_path / "run"), poll=0.05)
    runner.pause()
    t = threading.Thread(target=lambda: runner.run([_count(1)], spark.range(3)))
    t.start()
    time.sleep(0.5)
    assert t.is_alive() and runner.log == []
    runner.resume()
    t.join(60)
    assert [x["status"] for x in runner.log] == ["completed"]


def test_cancel_ends_a_running_stage(spark, tmp_path):
    slow = F.pandas_udf(lambda x: time.sleep(60) or x, "long")
    runner = Runner(spark, str(tmp_path / "run"))
    t = threading.Thread(target=lambda: runner.run([_count(1), Stage("slow", lambda s, df: df.select(slow("id").alias("id"))), _count(2)], spark.range(1)))
    t.start()
    until = time.time() + 30
    while not runner.log and time.time() < until:
        time.sleep(0.1)
    time.sleep(1)
    runner.cancel()
    t.join(30)
    assert not t.is_alive() and [(x["stage"], x["status"]) for x in runner.log] == [("s1", "completed"), ("slow", "cancelled")]


def test_a_failing_listener_goes_and_the_run_does_not(spark, tmp_path):
    told = []
    runner = Runner(spark, str(tmp_path / "run"), stop_on_error=False, listeners=(lambda e: 1 / 0, told.append))
    runner.run([_count(1), Stage("bad", lambda s, df: df.select("nothing"))], spark.range(2))
    assert [(e["stage"], e["status"], e["done"]) for e in told] == [("s1", "running", 0), ("s1", "completed", 1), ("bad", "running", 1), ("bad", "failed", 1)]


def test_published_in_batches(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(7)], "id int, value string").coalesce(1)
    got = {r.id: (r.confirmed, r.tries) for r in K.published(df, lambda bodies, t: [b != "3" and (b != "5" or t == 2) for b in bodies], batch=2, tries=2).collect()}
    assert got == {0: (True, 1), 1: (True, 1), 2: (True, 1), 3: (False, 2), 4: (True, 1), 5: (True, 2), 6: (True, 1)}


def test_splitters_agree_and_keep_keys(spark, monkeypatch):
    texts = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "w " * 1203), (None, "x y")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    C.register_splitters(spark)
    both = lambda rows: sorted(map(tuple, rows), key=str)
    got = spark.sql("SELECT doc_id, p.piece, p.tokens, p.text FROM {d}, LATERAL token_pieces(text, 5, 2) p", d=df).collect()
    assert both(got) == both(C.token_windows(df, 5, 2).select("doc_id", "piece", "tokens", "text").collect())
    # whether pieces are handed on at once or by document changes nothing
    whole = both(C.recursive_split(df, 20, 5).collect())
    monkeypatch.setattr(C, "HELD", 0)
    assert both(C.recursive_split(df, 20, 5).collect()) == whole and {r[0] for r in whole} == {1, 4, None}


def test_statistics_with_ends_that_are_no_vertices(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "a"), ("z", "a"), (None, "b")], "subject_id string, object_id string")
    s = G.graph_statistics(e, spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")).first()
    assert (s.entities, s.relations, s.isolated, s.max_degree, s.min_degree) == (3, 4, 1, 4, 0)
    nothing = G.graph_statistics(e.limit(0), spark.createDataFrame([], "entity_id string")).first()
    assert (nothing.entities, nothing.relations, nothing.density, nothing.avg_degree) == (0, 0, 0.0, 0.0)


def test_ontology_of_yaml():
    pytest.importorskip("yaml")
    assert N.load_ontology("canonical: [uses]\nconstraints:\n  uses: [[PERSON, TECHNOLOGY]]\n")["constraints"] == {"uses": [("PERSON", "TECHNOLOGY")]}
    assert N.load_ontology("a: [")["canonical"] == set() and N.load_ontology("just text")["canonical"] == set()


def test_compression_keeps_digits_and_cuts_only_the_sqls_spaces(spark):
    df = spark.createDataFrame([(1, "call 10\n21 or 31\n　ab\u000bcd-\u000b e"), (2, " \n ")], "video_id int, transcript string")
    assert {r.video_id: r.compressed_text for r in I.compressed(df).collect()} == {1: "call 10 21 or 31 ab\u000bcd-\u000b e"}


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    from tessera.operators import vectors as V
    from tessera.plans import stages

    near, inf = [1.0, 0.1], float("inf")
    rows = [(f"e{i}", ([1.0, 0.0], near, [0.0, 1.0])[i % 3]) for i in range(30)] + [("z1", [0.0, 0.0]), ("z2", [0.0, 0.0]), ("n1", None), ("i1", [inf, 1.0]), ("i2", [inf, 1.0])]
    df = spark.createDataFrame(rows, "entity_id string, embedding array<double>")
    want = {(r.a, r.b): round(r.score, 9) for r in V.similar_pairs(df, 0.95, "entity_id", "embedding").collect()}
    compared = []
    plain = V.similar_pairs
    monkeypatch.setattr(V, "similar_pairs", lambda v, *a, **k: compared.append(v.count()) or plain(v, *a, **k))
    got = stages.similar_entities(df, 0.95).collect()
    assert {(r.subject_id, r.object_id): r.confidence for r in got} == want and len(got) == len(want) == 190 + 45
    assert compared == [3]
