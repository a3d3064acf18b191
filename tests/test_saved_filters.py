import json

import pytest

from tessera.operators import saved_filters as SF
from tessera.operators.chunking import with_whole_texts
from tessera.plans.stages import Runner, detection, graph_signature


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_of_saved_filters(spark):
    have = spark.createDataFrame([("a", "one", "{}", 3)], "filter_id string, name string, spec string, uses long")
    new = SF.create(have, "b", "two", {"limit": 5})
    assert rows(new) == [("a", "one", "{}", 3), ("b", "two", json.dumps({"limit": 5}), 0)]
    assert rows(SF.create(new, "b", "again", {})) == rows(new)
    assert rows(SF.duplicate(have, "a", "c")) == [("a", "one", "{}", 3), ("c", "one (copy)", "{}", 0)]
    assert rows(SF.duplicate(new, "a", "b")) == rows(new) == rows(SF.update(new, "none", "x"))
    assert rows(SF.used(SF.update(have, "a", "x", {"limit": 1}), "a")) == [("a", "x", json.dumps({"limit": 1}), 4)]
    assert rows(SF.delete(new, "a")) == [("b", "two", json.dumps({"limit": 5}), 0)]
    for bad in (lambda: SF.create(have, "d", "x", {"limit": 0}), lambda: SF.update(have, "a", spec={"channels": "a"})):
        with pytest.raises(ValueError):
            bad()


def test_whole_texts_where_a_splitter_gives_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    pieces = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, piece int, text string")
    assert rows(with_whole_texts(docs, pieces)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c d")]


def test_detection_is_run_anew_for_another_graph_or_method_only(spark, tmp_path):
    graph = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "a string, b string, weight double")
    runner = Runner(spark, str(tmp_path))
    first = rows(detection(runner, graph, "components"))
    assert first == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(detection(runner, graph.repartition(3), "components")) == first
    assert graph_signature(graph) == graph_signature(graph.orderBy("b")) != graph_signature(graph.limit(1))
    detection(runner, graph.where("a <> 'x'"), "components")
    detection(runner, graph, "label_propagation")
    assert [x["status"] for x in runner.log] == ["completed", "reused", "completed", "completed"]
