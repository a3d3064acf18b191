"""Two triangles joined by an edge, and what was added to them, by hand."""

import pytest

from tessera.operators import graph as G
from tessera.operators import quality as Q

TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(s, o, "uses", 1.0) for s, o in TRIANGLES], "subject_id string, object_id string, predicate string, confidence double")


@pytest.fixture(scope="module")
def vertices(spark):
    return spark.createDataFrame([(x, x, "CONCEPT", 0.5) for x in "abcdefg"], "entity_id string, name string, type string, confidence double")


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_degrees_and_statistics(edges, vertices):
    d = {r.entity_id: r.degree for r in G.degree_centrality(edges).collect()}
    assert d == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 2, "f": 2}
    s = G.graph_statistics(edges, vertices).first()
    assert (s.entities, s.relations, s.isolated, s.max_degree, s.min_degree) == (7, 7, 1, 3, 0)
    assert s.density == pytest.approx(2 * 7 / 42) and s.avg_degree == 2
    assert {r.bucket: r["count"] for r in G.degree_histogram(edges, vertices).collect()} == {0: 7}


def test_parallel_edges_loops_and_missing_ends(spark, edges, vertices):
    more = edges.unionAll(spark.createDataFrame([("b", "a", "has", 2.0), ("a", "a", "is_a", 1.0), ("a", "z", "uses", 1.0)], edges.schema))
    g = G.undirected(more, vertices)
    assert {(r.a, r.b): r.weight for r in g.collect()} == {**{(min(p), max(p)): 1.0 for p in TRIANGLES}, ("a", "b"): 2.0}
    assert G.pair_density(edges, vertices.where("entity_id <> 'g'")).first().density == pytest.approx(7 / 15)


@pytest.mark.parametrize("find", [G.louvain, G.leiden], ids=["louvain", "leiden"])
def test_communities(edges, find):
    g = G.undirected(edges)
    m = find(g)
    assert pairs(m) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert G.modularity(g, m).first()[0] == pytest.approx(5 / 14)


def test_louvain_is_no_worse_than_components_or_singles(spark):
    rows = [(f"n{i}", f"n{j}", "uses", 1.0) for k in range(6) for i in range(k * 8, k * 8 + 8) for j in range(i + 1, k * 8 + 8)] + [(f"n{k * 8}", f"n{(k * 8 + 8) % 48}", "uses", 1.0) for k in range(6)]
    g = G.undirected(spark.createDataFrame(rows, "subject_id string, object_id string, predicate string, confidence double"))
    q = lambda m: G.modularity(g, m).first()[0]
    found = G.louvain(g)
    assert found.count() == 48 and q(found) > 0.7
    assert q(found) >= q(G.connected_components(g).withColumnRenamed("component", "community"))


def test_components_with_a_long_path(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z")]
    got = pairs(G.connected_components(spark.createDataFrame(rows, "a string, b string")))
    assert got == {**{f"p{i:03}": "p000" for i in range(61)}, "x": "x", "y": "x"}
    assert set(pairs(G.connected_components(spark.createDataFrame(rows, "a string, b string"), 3)).values()) == {"p000"}


def test_traversal(edges):
    assert {r.entity_id: r.hop for r in G.ego_network(edges, "a").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert [tuple(r) for r in G.shortest_paths(edges, "a", "f").collect()] == [(3, "a>c>d>f")]
    assert G.shortest_paths(edges, "a", "nowhere").count() == 0
    assert [tuple(r) for r in G.shortest_paths(edges, "a", "a").collect()] == [(0, "a")]
    assert {r.entity_id for r in G.hop(edges, ["c"]).collect()} == {"a", "b", "d"}


def test_prediction_and_reverse(edges):
    from math import log

    got = {(r.a, r.b): r.score for r in G.adamic_adar(G.undirected(edges)).collect()}
    assert got == {k: pytest.approx(1 / log(3)) for k in [("a", "d"), ("b", "d"), ("c", "e"), ("c", "f")]}
    both = {(r.subject_id, r.object_id, r.predicate) for r in G.bidirectional(edges).collect()}
    assert both == {x for s, o in TRIANGLES for x in ((s, o, "uses"), (o, s, "used_by"))}


def test_label_propagation_and_pagerank(edges):
    g = G.undirected(edges)
    assert len(pairs(G.label_propagation(g))) == 6
    r = pairs(G.pagerank(g))
    assert max(r.values()) == pytest.approx(1) and r["c"] == pytest.approx(r["d"]) and r["a"] < r["c"]
    assert sum(pairs(G.pagerank(g, normalise=False)).values()) == pytest.approx(1)


def test_organise_split_and_merge(spark, edges):
    g = G.undirected(edges)
    m = G.louvain(g)
    by = {tuple(r.entities): (r.entity_count, r.relationship_count) for r in G.organised(g, m).collect()}
    assert by == {("a", "b", "c"): (3, 3), ("d", "e", "f"): (3, 3)}
    assert len(set(pairs(G.merge_small(g, m, least=5)).values())) == 2  # each joins the other, at once
    one = m.withColumn("community", m.entity_id.substr(1, 0))
    assert len(set(pairs(G.split_oversized(g, one, most=4)).values())) == 2


def test_cross_chunk_windows(spark):
    m = spark.createDataFrame([(f"e{i}", f"k{i:02}", "v", 0.9, i) for i in range(31)], "entity_id string, chunk_id string, video_id string, confidence double, said_at int")
    e = spark.createDataFrame([(f"e{i}", "OTHER") for i in range(31)], "entity_id string, type string")
    far = {}
    for r in G.cross_chunk(m, e).collect():
        d = int(r.object_id[1:]) - int(r.subject_id[1:])
        far[d] = round(r.confidence, 6)
    assert far == {1: 0.6, 2: 0.55, 3: 0.5}
    assert {int(r.object_id[1:]) - int(r.subject_id[1:]) for r in G.cross_chunk(m.where("said_at < 15"), e).collect()} == {1}


def test_coherence_and_percentiles(spark, edges, vertices):
    m = G.louvain(G.undirected(edges))
    got = {r.community: r.coherence for r in Q.coherence(m, vertices, edges).collect()}
    assert got == {"a": pytest.approx(0.4 + 0.15 + 0.3), "d": pytest.approx(0.85)}
    sizes = spark.createDataFrame([(i,) for i in [1, 1, 2, 3, 50]], "size int")
    assert tuple(Q.index_percentiles(sizes, "size", {"p50": 0.5, "p95": 0.95, "all": 1.0}).first()) == (2, 50, 50)


def test_adamic_adar_is_that_of_all_paths(spark, monkeypatch):
    """Against all two-hop paths in plain Python, in several blocks and portions."""
    import math
    import random

    rng = random.Random(4)
    links = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(240)} | {(0, k) for k in range(1, 40)} | {(70, 71)}
    name = lambda k: f"n{k}"
    near = {}
    for x, y in links:
        near.setdefault(name(x), set()).add(name(y))
        near.setdefault(name(y), set()).add(name(x))
    want = {}
    for a in near:
        for b in near:
            if a < b and b not in near[a]:
                s = sum(1 / math.log(len(near[v])) for v in near[a] & near[b])
                if s > 0.5:
                    want[a, b] = round(s, 9)
    g = spark.createDataFrame([(*sorted((name(x), name(y))),) for x, y in links], "a string, b string")
    for entries in (1, 50, G.ENTRIES):
        monkeypatch.setattr(G, "ENTRIES", entries)
        got = G.adamic_adar(g)
        assert {(r.a, r.b): round(r.score, 9) for r in got.collect()} == want
    assert not any("Join" in x and "via#" in x for x in got._jdf.queryExecution().toString().splitlines())  # two-hop paths are not rows


def test_a_task_of_adamic_adar_holds_few_arrays():
    """Two blocks of 2 million ways each: 64 bytes to a way at most. With lists as they came, it was over 100."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = []
    for right in (False, True):
        via, nodes = np.repeat(np.arange(0, 400_000, 4), 20), rng.integers(0, 50_000, 2_000_000) * 8 + right
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 20, dtype=np.int32)), pa.array(nodes))
        n = len(lists)
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(via[::20]), pa.array(np.full(n, 1000)), lists], ["i", "j", "via", "d", "nodes"])
        rows += [(0, 1, right, blob.as_py()) for out in G._packed(batch.slice(k, 10_000) for k in range(0, n, 10_000)) for blob in out.column("blob")]
    t = pa.table({k: pa.array(v) for k, v in zip(("i", "j", "right", "blob"), zip(*rows), strict=True)})
    tracemalloc.start()
    found = sum(x.num_rows for x in G._pair_scores(t, 3.0, 200_000))
    assert tracemalloc.get_traced_memory()[1] < 64 * 4_000_000
    tracemalloc.stop()
    assert found == 0
