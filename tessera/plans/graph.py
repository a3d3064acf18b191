"""Queries: graph statistics, enrichment joins, traversal, communities and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..registry import query

c = F.col
r6 = lambda x: F.round(x, 6)

_DEGREES = "d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id), v AS (SELECT entity_id, coalesce(degree, 0) AS degree FROM entities LEFT JOIN d ON id = entity_id)"
_GRAPH = "g AS (SELECT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b, max(confidence) AS weight FROM relations WHERE subject_id <> object_id GROUP BY 1, 2)"


@query("A03_graph_statistics", "relations", "entities", sql=f"""
WITH {_DEGREES}, n AS (SELECT count(*) AS n FROM entities), m AS (SELECT count(*) AS m FROM relations)
SELECT n AS entities, m AS relations, round(2 * m / (n * (n - 1)), 6) AS density, round(m / n, 6) AS edge_node_ratio, (SELECT round(avg(degree), 6) FROM v) AS avg_degree, (SELECT max(degree) FROM v) AS max_degree, (SELECT min(degree) FROM v) AS min_degree, (SELECT count(*) FROM v WHERE degree = 0) AS isolated FROM n, m""")
def _(r, e):
    s = G.graph_statistics(r, e)
    return s.select(*[r6(c(x)).alias(x) if x in ("density", "edge_node_ratio", "avg_degree") else c(x) for x in s.columns])


@query("A03_degree_histogram", "relations", "entities", sql=f"WITH {_DEGREES} SELECT (degree // 5 * 5)::BIGINT AS bucket, count(*) AS count FROM v GROUP BY 1")
def _(r, e):
    return G.degree_histogram(r, e)


@query("A04_degree_and_centrality", "relations", sql=f"WITH {_DEGREES} SELECT id AS entity_id, degree, round(degree / (SELECT max(degree) FROM d), 6) AS centrality FROM d")
def _(r):
    return G.degree_centrality(r).select("entity_id", "degree", r6("centrality").alias("centrality"))


@query("A06_pair_density", "relations", "entities", sql="SELECT pairs, round(pairs / (n * (n - 1) / 2), 9) AS density FROM (SELECT count(*) AS pairs FROM (SELECT DISTINCT least(subject_id, object_id), greatest(subject_id, object_id) FROM relations WHERE subject_id <> object_id)), (SELECT count(*) AS n FROM entities)")
def _(r, e):
    return G.pair_density(r, e).select("pairs", F.round("density", 9).alias("density"))


@query("G01_undirected_graph", "relations", sql=f"WITH {_GRAPH} SELECT * FROM g")
def _(r):
    return G.undirected(r)


@query("J07_cooccurrence", "mentions", "relations", sql="""
WITH full_ AS (SELECT id FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id HAVING count(*) >= 200), m AS (SELECT DISTINCT chunk_id, entity_id FROM mentions WHERE entity_id NOT IN (SELECT id FROM full_))
SELECT a.entity_id AS subject_id, b.entity_id AS object_id, min(a.chunk_id) AS chunk_id, 0.7::DOUBLE AS confidence FROM m a JOIN m b USING (chunk_id) WHERE a.entity_id < b.entity_id
AND NOT EXISTS (SELECT 1 FROM relations r WHERE least(r.subject_id, r.object_id) = a.entity_id AND greatest(r.subject_id, r.object_id) = b.entity_id) GROUP BY ALL""")
def _(m, r):
    return G.cooccurrence(m, r)


@query("J09_cross_chunk", "mentions", "entities", sql="""
WITH k AS (SELECT DISTINCT video_id, chunk_id, said_at FROM mentions), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY said_at, chunk_id) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM k),
m AS (SELECT DISTINCT video_id, chunk_id, entity_id, i, CASE WHEN n <= 15 THEN 1 WHEN n <= 30 THEN 2 WHEN n <= 60 THEN 3 ELSE 5 END AS w, type FROM mentions JOIN p USING (video_id, chunk_id) JOIN entities USING (entity_id)),
t AS (SELECT * FROM (VALUES ('PERSON', 'CONCEPT', 'discusses'), ('PERSON', 'TECHNOLOGY', 'uses'), ('PERSON', 'ORGANIZATION', 'affiliated_with'), ('CONCEPT', 'CONCEPT', 'related_to'), ('CONCEPT', 'TECHNOLOGY', 'implemented_in'), ('TECHNOLOGY', 'TECHNOLOGY', 'works_with'), ('ORGANIZATION', 'TECHNOLOGY', 'develops')) v(x, y, p)),
q AS (SELECT a.entity_id AS subject_id, b.entity_id AS object_id, coalesce(t1.p, t2.p, 'mentioned_together') AS predicate, a.video_id, a.i, b.i - a.i AS d, a.chunk_id FROM m a JOIN m b ON a.video_id = b.video_id AND b.i > a.i AND b.i - a.i <= a.w AND a.entity_id <> b.entity_id
  LEFT JOIN t t1 ON t1.x = a.type AND t1.y = b.type LEFT JOIN t t2 ON t2.x = b.type AND t2.y = a.type),
f AS (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id, predicate ORDER BY video_id, i, d, chunk_id) AS rn FROM q)
SELECT subject_id, object_id, predicate, round(greatest(0.4, 0.6 - 0.05 * (d - 1)), 6) AS confidence, chunk_id FROM f WHERE rn = 1""")
def _(m, e):
    return G.cross_chunk(m, e).withColumn("confidence", r6("confidence"))


@query("J10_bidirectional", "relations", sql="""
WITH m AS (SELECT * FROM (VALUES ('uses', 'used_by'), ('part_of', 'has_part')) v(p, q)), every AS (SELECT subject_id, object_id, predicate, confidence FROM relations UNION ALL SELECT object_id, subject_id, q, confidence FROM relations JOIN m ON p = predicate)
SELECT subject_id, object_id, predicate, max(confidence) AS confidence FROM every GROUP BY ALL""")
def _(r):
    return G.bidirectional(r)


@query("J11_predictions_without_linked", "mentions", "relations", sql="""
WITH p AS (SELECT DISTINCT 's' || (substr(entity_id, 2)::BIGINT % 50) AS subject_id, entity_id AS object_id FROM mentions)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE (r.subject_id = p.subject_id AND r.object_id = p.object_id) OR (r.subject_id = p.object_id AND r.object_id = p.subject_id))""")
def _(m, r):
    p = m.select(F.concat(F.lit("s"), F.substring("entity_id", 2, 20).cast("long") % 50).alias("subject_id"), c("entity_id").alias("object_id")).distinct()
    return G.without_linked(p, r)


@query("G16_adamic_adar", "relation_rows", sql=f"""
WITH {_GRAPH}, w AS (SELECT a AS src, b AS dst FROM g UNION ALL SELECT b, a FROM g), dg AS (SELECT src, count(*) AS d FROM w GROUP BY src HAVING count(*) > 1),
p AS (SELECT x.dst AS a, y.dst AS b, sum(1 / ln(d)) AS score FROM w x JOIN w y ON x.src = y.src AND x.dst < y.dst JOIN dg ON dg.src = x.src GROUP BY ALL)
SELECT count(*) AS pairs, round(sum(score), 3) AS total, round(max(least(0.9, score / 10)), 6) AS top FROM p WHERE score > 0.5 AND NOT EXISTS (SELECT 1 FROM g WHERE g.a = p.a AND g.b = p.b)""")
def _(r):
    # the largest confidence of all rows of a pair is that of its relations
    return G.adamic_adar(G.undirected(r), named=False).agg(F.count("*").alias("pairs"), F.round(F.sum("score"), 3).alias("total"), r6(F.max("confidence")).alias("top"))


@query("G18_deduplicated_predictions", "relation_rows", sql="SELECT least(subject_id, object_id) AS subject_id, greatest(subject_id, object_id) AS object_id, predicate, max(confidence) AS confidence FROM relation_rows GROUP BY ALL")
def _(r):
    return G.deduplicated_predictions(r)


@query("G19_inferred_predicates", "relations", "entities", sql="""
WITH t AS (SELECT * FROM (VALUES ('PERSON', 'CONCEPT', 'discusses'), ('PERSON', 'TECHNOLOGY', 'uses'), ('PERSON', 'ORGANIZATION', 'affiliated_with'), ('CONCEPT', 'CONCEPT', 'related_to'), ('CONCEPT', 'TECHNOLOGY', 'implemented_in'), ('TECHNOLOGY', 'TECHNOLOGY', 'works_with'), ('ORGANIZATION', 'TECHNOLOGY', 'develops')) v(x, y, p))
SELECT coalesce(t1.p, t2.p, 'related_to') AS inferred, count(*) AS n FROM relations r JOIN entities a ON a.entity_id = subject_id JOIN entities b ON b.entity_id = object_id LEFT JOIN t t1 ON t1.x = a.type AND t1.y = b.type LEFT JOIN t t2 ON t2.x = b.type AND t2.y = a.type GROUP BY 1""")
def _(r, e):
    a, b = e.select(c("entity_id").alias("subject_id"), c("type").alias("t1")), e.select(c("entity_id").alias("object_id"), c("type").alias("t2"))
    return r.join(a, "subject_id").join(b, "object_id").groupBy(G.type_pair_predicate(c("t1"), c("t2"), G.CROSS_CHUNK, "related_to").alias("inferred")).agg(F.count("*").alias("n"))


@query("G14_ego_network", "relations", sql="""
WITH RECURSIVE w AS (SELECT subject_id AS src, object_id AS dst FROM relations UNION SELECT object_id, subject_id FROM relations), x AS (SELECT 'p7' AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM x JOIN w ON src = id WHERE hop < 2)
SELECT id AS entity_id, min(hop)::INT AS hop FROM x GROUP BY id ORDER BY hop, id LIMIT 100""")
def _(r):
    return G.ego_network(r, "p7")


@query("G15_shortest_paths", "relations", sql="""
WITH w AS (SELECT subject_id AS src, object_id AS dst FROM relations UNION SELECT object_id, subject_id FROM relations),
h1 AS (SELECT dst AS a FROM w WHERE src = 'p1'), p2 AS (SELECT 'p1>' || h1.a || '>' || w.dst AS path, w.dst AS fin FROM h1 JOIN w ON w.src = h1.a), d2 AS (SELECT 2::BIGINT AS length, path FROM p2 WHERE fin = 'p2')
SELECT * FROM d2 ORDER BY path LIMIT 3""")
def _(r):
    return G.shortest_paths(r, "p1", "p2")


@query("G06_connected_components", "orders", sql="""
SELECT 'c' || o_custkey AS entity_id, least('c' || o_custkey, min('o' || o_orderkey)) AS component FROM orders GROUP BY o_custkey
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders""")
def _(o):
    return G.connected_components(o.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b")))


@query("G11_modularity", "relations", sql=f"""
WITH {_GRAPH}, e AS (SELECT *, substr(a, length(a)) AS ca, substr(b, length(b)) AS cb FROM g), m AS (SELECT sum(weight) AS m FROM g),
p AS (SELECT ca AS k, CASE WHEN ca = cb THEN weight ELSE 0 END AS inside, weight AS d FROM e UNION ALL SELECT cb, 0, weight FROM e), s AS (SELECT k, sum(inside) AS inside, sum(d) AS d FROM p GROUP BY k)
SELECT round(sum(inside / m - pow(d / (2 * m), 2)), 6) AS modularity FROM s, m""")
def _(r):
    g = G.undirected(r)
    members = G.both_names(g).withColumn("community", F.substring("entity_id", -1, 1))
    return G.modularity(g, members).select(r6("modularity").alias("modularity"))


@query("G10_merge_small", "orders", "customer", sql="""
WITH g AS (SELECT 'n' || c_nationkey AS a, 'p' || substr(o_orderpriority, 1, 1) AS b, round(sum(o_totalprice), 9) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
best AS (SELECT a, arg_min(b, (-weight, b)) AS b FROM g GROUP BY a), other AS (SELECT b, arg_min(a, (-weight, a)) AS a FROM g GROUP BY b)
SELECT a AS entity_id, b AS community FROM best UNION ALL SELECT b, a FROM other""")
def _(o, u):
    g = o.join(u, c("o_custkey") == c("c_custkey")).groupBy(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("b")).agg(F.round(F.sum("o_totalprice"), 9).alias("weight"))
    alone = G.both_names(g).withColumn("community", c("entity_id"))
    return G.merge_small(g, alone, least=5)


@query("G08_organised_communities", "orders", sql="""
SELECT 'lvl1-' || substr(sha1(string_agg(id, ',' ORDER BY id)), 1, 12) AS community_id, count(*) AS entity_count, (count(*) - 1)::BIGINT AS relationship_count FROM (SELECT o_custkey AS k, 'o' || o_orderkey AS id FROM orders UNION ALL SELECT DISTINCT o_custkey, 'c' || o_custkey FROM orders) GROUP BY k""")
def _(o):
    pairs = o.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b"))
    members = pairs.select(F.explode(F.array(F.struct(c("a").alias("entity_id"), c("a").alias("community")), F.struct(c("b").alias("entity_id"), c("a").alias("community")))).alias("x")).select("x.*").distinct()
    return G.organised(pairs, members).select("community_id", "entity_count", "relationship_count")


def _ranks(rounds):
    steps = ", ".join(f"r{i} AS MATERIALIZED (SELECT p.dst AS id, 0.85 * sum(p.p * r.rank) + 0.15 / (SELECT n FROM n) AS rank FROM p JOIN r{i - 1} r ON r.id = p.src GROUP BY p.dst)" for i in range(1, rounds + 1))
    return f"""
WITH {_GRAPH}, w AS (SELECT a AS src, b AS dst, weight FROM g UNION ALL SELECT b, a, weight FROM g), t AS (SELECT src, sum(weight) AS total FROM w GROUP BY src), n AS MATERIALIZED (SELECT count(*) AS n FROM t),
p AS MATERIALIZED (SELECT w.src, dst, weight / total AS p FROM w JOIN t ON t.src = w.src), r0 AS (SELECT src AS id, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM t), {steps}
SELECT id AS entity_id, round(rank / (SELECT max(rank) FROM r{rounds}), 6) AS rank FROM r{rounds}"""


@query("G12_pagerank", "relations", sql=_ranks(20))
def _(r):
    return G.pagerank(G.undirected(r), 20).select("entity_id", r6("rank").alias("rank"))


@query("G12_small_graph_pagerank", "orders", "customer", sql="""
WITH RECURSIVE g AS (SELECT 'n' || c_nationkey AS a, 'p' || substr(o_orderpriority, 1, 1) AS b, count(*)::DOUBLE AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT a AS src, b AS dst, weight FROM g UNION ALL SELECT b, a, weight FROM g), t AS (SELECT src, sum(weight) AS total FROM w GROUP BY src), p AS (SELECT w.src, dst, weight / total AS p FROM w JOIN t ON t.src = w.src), n AS (SELECT count(*) AS n FROM t),
ids AS (SELECT src AS id FROM t),
r AS (SELECT 0 AS i, map_from_entries(list((id, 1.0::DOUBLE / n))) AS m FROM ids, n GROUP BY n
  UNION ALL SELECT r.i + 1, (SELECT map_from_entries(list((dst, s))) FROM (SELECT dst, 0.85 * sum(p.p * r.m[p.src]) + 0.15 / any_value(n) AS s FROM p, n GROUP BY dst)) FROM r WHERE r.i < 20),
f AS (SELECT unnest(map_entries(m)) AS x FROM r WHERE i = 20)
SELECT x.key AS entity_id, round(x.value / (SELECT max(x.value) FROM f), 6) AS rank FROM f""")
def _(o, u):
    g = o.join(u, c("o_custkey") == c("c_custkey")).groupBy(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    return G.pagerank(g, 20).select("entity_id", r6("rank").alias("rank"))


@query("G02_louvain", "relations")
def _(r):
    return G.louvain(G.undirected(r))


@query("G03_leiden", "orders", "customer")
def _(o, u):
    g = o.join(u, c("o_custkey") == c("c_custkey")).groupBy(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("b")).agg(F.sum("o_totalprice").alias("weight"))
    return G.leiden(g)


@query("G05_label_propagation", "relations")
def _(r):
    return G.label_propagation(G.undirected(r))


@query("G07_multi_resolution", "orders", "customer")
def _(o, u):
    g = o.join(u, c("o_custkey") == c("c_custkey")).groupBy(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("b")).agg(F.sum("o_totalprice").alias("weight"))
    return G.multi_resolution(g, [0.8, 1.2])


@query("K17_induced_subgraph", "relations", "mentions", "entities", sql="""
WITH m AS (SELECT DISTINCT entity_id FROM mentions WHERE video_id = 'c7')
SELECT to_json({'id': e.entity_id, 'type': e.type}) AS node FROM entities e JOIN m USING (entity_id)""")
def _(r, m, e):
    members = m.where("video_id = 'c7'").select("entity_id").distinct()
    return e.join(members, "entity_id", "left_semi").select(F.to_json(F.struct(c("entity_id").alias("id"), "type")).alias("node"))


@query("K19_graphml", "relations", sql="""SELECT '<edge source="' || subject_id || '" target="' || object_id || '"><data key="predicate">' || predicate || '</data></edge>' AS line FROM relations""")
def _(r):
    from ..sources.exports import graphml_edges

    return graphml_edges(r)
