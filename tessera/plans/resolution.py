"""Queries: entity and relation resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import resolution as RS
from ..registry import query

c = F.col
n = lambda: F.count("*")
r6 = lambda x: F.round(x, 6)


@query("A20_canonical_names", "entities", sql="""
WITH v AS (SELECT name, type, count(*) AS k, round(avg(confidence), 9) AS cf FROM entities GROUP BY name, type), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC, cf DESC, type) AS i FROM v)
SELECT name, type AS canonical FROM r WHERE i = 1""")
def _(e):
    return RS.canonical_names(e, "name", "type").select("name", "canonical")


@query("A21_voted_types", "entities", sql="""
WITH v AS (SELECT name, type, round(sum(confidence), 9) AS w FROM entities GROUP BY name, type), o AS (SELECT name, max(type) AS old FROM entities GROUP BY name), m AS (SELECT name, max(w) AS top FROM v GROUP BY name),
r AS (SELECT v.name, type, row_number() OVER (PARTITION BY v.name ORDER BY (type = old AND top - w < 0.1) DESC, w DESC, type) AS i FROM v JOIN o ON o.name = v.name JOIN m ON m.name = v.name)
SELECT name, type FROM r WHERE i = 1""")
def _(e):
    return RS.voted_types(e, "name", existing=e.groupBy("name").agg(F.max("type").alias("type")))


@query("A22_group_confidence", "entities", sql="""
SELECT name, round(greatest(0.0, least(1.0, avg(confidence) + 0.1 * log10(1 + count(*)) + 0.05 * (1.0 / count(DISTINCT type)))), 6) AS confidence FROM entities GROUP BY name""")
def _(e):
    return e.groupBy("name").agg(r6(S.group_confidence(F.avg("confidence"), n(), 1.0 / F.count_distinct("type"))).alias("confidence"))


@query("A23_groups_by_normalised_name", "entities", sql="SELECT lower(trim(name)) AS key, count(*) AS k, list_sort(list(DISTINCT description)) AS aliases FROM entities GROUP BY 1")
def _(e):
    return e.groupBy(T.normalize_entity_name(c("name")).alias("key")).agg(n().alias("k"), F.array_sort(F.collect_set("description")).alias("aliases"))


@query("A24_relation_groups", "relation_rows", sql="SELECT lower(trim(subject_id)) AS s, lower(trim(object_id)) AS o, lower(trim(predicate)) AS p, round(avg(confidence), 6) AS confidence, count(*) AS k FROM relation_rows GROUP BY 1, 2, 3")
def _(r):
    low = lambda x: F.lower(F.trim(x))
    return r.groupBy(low("subject_id").alias("s"), low("object_id").alias("o"), low("predicate").alias("p")).agg(r6(F.avg("confidence")).alias("confidence"), n().alias("k"))


@query("J12_blocking_candidates", "entities")
def _(e):
    return RS.candidates(e, e)


@query("J13_best_matches", "entities")
def _(e):
    return RS.best_matches(e, e)


@query("X25_canonical_predicates", "relation_rows", sql="""
SELECT CASE predicate WHEN 'uses' THEN 'uses' WHEN 'related_to' THEN 'associated_with' END AS predicate, count(*) AS k FROM relation_rows WHERE predicate <> 'part_of' GROUP BY 1""")
def _(r):
    return RS.canonical_predicates(r, {"related_to": "associated_with", "part_of": "__DROP__"}, {"uses", "associated_with"}).groupBy("predicate").agg(n().alias("k"))


@query("X26_allowed_type_pairs", "relations", "entities", sql="""
SELECT r.predicate, a.type AS subject_type, b.type AS object_type, count(*) AS k FROM relations r JOIN entities a ON a.entity_id = r.subject_id JOIN entities b ON b.entity_id = r.object_id
WHERE r.predicate <> 'uses' OR (a.type = 'ORGANIZATION' AND b.type IN ('TECHNOLOGY', 'CONCEPT')) GROUP BY ALL""")
def _(r, e):
    typed = r.join(e.select(c("entity_id").alias("subject_id"), c("type").alias("subject_type")), "subject_id").join(e.select(c("entity_id").alias("object_id"), c("type").alias("object_type")), "object_id")
    rules = r.sparkSession.createDataFrame([("uses", "ORGANIZATION", "TECHNOLOGY"), ("uses", "ORGANIZATION", "CONCEPT")], "predicate string, subject_type string, object_type string")
    return RS.allowed_type_pairs(typed, rules).groupBy("predicate", "subject_type", "object_type").agg(n().alias("k"))


@query("X27_symmetric_ends", "relations", sql="SELECT CASE WHEN predicate = 'related_to' THEN least(subject_id, object_id) ELSE subject_id END AS subject_id, CASE WHEN predicate = 'related_to' THEN greatest(subject_id, object_id) ELSE object_id END AS object_id, predicate FROM relations")
def _(r):
    return RS.symmetric_ends(r, ("related_to",)).select("subject_id", "object_id", "predicate")


@query("X19_description_similarity", "entities", sql="""
WITH d AS (SELECT name, description, count(*) AS n, list_distinct(list_filter(string_split(lower(description), ' '), lambda w: length(w) > 2)) AS w FROM entities GROUP BY name, description), f AS (SELECT * FROM d WHERE len(w) > 0),
p AS (SELECT a.name, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS s, a.n * b.n AS k FROM f a JOIN f b ON a.name = b.name AND a.description < b.description UNION ALL SELECT name, 1.0, n * (n - 1) // 2 FROM f WHERE n > 1),
g AS (SELECT name, sum(s * k) / sum(k) AS similarity FROM p GROUP BY name) SELECT name, round(coalesce(similarity, 0), 6) AS similarity FROM (SELECT DISTINCT name FROM entities) LEFT JOIN g USING (name)""")
def _(e):
    return RS.description_similarity(e, "name").withColumn("similarity", r6("similarity"))


@query("X28_edge_weights", "relations", "entities", sql="""
SELECT r.subject_id, r.object_id, r.predicate, round(greatest(0.1, least(1.0, r.confidence * CASE r.predicate WHEN 'uses' THEN 1.0 WHEN 'part_of' THEN 0.8 ELSE 0.5 END * CASE WHEN r.predicate IN ('uses', 'part_of') THEN 1.15 ELSE 0.85 END * CASE WHEN b.type IN ('TECHNOLOGY', 'CONCEPT') THEN 1.1 ELSE 0.8 END)), 6) AS weight
FROM relations r JOIN entities b ON b.entity_id = r.object_id""")
def _(r, e):
    from ..operators.weights import edge_weight

    typed = r.join(e.select(c("entity_id").alias("object_id"), c("type").alias("t")), "object_id")
    w = edge_weight(c("confidence"), F.when(c("predicate") == "uses", "extracted").when(c("predicate") == "part_of", "co_occurrence").otherwise("semantic_similarity"), c("predicate").isin("uses", "part_of"), c("t").isin("TECHNOLOGY", "CONCEPT"))
    return typed.select("subject_id", "object_id", "predicate", r6(w).alias("weight"))


@query("A42_canonicalisation_signals", "entities", sql="""
WITH p AS (SELECT a.entity_id AS a, b.entity_id AS b FROM entities a JOIN entities b ON lower(trim(a.name)) = lower(trim(b.name)) AND a.type = b.type AND a.entity_id < b.entity_id)
SELECT e.name, e.type, count(*) AS members FROM entities e GROUP BY e.name, e.type HAVING count(*) > 1""")
def _(e):
    return e.groupBy(c("name"), "type").agg(n().alias("members")).where("members > 1")
