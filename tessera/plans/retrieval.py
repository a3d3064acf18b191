"""Queries: vectors, keywords, hybrid search, reranking, redundancy, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import retrieval as RT
from ..operators import vectors as V
from ..registry import query

c = F.col
r6 = lambda x: F.round(x, 6)
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_QSQL = "[" + ",".join(str(x) for x in _QUERY) + "]"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("V01_vector_search", "embeddings", sql=f"SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_QSQL}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_QSQL}::DOUBLE[]) DESC, vec_id LIMIT 8")
def _(e):
    return V.vector_search(e, _QUERY).select("vec_id", r6("score").alias("score"))


@query("J08_similar_pairs", "embeddings", sql=f"WITH {_UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35")
def _(e):
    return V.similar_pairs(e, 0.35).select("a", "b", r6("score").alias("score"))


@query("J14_nearest_in_group", "embeddings", sql=f"""
WITH {_UNIT}, s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rn FROM s) SELECT vec_id, other, round(score, 6) AS score FROM r WHERE rn = 1""")
def _(e):
    return V.nearest(e, 1, group="label").select(c("key").alias("vec_id"), "other", r6("score").alias("score"))


@query("J15_W06_top_neighbours", "embeddings", sql=f"""
WITH {_UNIT}, s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rn FROM s) SELECT vec_id, other, rn AS rank FROM r WHERE rn <= 5""")
def _(e):
    return V.nearest(e, 5).select(c("key").alias("vec_id"), "other", c("rank").cast("long").alias("rank"))


@query("G17_embedding_predictions", "embeddings", sql=f"""
WITH {_UNIT}, s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rn FROM s WHERE score >= 0.2) SELECT vec_id, count(*) AS predicted, round(max(score), 6) AS best FROM r WHERE rn <= 5 GROUP BY vec_id""")
def _(e):
    from ..operators.relational import top_per

    pairs = V.similar_pairs(e, 0.19999)
    both = pairs.select(F.explode(F.array(F.struct(c("a").alias("vec_id"), c("b").alias("other"), "score"), F.struct(c("b").alias("vec_id"), c("a").alias("other"), "score"))).alias("x")).select("x.*").withColumn("score", F.round("score", 12)).where("score >= 0.2")
    kinds = e.select("vec_id", "label")
    open_ = both.join(kinds, "vec_id").join(kinds.select(c("vec_id").alias("other"), c("label").alias("l2")), "other").where("label <> l2")
    return top_per(open_, ["vec_id"], [c("score").desc(), c("other")], 5).groupBy("vec_id").agg(F.count("*").alias("predicted"), r6(F.max("score")).alias("best"))


@query("P07_redundancy", "embeddings", sql=f"""
WITH {_UNIT}, s AS (SELECT a.label, a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 12) AS score FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rn FROM s), n AS (SELECT * FROM r WHERE rn = 1)
SELECT e.vec_id, round(coalesce(score, -1), 6) AS redundancy_score, coalesce(score >= CASE WHEN abs(e.vec_id - other) = 1 THEN 0.5 ELSE 0.3 END AND other < e.vec_id, false) AS is_redundant FROM embeddings e LEFT JOIN n USING (vec_id)""")
def _(e):
    from ..functions.scores import redundancy_decision

    near = V.nearest(e, 1, group="label").select(c("key").alias("vec_id"), "other", "score")
    d = redundancy_decision(c("score"), c("vec_id"), c("other"), F.abs(c("vec_id") - c("other")) == 1, 0.3, 0.5)
    return e.select("vec_id").join(near, "vec_id", "left").select("vec_id", r6(F.coalesce("score", F.lit(-1.0))).alias("redundancy_score"), F.coalesce(d["is_redundant"], F.lit(False)).alias("is_redundant"))


@query("V02_keyword_search", "documents", sql=f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS n FROM t), a AS (SELECT count(*) AS n, avg(n) AS m FROM l),
x AS (SELECT doc_id, unnest(w) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN ('the', 'license', 'version', 'der') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / a.m))), 6) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY doc_id""")
def _(d):
    return RT.keyword_search(d, "the license version der").select("doc_id", r6("score").alias("score"))


@query("V03_hybrid_search", "documents", "embeddings", sql=f"""
WITH v AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_QSQL}::DOUBLE[]), 9) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50),
t AS (SELECT doc_id, {_WORDS} AS w FROM documents), l AS (SELECT doc_id, len(w) AS n FROM t), a AS (SELECT count(*) AS n, avg(n) AS m FROM l), x AS (SELECT doc_id, unnest(w) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN ('license', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
k AS (SELECT doc_id, round(sum(ln(1 + (a.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / a.m))), 9) AS score FROM tf JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY doc_id)
SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, round(0.5 * coalesce(v.score / (SELECT max(score) FROM v), 0) + 0.5 * coalesce(k.score / (SELECT max(score) FROM k), 0), 6) AS score FROM v FULL JOIN k ON v.doc_id = k.doc_id""")
def _(d, e):
    hits = V.vector_search(e, _QUERY, 50).select(c("vec_id").alias("doc_id"), "score")
    return RT.hybrid(hits, RT.keyword_search(d, "license version"), "doc_id").select("doc_id", r6("score").alias("score"))


@query("V04_rerank", "chunks", sql="""
SELECT chunk_id, round(0.6 * redundancy_score + 0.25 * CASE WHEN engagement_norm = 0 THEN 0.5 ELSE engagement_norm END + 0.15 / (1 + CASE WHEN age_days = 0 THEN 180 ELSE age_days END / 180), 6) AS final FROM chunks""")
def _(k):
    hits = k.select("chunk_id", c("redundancy_score").alias("score"), c("engagement_norm").alias("trust_score"), "age_days")
    return RT.rerank(hits, "chunk_id").select("chunk_id", r6("final").alias("final"))


@query("V05_diversify", "chunks")
def _(k):
    hits = k.select(c("video_id").alias("query"), "chunk_id", c("redundancy_score").alias("score"), F.array("channel_id", c("extraction")).alias("tags"))
    return RT.diversify(hits, "chunk_id")


@query("V07_bundles", "chunks", sql="""
WITH r AS (SELECT video_id, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS i, count(*) OVER (PARTITION BY video_id) AS n, max(redundancy_score) OVER (PARTITION BY video_id) AS best FROM chunks)
SELECT video_id, round(any_value(best), 6) AS best, any_value(n) AS hits, max(chunk_id) FILTER (i = 1) AS first, max(chunk_id) FILTER (i = n // 2 + 1) AS middle, max(chunk_id) FILTER (i = n) AS last FROM r GROUP BY video_id""")
def _(k):
    return RT.bundles(k.withColumnRenamed("redundancy_score", "score")).withColumn("best", r6("best"))


@query("V09_entity_search", "entities", sql="SELECT entity_id FROM entities WHERE (regexp_matches(name, '(?i)ring|steel') OR regexp_matches(description, '(?i)ring|steel')) AND confidence >= 0.4 AND type IN ('PERSON', 'CONCEPT') AND trust_score >= 0.3 ORDER BY trust_score DESC, centrality_score DESC, confidence DESC, entity_id LIMIT 20")
def _(e):
    return RT.entity_search(e, "ring|steel", ["PERSON", "CONCEPT"], 0.4, 0.3).select("entity_id")


@query("V10_graph_search", "entities", "relations", "mentions", sql="""
WITH s AS (SELECT entity_id FROM entities WHERE regexp_matches(name, '(?i)small ring') OR regexp_matches(description, '(?i)small ring') ORDER BY trust_score DESC NULLS LAST, centrality_score DESC, confidence DESC, entity_id LIMIT 5),
e AS (SELECT subject_id AS a, object_id AS b, confidence FROM relations UNION ALL SELECT object_id, subject_id, confidence FROM relations), n AS (SELECT b AS entity_id FROM e WHERE a IN (SELECT entity_id FROM s) AND b NOT IN (SELECT entity_id FROM s) GROUP BY b ORDER BY round(sum(confidence), 9) DESC, b LIMIT 5),
w AS (SELECT * FROM s UNION ALL SELECT * FROM n), k AS (SELECT chunk_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM w) GROUP BY chunk_id ORDER BY count(DISTINCT entity_id) DESC, chunk_id LIMIT 10)
SELECT 'seed' AS kind, entity_id AS id FROM s UNION ALL SELECT 'related', entity_id FROM n UNION ALL SELECT 'chunk', chunk_id FROM k""")
def _(e, r, m):
    return RT.graph_search(e, r, m, "small ring")


@query("V16_hashing_embedding", "documents")
def _(d):
    return V.hashing_embedding(d.select("doc_id", "text")).select("doc_id", "embedding")


@query("T01_token_windows", "documents", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), n AS (SELECT *, len(w) AS n FROM w WHERE len(w) > 0), p AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((n - 200) / 160))::BIGINT + 1)) AS piece FROM n)
SELECT doc_id, piece::INT AS piece, (piece * 160)::INT AS start, len(w[piece * 160 + 1 : piece * 160 + 200])::INT AS tokens, sha256(list_aggregate(w[piece * 160 + 1 : piece * 160 + 200], 'string_agg', ' ')) AS h FROM p""")
def _(d):
    return C.token_windows(d).select("doc_id", "piece", "start", "tokens", F.sha2("text", 256).alias("h"))


@query("T02_recursive_split", "documents")
def _(d):
    return C.recursive_split(d)


@query("T05_segment_join", "conversations", sql="SELECT conv_id, sha256(string_agg(trim(text), ' ' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _(v):
    return C.segment_join(v, "conv_id", "turn").select("conv_id", F.sha2("text", 256).alias("h"))


@query("X34_unit_packing", "documents", sql=r"""
SELECT doc_id, count(*) AS units, sum(length(u))::BIGINT AS letters FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n|\n'), lambda x: trim(x)), lambda x: x <> '')) AS u FROM documents) GROUP BY doc_id""")
def _(d):
    units = C.paragraphs(c("text"))
    packed = d.select("doc_id", units.alias("u"), C.packed_units(units, 800).alias("p")).where(F.size("u") > 0)
    # packing keeps every unit: letters are those of the packed texts without the breaks between units
    return packed.select("doc_id", F.size("u").cast("long").alias("units"), (F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + F.length(x)) - (F.size("u") - F.size("p"))).alias("letters"))
