"""Queries: scans, filters, joins, rollups, windows, pages and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import text as T
from ..operators import relational as R
from ..registry import query

c = F.col
r6 = lambda x: F.round(x, 6)
n = lambda: F.count("*")


# Scans
@query("S02_clean_scan", "videos", sql="SELECT video_id, title, length(transcript) AS n FROM videos WHERE channel_id IN ('en', 'de') AND transcript IS NOT NULL")
def _(v):
    return v.where(c("channel_id").isin("en", "de") & c("transcript").isNotNull()).select("video_id", "title", F.length("transcript").cast("long").alias("n"))


@query("S03_chunk_scan", "videos", sql="SELECT video_id FROM videos WHERE transcript IS NOT NULL OR text IS NOT NULL")
def _(v):
    return v.where(c("transcript").isNotNull() | c("text").isNotNull()).select("video_id")


@query("S04_enrich_scan", "chunks", sql="SELECT chunk_id FROM chunks WHERE extraction IS NULL OR extraction = ''")
def _(k):
    return k.where(FL.missing(c("extraction"))).select("chunk_id")


@query("S05_embed_scan", "documents", "embeddings", sql="SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def _(d, e):
    return d.join(e.select(c("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("S08_redundancy_groups", "chunks", sql="SELECT video_id, count(*) AS n, min(chunk_id) AS first FROM chunks GROUP BY video_id")
def _(k):
    return k.groupBy("video_id").agg(n().alias("n"), F.min("chunk_id").alias("first"))


@query("S10_extraction_scan", "chunks", sql="SELECT chunk_id FROM chunks WHERE text <> '' AND (extraction IS NULL OR extraction NOT IN ('completed', 'skipped'))")
def _(k):
    return k.where((c("text") != "") & ~F.coalesce(c("extraction"), F.lit("")).isin("completed", "skipped")).select("chunk_id")


@query("S11_next_stage_scans", "chunks", sql="""
SELECT 'resolution' AS stage, chunk_id FROM chunks WHERE extraction = 'completed' AND (resolution IS NULL OR resolution <> 'completed')
UNION ALL SELECT 'construction', chunk_id FROM chunks WHERE resolution = 'completed' AND (construction IS NULL OR construction <> 'completed')""")
def _(k):
    from ..operators.stages import pending

    return pending(k, "extraction", "resolution").select(F.lit("resolution").alias("stage"), "chunk_id").unionAll(pending(k, "resolution", "construction").select(F.lit("construction").alias("stage"), "chunk_id"))


@query("S14_skip_existing", "orders", "customer", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(o, u):
    return u.join(o.select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("S19_diverse_sample", "videos", sql="SELECT channel_id, playlist_id, min(video_id) AS video_id FROM videos GROUP BY channel_id, playlist_id")
def _(v):
    return R.first_per(v, ["channel_id", "playlist_id"], [c("video_id").asc()]).select("channel_id", "playlist_id", "video_id")


@query("S23_schema_profile", "customer", sql="""
SELECT 'c_custkey' AS field, 'bigint' AS type, count(*) - count(c_custkey) AS nulls, NULL::BIGINT AS longest FROM customer UNION ALL
SELECT 'c_name', 'string', count(*) - count(c_name), max(length(c_name)) FROM customer UNION ALL SELECT 'c_nationkey', 'int', count(*) - count(c_nationkey), NULL FROM customer UNION ALL
SELECT 'c_acctbal', 'double', count(*) - count(c_acctbal), NULL FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(*) - count(c_mktsegment), max(length(c_mktsegment)) FROM customer""")
def _(u):
    return R.schema_profile(u)


@query("S24_page", "orders", sql="SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(o):
    return R.page(o.select("o_orderkey", "o_orderdate"), [c("o_orderdate").desc(), c("o_orderkey").asc()], 100, 50)


@query("S25_point_lookup", "customer", sql="SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'")
def _(u):
    return u.where(c("c_name") == "Customer#000000007").select("c_custkey", "c_name", "c_acctbal")


@query("S26_bounded_read", "chunks", sql="SELECT chunk_id, n_chars FROM chunks WHERE video_id = 'src1' ORDER BY chunk_id LIMIT 1000")
def _(k):
    return R.page(k.where(c("video_id") == "src1").select("chunk_id", "n_chars"), [c("chunk_id").asc()], 0, 1000)


# Filters
@query("F01_not_equal_keeps_null", "chunks", sql="SELECT chunk_id FROM chunks WHERE resolution IS NULL OR resolution <> 'completed'")
def _(k):
    return k.where(FL.compile_query({"resolution": {"$ne": "completed"}}, k.schema)).select("chunk_id")


@query("F02_in_and_not_in", "chunks", sql="SELECT chunk_id FROM chunks WHERE video_id IN ('src1', 'src2') AND (extraction IS NULL OR extraction NOT IN ('failed', 'skipped'))")
def _(k):
    return k.where(FL.compile_query({"video_id": {"$in": ["src1", "src2"]}, "extraction": {"$nin": ["failed", "skipped"]}}, k.schema)).select("chunk_id")


@query("F03_range", "relations", sql="SELECT subject_id, object_id, predicate FROM relations WHERE confidence >= 0.4 AND confidence < 0.9 AND source_count > 1")
def _(r):
    return r.where(FL.compile_query({"confidence": {"$gte": 0.4, "$lt": 0.9}, "source_count": {"$gt": 1}}, r.schema)).select("subject_id", "object_id", "predicate")


@query("F04_regex_search", "entities", sql="SELECT entity_id FROM entities WHERE regexp_matches(name, '(?i)RING|widget$') OR regexp_matches(description, '(?i)brand#1.$')")
def _(e):
    return e.withColumn("aliases", F.array("description")).where(FL.search("RING|widget$", "name") | FL.search("brand#1.$", arrays=("aliases",))).select("entity_id")


@query("F05_and_or_nor", "entities", sql="""
SELECT entity_id FROM entities WHERE (type = 'PERSON' OR confidence > 0.8) AND NOT (source_count < 5 OR coalesce(trust_score < 0.2, false))""")
def _(e):
    return e.where(FL.compile_query({"$and": [{"$or": [{"type": "PERSON"}, {"confidence": {"$gt": 0.8}}]}, {"$nor": [{"source_count": {"$lt": 5}}, {"trust_score": {"$lt": 0.2}}]}]}, e.schema)).select("entity_id")


@query("F06_exists", "entities", sql="SELECT entity_id FROM entities WHERE trust_score IS NULL")
def _(e):
    return e.where(FL.compile_query({"trust_score": {"$exists": False}}, e.schema)).select("entity_id")


@query("F07_type_guard", "entities", sql="SELECT entity_id FROM entities WHERE trust_score IS NOT NULL AND name IS NOT NULL")
def _(e):
    return e.where(FL.compile_query({"trust_score": {"$type": "number"}, "name": {"$type": "string"}}, e.schema)).select("entity_id")


@query("F08_all_elements", "entities", sql="SELECT entity_id FROM entities WHERE list_contains(string_split(name, ' '), 'red') AND list_contains(string_split(name, ' '), 'widget')")
def _(e):
    e = e.withColumn("words", F.split("name", " "))
    return e.where(FL.compile_query({"words": {"$all": ["red", "widget"]}}, e.schema)).select("entity_id")


_VIDEOS = "SELECT *, CAST(published_year AS VARCHAR) || '-' || lpad(CAST(published_month AS VARCHAR), 2, '0') AS published_at, regexp_extract_all(lower(title || ' ' || channel_id), '[a-z0-9]+') AS keywords, least(1.0, (2 * like_count + 3 * comment_count) / greatest(100, view_count)) AS engagement_score FROM videos"


def _with_fields(v):
    from ..functions.scores import engagement_score

    at = F.concat(c("published_year").cast("string"), F.lit("-"), F.lpad(c("published_month").cast("string"), 2, "0"))
    return v.withColumns({"published_at": at, "keywords": F.regexp_extract_all(F.lower(F.concat("title", F.lit(" "), "channel_id")), F.lit("([a-z0-9]+)"), 1), "engagement_score": engagement_score(c("view_count"), c("like_count"), c("comment_count"))})


@query("F09_saved_filter", "videos", sql=f"""
SELECT video_id FROM ({_VIDEOS}) WHERE channel_id IN ('en', 'fr') AND published_at >= '2023-03' AND published_at <= '2024-10' AND view_count >= 500 AND duration_seconds <= 3000
  AND (list_contains(keywords, 'fr') OR list_contains(keywords, '17') OR transcript IS NULL OR transcript = '')""")
def _(v):
    spec = {"channels": ["en", "fr"], "date_range": {"start": "2023-03", "end": "2024-10"}, "engagement": {"min_views": 500}, "duration": {"max_seconds": 3000}, "keywords_any": ["fr", "17"], "has_transcript": False}
    assert not FL.validate_filter(spec)
    return _with_fields(v).where(FL.saved_filter(spec)).select("video_id")


@query("L06_resolve_filter", "videos", sql=f"""
SELECT video_id, view_count FROM ({_VIDEOS}) WHERE playlist_id IN ('src0', 'src3', 'src4') AND like_count >= 10 ORDER BY view_count DESC, video_id LIMIT 10000""")
def _(v):
    return FL.resolve_filter(_with_fields(v), {"playlists": ["src0", "src3", "src4"], "engagement": {"min_likes": 10}, "sort_by": "view_count"}).select("video_id", "view_count")


@query("F12_retrieval_filter", "chunks", sql="SELECT chunk_id FROM chunks WHERE channel_id = 'de' AND age_days <= 400 AND (is_redundant IS NULL OR NOT is_redundant)")
def _(k):
    return k.where(FL.retrieval_filter(channel="de", max_age=400, exclude_redundant=True)).select("chunk_id")


@query("F13_chat_filter", "chunks", sql="SELECT chunk_id FROM chunks WHERE channel_id IN ('de', 'es') AND video_id = 'src2'")
def _(k):
    return k.where(FL.chat_filter({"channel": ["de", "es"], "video": "src2", "unknown": 1, "trust": None}, k.schema)).select("chunk_id")


@query("F14_expand_filter_values", "part", sql=r"""
SELECT DISTINCT w AS wanted, p_name AS value FROM part, (SELECT unnest(['red', 'wid', 'steel', 'sma', 'small']) AS w) WHERE regexp_matches(p_name, '(?i)\b' || w || CASE WHEN length(w) <= 3 THEN '\b' ELSE '' END)""")
def _(p):
    return FL.expand_values(p, ["red", "wid", "steel", "sma", "small"], "p_name")


@query("F15_query_collection", "entities", sql="SELECT entity_id, name, source_count FROM entities WHERE type = 'PERSON' AND source_count >= 10 ORDER BY source_count DESC, entity_id LIMIT 20 OFFSET 20")
def _(e):
    return FL.query_collection(e, {"type": "PERSON", "source_count": {"$gte": 10}}, ["entity_id", "name", "source_count"], [("source_count", -1), ("entity_id", 1)], 20, 20)[0]


@query("F16_structured_search", "chunks", sql="SELECT chunk_id, age_days, n_chars FROM chunks WHERE is_redundant = false AND age_days < 300 ORDER BY age_days, n_chars DESC, chunk_id LIMIT 25")
def _(k):
    return R.page(k.where(FL.compile_query({"is_redundant": False, "age_days": {"$lt": 300}}, k.schema)).select("chunk_id", "age_days", "n_chars"), [c("age_days").asc(), c("n_chars").desc(), c("chunk_id").asc()], 0, 25)


@query("F17_extraction_filter", "relations", "entities", sql="""
SELECT subject_id, object_id, predicate FROM relations WHERE confidence >= 0.3 AND subject_id IN (SELECT entity_id FROM entities WHERE confidence >= 0.5) AND object_id IN (SELECT entity_id FROM entities WHERE confidence >= 0.5)""")
def _(r, e):
    kept = e.where("confidence >= 0.5").select("entity_id")
    return r.where("confidence >= 0.3").join(kept, c("subject_id") == c("entity_id"), "left_semi").join(kept, c("object_id") == c("entity_id"), "left_semi").select("subject_id", "object_id", "predicate")


@query("F19_flatten", "events", sql="SELECT event_id, event_type AS body_kind, value AS body_at_value, user_id AS body_at_user FROM events")
def _(e):
    nested = e.select("event_id", F.struct(c("event_type").alias("kind"), F.struct("value", c("user_id").alias("user")).alias("at")).alias("body"))
    return R.flatten(nested)


@query("F20_filter_after_paging", "relations", "entities", sql="""
WITH p AS (SELECT * FROM relations ORDER BY confidence DESC, subject_id, object_id, predicate LIMIT 50)
SELECT subject_id, object_id, predicate, p.confidence FROM p JOIN entities ON object_id = entity_id WHERE type = 'PERSON'""")
def _(r, e):
    top = R.page(r, [c("confidence").desc(), c("subject_id"), c("object_id"), c("predicate")])
    return top.join(e.where("type = 'PERSON'").select(c("entity_id").alias("object_id")), "object_id", "left_semi").select("subject_id", "object_id", "predicate", c("confidence"))


# Joins
@query("J01_timeline_lookup", "mentions", "entities", sql="""
SELECT video_id, type, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM mentions JOIN entities USING (entity_id) GROUP BY video_id, type""")
def _(m, e):
    return m.join(e.select("entity_id", "type"), "entity_id").groupBy("video_id", "type").agg(n().alias("mentions"), F.count_distinct("chunk_id").alias("chunks"))


@query("J02_relation_names", "relations", "entities", sql="""
SELECT r.subject_id, r.object_id, r.predicate, coalesce(a.name, '') AS subject_name, coalesce(b.name, '') AS object_name FROM relations r LEFT JOIN entities a ON a.entity_id = r.subject_id LEFT JOIN entities b ON b.entity_id = r.object_id""")
def _(r, e):
    names = lambda end: e.select(c("entity_id").alias(f"{end}_id"), c("name").alias(f"{end}_name"))
    return r.select("subject_id", "object_id", "predicate").join(names("subject"), "subject_id", "left").join(names("object"), "object_id", "left").fillna("", ["subject_name", "object_name"])


@query("J03_induced_relations", "relations", "mentions", sql="""
WITH m AS (SELECT DISTINCT entity_id FROM mentions WHERE video_id = 'c7')
SELECT subject_id, object_id, predicate FROM relations WHERE object_id IN (SELECT entity_id FROM m)""")
def _(r, m):
    members = m.where("video_id = 'c7'").select(c("entity_id").alias("object_id")).distinct()
    return r.join(members, "object_id", "left_semi").select("subject_id", "object_id", "predicate")


@query("J04_name_lookup", "entities", sql="""
WITH k AS (SELECT lower(trim(canonical_name)) AS key, entity_id, 0 AS r FROM entities UNION ALL SELECT lower(trim(name)), entity_id, 1 FROM entities)
SELECT key, arg_min(entity_id, (r, entity_id)) AS entity_id FROM k GROUP BY key""")
def _(e):
    from ..operators.resolution import name_lookup

    return name_lookup(e)


@query("J05_resolved_endpoints", "relation_rows", "entities", sql="""
SELECT a.name AS subject, b.name AS object, count(*) AS n FROM relation_rows r JOIN entities a ON a.entity_id = r.subject_id JOIN entities b ON b.entity_id = r.object_id GROUP BY a.name, b.name""")
def _(r, e):
    # counts by ids first, so names are joined to one row a pair
    pairs = r.groupBy("subject_id", "object_id").agg(n().alias("k"))
    a, b = e.select(c("entity_id").alias("subject_id"), c("name").alias("subject")), e.select(c("entity_id").alias("object_id"), c("name").alias("object"))
    return pairs.join(a, "subject_id").join(b, "object_id").groupBy("subject", "object").agg(F.sum("k").alias("n"))


@query("J06_existing_endpoints", "relations", "entities", sql="SELECT count(*) AS n FROM relations WHERE subject_id IN (SELECT entity_id FROM entities) AND object_id IN (SELECT entity_id FROM entities)")
def _(r, e):
    ids = e.select("entity_id")
    return r.join(ids, c("subject_id") == c("entity_id"), "left_semi").join(ids, c("object_id") == c("entity_id"), "left_semi").agg(n().alias("n"))


@query("J16_trust_propagation", "mentions", "orders", sql="""
SELECT entity_id, round(avg(o_totalprice), 4) AS trust, count(*) AS chunks FROM (SELECT DISTINCT entity_id, chunk_number FROM mentions) JOIN orders ON o_orderkey = chunk_number GROUP BY entity_id""")
def _(m, o):
    said = m.select("entity_id", "chunk_number").distinct()
    return said.join(o.select(c("o_orderkey").alias("chunk_number"), "o_totalprice"), "chunk_number").groupBy("entity_id").agg(F.round(F.avg("o_totalprice"), 4).alias("trust"), n().alias("chunks"))


@query("J17_chunk_metadata", "chunks", "videos", sql="SELECT k.chunk_id, v.title, v.view_count FROM chunks k LEFT JOIN videos v ON v.video_id = k.chunk_id")
def _(k, v):
    return k.select("chunk_id").join(v.select(c("video_id").alias("chunk_id"), "title", "view_count"), "chunk_id", "left")


@query("J18_entity_neighbours", "relations", sql="""
SELECT object_id AS neighbour, predicate, 'out' AS direction FROM relations WHERE subject_id = 's3' UNION ALL SELECT subject_id, predicate, 'in' FROM relations WHERE object_id = 's3'""")
def _(r):
    from ..operators.graph import neighbours

    return neighbours(r, ["s3"]).select("neighbour", "predicate", "direction")


@query("J19_one_hop", "relations", sql="SELECT DISTINCT CASE WHEN subject_id IN ('s1', 'p5') THEN object_id ELSE subject_id END AS entity_id FROM relations WHERE (subject_id IN ('s1', 'p5')) <> (object_id IN ('s1', 'p5'))")
def _(r):
    from ..operators.graph import hop

    return hop(r, ["s1", "p5"])


@query("J21_entity_video_mapping", "mentions", sql="SELECT video_id, count(DISTINCT entity_id) AS entities, sum(DISTINCT substr(entity_id, 2)::BIGINT)::BIGINT AS ids FROM mentions GROUP BY video_id")
def _(m):
    pairs = m.select("video_id", "entity_id").distinct()
    return pairs.groupBy("video_id").agg(n().alias("entities"), F.sum(F.substring("entity_id", 2, 20).cast("long")).alias("ids"))


@query("J22_parent_and_children", "nation", "customer", "supplier", sql="""
SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, coalesce((SELECT list(s_suppkey ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), []) AS suppliers FROM nation""")
def _(t, u, s):
    customers = u.groupBy(c("c_nationkey").alias("n_nationkey")).agg(n().alias("customers"))
    suppliers = s.groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("suppliers"))
    return t.join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.array().cast("array<bigint>")).alias("suppliers"))


@query("J20_communities_of_entities", "mentions", sql="SELECT DISTINCT video_id AS community FROM mentions WHERE entity_id IN ('p1', 'p2', 'p3')")
def _(m):
    wanted = m.sparkSession.createDataFrame([("p1",), ("p2",), ("p3",)], "entity_id string")
    return m.join(F.broadcast(wanted), "entity_id", "left_semi").select(c("video_id").alias("community")).distinct()


@query("J23_community_context", "relations", "mentions", "entities", sql="""
WITH m AS (SELECT DISTINCT entity_id FROM mentions WHERE video_id = 'c7')
SELECT e.type, count(*) AS members, round(avg(e.confidence), 6) AS confidence FROM m JOIN entities e USING (entity_id) GROUP BY e.type""")
def _(r, m, e):
    members = m.where("video_id = 'c7'").select("entity_id").distinct()
    return e.join(members, "entity_id", "left_semi").groupBy("type").agg(n().alias("members"), r6(F.avg("confidence")).alias("confidence"))


# Rollups
@query("A01_entity_types", "entities", sql="SELECT type, count(*) AS count FROM entities GROUP BY type")
def _(e):
    return R.distribution(e, "type")


@query("A02_top_predicates", "relation_rows", sql="SELECT predicate, count(*) AS count FROM relation_rows GROUP BY predicate ORDER BY count DESC, predicate LIMIT 20")
def _(r):
    return R.distribution(r, "predicate", 20)


@query("A05_degree_by_type", "relations", "entities", sql="""
SELECT e.type, d.entity_id, d.degree FROM (SELECT id AS entity_id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id) d JOIN entities e USING (entity_id) WHERE e.type = 'CONCEPT'""")
def _(r, e):
    return R.degrees(r).join(e.where("type = 'CONCEPT'").select("entity_id", "type"), "entity_id").select("type", "entity_id", "degree")


@query("A07_level_rollup", "orders", sql="SELECT o_orderpriority AS level, count(*) AS count, round(avg(o_totalprice), 2) AS avg_size, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_orderpriority")
def _(o):
    return o.groupBy(c("o_orderpriority").alias("level")).agg(n().alias("count"), F.round(F.avg("o_totalprice"), 2).alias("avg_size"), F.count_if(c("o_orderstatus") == "F").alias("done"))


@query("A09_channel_rollup", "videos", sql="""
SELECT channel_id, arg_min(title, video_id) AS first_title, count(*) AS videos, sum(view_count)::BIGINT AS views, sum(like_count)::BIGINT AS likes, round(avg(like_count / greatest(1, view_count)), 4) AS engagement,
       round(avg(duration_seconds) / 60, 1) AS minutes, min(published_year) AS first_year, max(published_year) AS last_year, round(100.0 * count(transcript) / count(*), 6) AS coverage FROM videos GROUP BY channel_id""")
def _(v):
    return v.groupBy("channel_id").agg(F.min_by("title", "video_id").alias("first_title"), n().alias("videos"), F.sum("view_count").alias("views"), F.sum("like_count").alias("likes"), F.round(F.avg(c("like_count") / F.greatest(F.lit(1), "view_count")), 4).alias("engagement"), F.round(F.avg("duration_seconds") / 60, 1).alias("minutes"), F.min("published_year").alias("first_year"), F.max("published_year").alias("last_year"), r6(100.0 * F.count("transcript") / n()).alias("coverage"))


@query("A10_playlist_rollup", "videos", sql="SELECT playlist_id, channel_id, count(*) AS videos, sum(view_count)::BIGINT AS views, max(duration_seconds) AS longest FROM videos GROUP BY playlist_id, channel_id")
def _(v):
    return v.groupBy("playlist_id", "channel_id").agg(n().alias("videos"), F.sum("view_count").alias("views"), F.max("duration_seconds").alias("longest"))


@query("A11_filter_preview", "videos", sql="SELECT channel_id, count(*) AS videos, sum(view_count)::BIGINT AS views, count(transcript) AS with_transcript FROM videos WHERE view_count >= 800 GROUP BY ROLLUP (channel_id)")
def _(v):
    return v.where("view_count >= 800").rollup("channel_id").agg(n().alias("videos"), F.sum("view_count").alias("views"), F.count("transcript").alias("with_transcript"))


@query("A12_extraction_summary", "relation_rows", sql="""
SELECT count(*) AS chunks, sum(k)::BIGINT AS relations, round(avg(k), 6) AS per_chunk, max(k) AS most FROM (SELECT chunk_id, count(*) AS k FROM relation_rows GROUP BY chunk_id)""")
def _(r):
    return r.groupBy("chunk_id").agg(n().alias("k")).agg(n().alias("chunks"), F.sum("k").alias("relations"), r6(F.avg("k")).alias("per_chunk"), F.max("k").alias("most"))


@query("A16_feedback_rollup", "chunks", sql="""
WITH t AS (SELECT video_id, channel_id AS tag, count(*) AS k FROM chunks GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k DESC, tag) AS r FROM t)
SELECT video_id, tag, k FROM s WHERE r <= 10""")
def _(k):
    tags = k.groupBy("video_id", c("channel_id").alias("tag")).agg(n().alias("k"))
    return R.top_per(tags, ["video_id"], [c("k").desc(), c("tag").asc()], 10).select("video_id", "tag", "k")


@query("A17_session_tags", "events", sql="SELECT replace(lower(event_type || '_' || user_id), '_', '-') AS tag, count(*) AS k FROM events GROUP BY tag ORDER BY k DESC, tag LIMIT 200")
def _(e):
    return e.groupBy(F.translate(F.lower(F.concat("event_type", F.lit("_"), "user_id")), "_", "-").alias("tag")).agg(n().alias("k")).orderBy(F.desc("k"), "tag").limit(200)


@query("A18_corpus_insights", "documents", sql=r"""
SELECT w AS term, count(*) AS k FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE len(w) >= 3 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','were','with') GROUP BY w ORDER BY k DESC, w LIMIT 50""")
def _(d):
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("term"))
    return words.where((F.length("term") >= 3) & ~c("term").isin(*T.STOP_WORDS)).groupBy("term").agg(n().alias("k")).orderBy(F.desc("k"), "term").limit(50)


@query("A19_distinct_values", "videos", sql="SELECT 'channel' AS field, channel_id AS value FROM videos GROUP BY channel_id UNION ALL SELECT 'playlist', playlist_id FROM videos GROUP BY playlist_id")
def _(v):
    pairs = F.explode(F.array(F.struct(F.lit("channel").alias("field"), c("channel_id").alias("value")), F.struct(F.lit("playlist").alias("field"), c("playlist_id").alias("value"))))
    return v.select(pairs.alias("x")).select("x.*").distinct()


@query("A45_counts", "documents", "events", sql="SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'")
def _(d, e):
    return d.agg(n().alias("n")).select(F.lit("documents").alias("name"), "n").unionAll(e.where("event_type = 'error'").agg(n().alias("n")).select(F.lit("errors").alias("name"), "n"))


@query("A49_deduplicate", "relation_rows", sql="SELECT subject_id, object_id, min(chunk_id) AS chunk_id FROM relation_rows GROUP BY subject_id, object_id")
def _(r):
    return r.groupBy("subject_id", "object_id").agg(F.min("chunk_id").alias("chunk_id"))


@query("A50_graph_signature", "relations", sql="""
SELECT sum(hash_part)::HUGEINT::VARCHAR AS signature, count(*) AS edges FROM (SELECT ('0x' || substr(sha1(subject_id || '|' || object_id || '|' || predicate || '|' || printf('%.2f', confidence)), 1, 12))::BIGINT AS hash_part FROM relations)""")
def _(r):
    from ..operators.graph import graph_signature

    return graph_signature(r)


# Windows
@query("W01_chunk_numbers", "mentions", sql="SELECT DISTINCT video_id, chunk_id, dense_rank() OVER (PARTITION BY video_id ORDER BY said_at, chunk_number) AS i FROM mentions")
def _(m):
    chunks = m.select("video_id", "chunk_id", "said_at", "chunk_number").distinct()
    return chunks.withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy("said_at", "chunk_number"))).select("video_id", "chunk_id", c("i").cast("long").alias("i"))


@query("W02_first_and_last_mention", "mentions", sql="SELECT entity_id, min(said_at) AS first, max(said_at) AS last, count(*) AS k, arg_min(chunk_id, (said_at, chunk_id)) AS first_chunk FROM mentions GROUP BY entity_id")
def _(m):
    return m.groupBy("entity_id").agg(F.min("said_at").alias("first"), F.max("said_at").alias("last"), n().alias("k"), F.min_by("chunk_id", F.struct("said_at", "chunk_id")).alias("first_chunk"))


@query("W03_first_contexts", "mentions", sql="SELECT entity_id, chunk_id, r FROM (SELECT entity_id, chunk_id, row_number() OVER (PARTITION BY entity_id ORDER BY said_at, chunk_id, position) AS r FROM mentions) WHERE r <= 3")
def _(m):
    return R.top_per(m, ["entity_id"], [c("said_at"), c("chunk_id"), c("position")], 3, "r").select("entity_id", "chunk_id", c("r").cast("long").alias("r"))


@query("W04_version_timeline", "events", sql="SELECT event_id, row_number() OVER w AS version, round(value - lag(value) OVER w, 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(e):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.row_number().over(w).cast("long").alias("version"), r6(c("value") - F.lag("value").over(w)).alias("change"))


@query("W05_positions_by_share_of_text", "chunks", sql="SELECT chunk_id, round((sum(n_chars) OVER w - n_chars) / sum(n_chars) OVER (PARTITION BY video_id) * 3600, 3) AS start_seconds FROM chunks WINDOW w AS (PARTITION BY video_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)")
def _(k):
    # a running total in one sorted group for each video; the group's total comes from an aggregate
    total = k.groupBy("video_id").agg(F.sum("n_chars").alias("total"))
    run = Window.partitionBy("video_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return k.select("video_id", "chunk_id", "n_chars", F.sum("n_chars").over(run).alias("run")).join(total, "video_id").select("chunk_id", F.round((c("run") - c("n_chars")) / c("total") * 3600, 3).alias("start_seconds"))


@query("W07_max_normalised_degree", "relations", sql="""
WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id)
SELECT id AS entity_id, degree, round(degree / (SELECT max(degree) FROM d), 6) AS centrality FROM d""")
def _(r):
    from ..operators.graph import degree_centrality

    return degree_centrality(r).select("entity_id", "degree", r6("centrality").alias("centrality"))


@query("W09_latest_per_name", "samples", sql="SELECT name, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM samples GROUP BY name")
def _(s):
    return s.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


@query("W11_representative_chunks", "chunks", sql="""
WITH r AS (SELECT video_id, chunk_id, row_number() OVER (PARTITION BY video_id ORDER BY chunk_id) AS i, count(*) OVER (PARTITION BY video_id) AS k FROM chunks)
SELECT video_id, chunk_id FROM r WHERE i = 1 OR i = k // 2 + 1 OR i = k""")
def _(k):
    count = k.groupBy("video_id").agg(n().alias("k"))
    i = F.row_number().over(Window.partitionBy("video_id").orderBy("chunk_id"))
    return k.select("video_id", "chunk_id", i.alias("i")).join(count, "video_id").where("i = 1 or i = floor(k / 2) + 1 or i = k").select("video_id", "chunk_id")


# Pages and top-k
@query("L01_entity_search", "entities", sql="SELECT entity_id, source_count, (SELECT count(*) FROM entities WHERE type = 'TECHNOLOGY') AS total, (SELECT count(*) FROM entities WHERE type = 'TECHNOLOGY') > 30 AS has_more FROM entities WHERE type = 'TECHNOLOGY' ORDER BY source_count DESC, entity_id LIMIT 20 OFFSET 10")
def _(e):
    return R.page_with_total(e.where("type = 'TECHNOLOGY'").select("entity_id", "source_count"), [c("source_count").desc(), c("entity_id").asc()], 10, 20)


@query("L03_relationship_page", "relations", sql="SELECT subject_id, object_id, predicate, confidence FROM relations WHERE predicate = 'uses' AND confidence >= 0.5 ORDER BY confidence DESC, subject_id, object_id LIMIT 50")
def _(r):
    return R.page(r.where("predicate = 'uses' and confidence >= 0.5").select("subject_id", "object_id", "predicate", "confidence"), [c("confidence").desc(), c("subject_id"), c("object_id")])


@query("L04_retrieval_sort", "entities", sql="SELECT entity_id, trust_score FROM entities ORDER BY trust_score DESC NULLS LAST, centrality_score DESC, confidence DESC, entity_id LIMIT 20")
def _(e):
    return R.page(e, [c("trust_score").desc_nulls_last(), c("centrality_score").desc(), c("confidence").desc(), c("entity_id").asc()], 0, 20).select("entity_id", "trust_score")


@query("L02_community_search", "orders", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def _(o):
    return R.page(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey").asc()], 0, 30)


@query("L05_channel_videos", "videos", sql="SELECT video_id, view_count FROM videos WHERE channel_id = 'fr' ORDER BY view_count DESC, video_id LIMIT 25 OFFSET 25")
def _(v):
    return R.page(v.where("channel_id = 'fr'").select("video_id", "view_count"), [c("view_count").desc(), c("video_id").asc()], 25, 25)


@query("L08_series_tail", "samples", sql="SELECT * FROM (SELECT event_id, name, value FROM samples WHERE name = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY event_id")
def _(s):
    tail = R.page(s.where("name = 'error'"), [c("ts").desc(), c("event_id").desc()], 0, 100)
    return tail.orderBy("ts", "event_id").select("event_id", "name", "value")


@query("L09_recent_memory", "conversations", sql="SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20")
def _(v):
    return R.top_per(v, ["conv_id"], [c("turn").desc()], 20).select("conv_id", "turn", "role")


@query("L10_important_entities", "entities", sql="SELECT entity_id, round(centrality_score * confidence * source_count, 6) AS importance FROM entities ORDER BY round(centrality_score * confidence * source_count, 6) DESC, entity_id LIMIT 20")
def _(e):
    scored = e.select("entity_id", r6(c("centrality_score") * c("confidence") * c("source_count")).alias("importance"))
    return R.page(scored, [c("importance").desc(), c("entity_id").asc()], 0, 20)


@query("L11_important_relations", "relations", sql="SELECT subject_id, object_id, predicate, round(confidence * source_count, 6) AS importance FROM relations ORDER BY round(confidence * source_count, 6) DESC, subject_id, object_id, predicate LIMIT 30")
def _(r):
    scored = r.select("subject_id", "object_id", "predicate", r6(c("confidence") * c("source_count")).alias("importance"))
    return R.page(scored, [c("importance").desc(), c("subject_id"), c("object_id"), c("predicate")], 0, 30)


@query("L12_citations", "mentions", sql="SELECT DISTINCT video_id, chunk_id FROM mentions ORDER BY video_id, chunk_id LIMIT 5")
def _(m):
    return m.select("video_id", "chunk_id").distinct().orderBy("video_id", "chunk_id").limit(5)


# Sets
@query("U01_bag_union", "events", sql="SELECT event_id, 'vector' AS source FROM events WHERE value > 100 UNION ALL SELECT event_id, 'graph' FROM events WHERE event_type = 'purchase'")
def _(e):
    return e.where("value > 100").select("event_id", F.lit("vector").alias("source")).unionAll(e.where("event_type = 'purchase'").select("event_id", F.lit("graph").alias("source")))


@query("U02_array_union", "part", sql="SELECT p_partkey, list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) AS words FROM part")
def _(p):
    return p.select("p_partkey", F.array_sort(F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))).alias("words"))


@query("U04_key_differences", "part", sql="""
SELECT p_partkey, list_sort(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['red', 'ring'], x))) AS added, list_sort(list_filter(['red', 'ring'], lambda x: NOT list_contains(string_split(p_name, ' '), x))) AS removed FROM part""")
def _(p):
    old, new = F.array(F.lit("red"), F.lit("ring")), F.split("p_name", " ")
    return p.select("p_partkey", F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))


@query("U05_exclude_seeds", "entities", "mentions", sql="SELECT entity_id FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM mentions)")
def _(e, m):
    return e.join(m.select("entity_id"), "entity_id", "left_anti").select("entity_id")


@query("U06_degree_union", "relations", sql="SELECT id AS entity_id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id")
def _(r):
    return R.degrees(r)


@query("U07_ordered_dedupe", "documents", sql="SELECT doc_id, len(list_distinct(string_split(lower(text), ' ')))::BIGINT AS k FROM documents")
def _(d):
    return d.select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), " "))).cast("long").alias("k"))


@query("U08_map_merge", "events", sql="SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type AS kind FROM events")
def _(e):
    old = F.from_json("props", "map<string,string>")
    merged = F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, v: ~k.isin("kind"))), F.map_entries(F.create_map(F.lit("kind"), "event_type"))))
    m = e.select("event_id", merged.alias("m"))
    return m.select("event_id", c("m")["k"].cast("long").alias("k"), c("m")["kind"].alias("kind"))
