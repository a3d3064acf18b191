"""Queries: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..registry import query

c = F.col
r6 = lambda x: F.round(x, 6)


@query("X01_normalize_newlines", "documents", sql=r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')) AS h FROM documents""")
def _(d):
    return d.select("doc_id", F.sha2(T.normalize_newlines(c("text")), 256).alias("h"))


@query("X02_strip_stray_backslashes", "documents", sql="SELECT doc_id, sha256(text) AS h FROM documents")
def _(d):
    return d.select("doc_id", F.sha2(F.when(F.contains("text", F.lit("\\")), T.strip_stray_backslashes(c("text"))).otherwise(c("text")), 256).alias("h"))


@query("X03_count_words", "documents", sql=r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS n_words FROM documents")
def _(d):
    return d.select("doc_id", T.count_words(c("text")).alias("n_words"))


@query("X04_sha256_text", "documents", sql="SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS h FROM documents")
def _(d):
    return d.select("doc_id", T.sha256_text(c("text")).alias("h"))


@query("X05_dedup_lower", "documents", sql=r"""
SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(lower(text), ' '), lambda x: trim(x)), lambda x: x <> '')))::BIGINT AS n,
       list_filter(list_transform(string_split(lower(text), ' '), lambda x: trim(x)), lambda x: x <> '')[1] AS first FROM documents""")
def _(d):
    words = T.dedup_lower(F.split("text", " "))
    return d.select("doc_id", F.size(words).cast("long").alias("n"), F.get(words, F.lit(0)).alias("first"))


@query("X06_seconds_to_hhmmss", "videos", sql="""
SELECT video_id, printf('%02d:%02d:%02d', duration_seconds // 3600, duration_seconds % 3600 // 60, duration_seconds % 60) AS position FROM videos""")
def _(v):
    return v.select("video_id", T.seconds_to_hhmmss(c("duration_seconds")).alias("position"))


@query("X07_parse_iso8601_duration", "videos", sql="SELECT video_id, duration_seconds::BIGINT AS seconds FROM videos")
def _(v):
    d = c("duration_seconds")
    return v.select("video_id", T.iso8601_seconds(F.concat(F.lit("PT"), F.floor(d / 3600), F.lit("H"), F.floor(d % 3600 / 60), F.lit("M"), d % 60, F.lit("S"))).cast("long").alias("seconds"))


@query("X08_engagement_score", "videos", sql="SELECT video_id, CASE WHEN view_count > 0 THEN round(least(1.0, (2 * like_count + 3 * comment_count) / greatest(100, view_count)), 6) END AS score FROM videos")
def _(v):
    return v.select("video_id", r6(S.engagement_score(c("view_count"), c("like_count"), c("comment_count"))).alias("score"))


@query("X09_thumbnail_choice", "videos", sql="""
SELECT video_id, coalesce(CASE WHEN view_count % 2 = 0 THEN 'maxres-' || video_id END, CASE WHEN view_count % 3 = 0 THEN 'standard-' || video_id END, CASE WHEN view_count % 5 = 0 THEN 'high-' || video_id END, 'default-' || video_id) AS url FROM videos""")
def _(v):
    named = lambda kind, k: F.when(c("view_count") % k == 0, F.concat(F.lit(f"{kind}-"), c("video_id").cast("string")))
    return v.select("video_id", F.coalesce(named("maxres", 2), named("standard", 3), named("high", 5), named("default", 1)).alias("url"))


@query("X10_trust_score", "chunks", sql="""
SELECT chunk_id, round(least(1.0, greatest(0.0, 0.4 * CASE WHEN is_redundant THEN redundancy_score ELSE 0.5 * redundancy_score END
  + 0.3 / (1 + exp(-greatest(-6.0, least(6.0, (180 - CASE WHEN age_days = 0 THEN 365 ELSE age_days END) / 60)))) + 0.2 * engagement_norm + 0.1 * CASE WHEN code_present THEN 1.0 ELSE 0.6 END)), 6) AS trust FROM chunks""")
def _(k):
    return k.select("chunk_id", r6(S.trust_score(c("redundancy_score"), c("is_redundant"), c("age_days"), c("engagement_norm"), c("code_present"))).alias("trust"))


@query("X11_cosine_to_group_center", "embeddings", sql="""
WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT label, i, avg(v) AS m FROM u GROUP BY label, i)
SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS cosine FROM u JOIN g USING (label, i) GROUP BY vec_id""")
def _(e):
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(c("v").cast("double")).alias("m"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("center"))
    return e.join(centers, "label").select("vec_id", r6(S.cosine(c("embedding"), c("center"))).alias("cosine"))


@query("X12_unit_vectors", "embeddings", sql="""
SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(1.0, 6) AS norm FROM embeddings""")
def _(e):
    u = e.select("vec_id", S.unit(c("embedding")).alias("u"))
    return u.select("vec_id", r6(F.get("u", F.lit(0))).alias("first"), r6(S.norm(c("u"))).alias("norm"))


@query("X14_normalize_entity_name", "entities", sql=r"""
SELECT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(trim(name)), '^mr\. ', ''), '^ms\. ', ''), '^dr\. ', ''), '^prof\. ', ''), '^the ', ''), ' inc\.$', ''), ' inc$', ''), ' corp\.$', ''), ' corp$', ''), ' ltd\.$', ''), ' ltd$', ''), ' llc$', '')) AS name FROM entities""")
def _(e):
    return e.select("entity_id", T.normalize_entity_name(c("name")).alias("name"))


@query("X15_blocking_keys", "entities", sql=r"""
SELECT entity_id, list_contains([lower(trim(name))], lower(trim(name))) AS has_name, regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') AS plain,
  CASE WHEN len(string_split(lower(trim(name)), ' ')) > 1 THEN list_aggregate(list_transform(string_split(lower(trim(name)), ' '), lambda w: w[1]), 'string_agg', '') END AS initials FROM entities""")
def _(e):
    k = T.blocking_keys(c("name"))
    words = F.split(T.normalize_entity_name(c("name")), " ")
    initials = F.filter(k, lambda x: (F.length(x) == F.size(words)) & (F.size(words) > 1))
    return e.select("entity_id", F.array_contains(k, T.normalize_entity_name(c("name"))).alias("has_name"), F.filter(k, lambda x: x == F.regexp_replace(T.normalize_entity_name(c("name")), "[^a-z0-9]", ""))[0].alias("plain"), F.get(initials, F.lit(0)).alias("initials"))


@query("X17_token_score", "entities", sql="""
WITH t AS (SELECT entity_id, list_distinct(list_filter(string_split(lower(name), ' '), lambda w: len(w) > 1)) AS a, list_distinct(list_filter(string_split(lower(description), ' '), lambda w: len(w) > 1)) AS b FROM entities)
SELECT entity_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM t""")
def _(e):
    return e.select("entity_id", r6(T.token_score(c("name"), c("description"))).alias("score"))


@query("X22_types_compatible", "entities", sql="""
SELECT a.type AS left_type, b.type AS right_type, NOT ((a.type = 'PERSON' AND b.type IN ('ORGANIZATION', 'TECHNOLOGY')) OR (b.type = 'PERSON' AND a.type IN ('ORGANIZATION', 'TECHNOLOGY'))) AS compatible
FROM (SELECT DISTINCT type FROM entities) a, (SELECT DISTINCT type FROM entities) b""")
def _(e):
    from ..operators.resolution import types_compatible

    kinds = e.groupBy("type").count()
    # two lists of the seven types
    return kinds.select(c("type").alias("left_type")).crossJoin(kinds.select(c("type").alias("right_type"))).select("left_type", "right_type", types_compatible(c("left_type"), c("right_type")).alias("compatible"))


@query("X23_normalize_predicate", "events", sql=r"""
SELECT event_id, regexp_replace(regexp_replace(lower(trim(event_type || ' -> Tested')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake FROM events""")
def _(e):
    return e.select("event_id", T.snake_case(F.concat(c("event_type"), F.lit(" -> Tested"))).alias("snake"))


@query("X30_query_intent", "conversations", sql="""
SELECT conv_id, turn, CASE WHEN t LIKE '%compare%' OR t LIKE '%difference%' OR t LIKE '%versus%' OR t LIKE '% vs %' THEN 'comparative' WHEN t LIKE '%how%' OR t LIKE '%why%' OR t LIKE '%explain%' THEN 'explanatory'
  WHEN t LIKE '%list%' OR t LIKE '%which%' OR t LIKE '%all%' THEN 'listing' WHEN t LIKE '%what%' OR t LIKE '%who%' OR t LIKE '%when%' OR t LIKE '%where%' OR t LIKE '%define%' THEN 'factual' ELSE 'general' END AS intent
FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def _(v):
    return v.select("conv_id", "turn", T.query_intent(c("text")).alias("intent"))


@query("X31_keywords", "documents", sql=r"""
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: len(w) >= 3 AND NOT list_contains(['a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','were','with'], w))))::BIGINT AS n FROM documents""")
def _(d):
    return d.select("doc_id", F.size(T.keywords(c("text"))).cast("long").alias("n"))


@query("X32_fuzzy_match_score", "entities", sql="""
WITH t AS (SELECT entity_id, lower(name) AS v, lower(type) AS q FROM entities), l AS (SELECT *, list_distinct(string_split(q, '')) AS a, list_distinct(string_split(v, '')) AS b FROM t),
j AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS s FROM l)
SELECT entity_id, round(CASE WHEN contains(v, q) OR contains(q, v) THEN 1.0 WHEN s > 0.5 THEN s * 0.6 ELSE 0.0 END, 6) AS score FROM j""")
def _(e):
    return e.select("entity_id", r6(T.fuzzy_match_score(c("type"), c("name"))).alias("score"))


@query("X38_remove_cues", "chunks", sql=r"""
SELECT chunk_id, sha256(trim(regexp_replace(regexp_replace('[Music] ' || text || ' (APPLAUSE)', '(?i)[\[(](applause|music|laughter|inaudible|silence|noise|crosstalk)[\])]', '', 'g'), '[ \t]{2,}', ' ', 'g'))) AS h FROM chunks""")
def _(k):
    return k.select("chunk_id", F.sha2(T.remove_cues(F.concat(F.lit("[Music] "), c("text"), F.lit(" (APPLAUSE)"))), 256).alias("h"))


@query("X40_answer_confidence", "videos", sql="""
SELECT video_id, round(0.4 * least(like_count / 5, 1.0) + 0.3 * least(comment_count / 3, 1.0) + 0.3 * least(view_count / 2000, 1.0), 6) AS confidence FROM videos""")
def _(v):
    return v.select("video_id", r6(S.answer_confidence(c("like_count"), c("comment_count"), c("view_count"))).alias("confidence"))


@query("X43_token_estimate", "documents", sql="SELECT doc_id, (length(text) // 4 + 1000)::BIGINT AS tokens FROM documents")
def _(d):
    return d.select("doc_id", S.token_estimate(c("text")).alias("tokens"))


@query("X45_xml_escape", "pages", sql="""
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS h FROM pages""")
def _(p):
    return p.select("page_id", F.sha2(T.xml_escape(c("html")), 256).alias("h"))


@query("X46_compare_and_json_path", "events", sql="""
SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::DOUBLE >= value AS at_least, abs((props->>'$.k')::DOUBLE - value) <= 1e-12 AS same FROM events""")
def _(e):
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.cast("long").alias("k"), S.compare(F.lit(">="), k.cast("double"), c("value")).alias("at_least"), S.compare(F.lit("=="), k.cast("double"), c("value")).alias("same"))


@query("X47_validation_rules", "customer", sql="""
SELECT rule, count(*) AS violations FROM (
  SELECT unnest([CASE WHEN length(c_name) < 3 THEN 'name: min_length 3' END, CASE WHEN length(c_name) > 15 THEN 'name: max_length 15' END, CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]+$') THEN 'name: pattern' END,
                 CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'acctbal: range' END, CASE WHEN trim(c_mktsegment) = '' THEN 'segment: not_empty' END]) AS rule FROM customer) WHERE rule IS NOT NULL GROUP BY rule""")
def _(t):
    from ..functions.rules import length_between, matches, not_empty, violations, within

    rules = {"name: min_length 3": length_between(c("c_name"), 3), "name: max_length 15": length_between(c("c_name"), 0, 15), "name: pattern": matches(c("c_name"), "^Customer#[0-9]+$"), "acctbal: range": within(c("c_acctbal"), 0, 9000), "segment: not_empty": not_empty(c("c_mktsegment"))}
    return violations(t, rules).groupBy("rule").agg(F.count("*").alias("violations"))


@query("X48_age_in_days", "orders", sql="SELECT o_orderkey, greatest(0, date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::BIGINT AS age FROM orders")
def _(o):
    return o.select("o_orderkey", S.age_in_days(c("o_orderdate"), F.lit("2000-01-01").cast("date")).cast("long").alias("age"))


@query("X49_reference_anchor", "videos", sql="""
SELECT video_id, duration_seconds::BIGINT AS seconds, 'v/' || video_id || '&t=' || duration_seconds || 's' AS url, printf('%02d:%02d', duration_seconds // 60, duration_seconds % 60) AS hint FROM videos""")
def _(v):
    a = T.reference_anchor(T.seconds_to_hhmmss(c("duration_seconds")), F.concat(F.lit("v/"), c("video_id").cast("string")))
    return v.select("video_id", a.alias("a")).select("video_id", c("a.seconds").alias("seconds"), "a.url", "a.hint")


@query("KEY_entity_and_relationship_ids", "relations", sql="""
SELECT subject_id, object_id, predicate, md5(lower(subject_id || ':' || object_id || ':' || predicate)) AS relationship_id, md5(lower(trim(subject_id)) || '|' || predicate) AS entity_key, 'idem:' || predicate || ':' || subject_id || ':' || source_count AS idempotency FROM relations""")
def _(r):
    return r.select("subject_id", "object_id", "predicate", S.relationship_id(c("subject_id"), c("object_id"), c("predicate")).alias("relationship_id"), S.entity_id(c("subject_id"), c("predicate")).alias("entity_key"), S.idempotency_key(c("predicate"), c("subject_id"), c("source_count")).alias("idempotency"))


@query("X16_string_score", "entities")
def _(e):
    from ..operators.resolution import string_score

    return e.select("entity_id", string_score(c("name"), c("description")).alias("score"))


@query("X13_redundancy_decision", "chunks", sql="""
SELECT chunk_id, redundancy_score >= CASE WHEN n_chars % 2 = 0 THEN 0.975 ELSE 0.92 END AND chunk_id > n_chars AS is_redundant,
       CASE WHEN redundancy_score >= CASE WHEN n_chars % 2 = 0 THEN 0.975 ELSE 0.92 END AND chunk_id > n_chars THEN n_chars END AS duplicate_of FROM chunks""")
def _(k):
    d = S.redundancy_decision(c("redundancy_score"), c("chunk_id"), c("n_chars"), c("n_chars") % 2 == 0)
    return k.select("chunk_id", d.alias("d")).select("chunk_id", "d.is_redundant", "d.duplicate_of")


@query("X20_merge_descriptions", "documents", sql=r"""
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(DISTINCT lower(s))::BIGINT AS n FROM s GROUP BY doc_id""")
def _(d):
    return d.select("doc_id", F.explode(T.sentences(c("text"))).alias("s")).groupBy("doc_id").agg(F.count_distinct(F.lower("s")).alias("n"))
