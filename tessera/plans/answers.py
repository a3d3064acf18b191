"""Queries: sources, question answering, enrichment, review, and the remaining stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import scores as S
from ..functions import text as T
from ..operators import answers as A
from ..operators import graph as G
from ..operators import merges as M
from ..operators import quality as Q
from ..operators import relational as R
from ..operators import retrieval as RT
from ..operators import stages as ST
from ..operators import vectors as V
from ..registry import query
from ..sources import connectors as N

c = F.col
r6 = lambda x: F.round(x, 6)
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_STOP = "['a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','were','with']"


@query("S01_collection_scan", "customer", sql="SELECT c_custkey, c_name FROM customer")
def _(u):
    return u.select("c_custkey", "c_name")


@query("S06_compress_scan", "videos", sql="SELECT video_id, length(transcript) AS n FROM videos WHERE transcript IS NOT NULL AND transcript <> ''")
def _(v):
    return v.where(~FL.missing(c("transcript"))).select("video_id", F.length("transcript").cast("long").alias("n"))


@query("S07_backfill_scan", "videos", sql="SELECT video_id FROM videos WHERE (transcript IS NULL OR transcript = '') AND channel_id IN ('en', 'fr')")
def _(v):
    return v.where(FL.missing(c("transcript")) & c("channel_id").isin("en", "fr")).select("video_id")


@query("S09_trust_scan", "chunks", sql="SELECT chunk_id, video_id, age_days, redundancy_score, is_redundant, code_present FROM chunks")
def _(k):
    return k.select("chunk_id", "video_id", "age_days", "redundancy_score", "is_redundant", "code_present")


@query("S13_detail_fetch", "videos", sql="SELECT 'v' || video_id AS id, 'Video ' || video_id AS title FROM videos")
def _(v):
    def fetch(ids):
        return {i: {"title": f"Video {i[1:]}"} for i in ids}

    return N.fetch_details(v.select(F.concat(F.lit("v"), c("video_id").cast("string")).alias("id")), fetch, "id string, title string")


@query("S18_sample", "documents")
def _(d):
    return N.sample(d.select("doc_id", "lang"), 50, "doc_id")


@query("S22_catalog_listing", "orders", "customer", sql="SELECT 'customer' AS name, count(*) AS rows, 5 AS columns FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def _(o, u):
    return N.catalog_listing(o.sparkSession, {"orders": o, "customer": u})


@query("S12_paged_source", "region")
def _(r):
    spark = r.sparkSession
    spark.dataSource.register(N.PagedSource)
    return spark.read.format("paged").schema("id string, title string, views long").options(service="numbered", total="230", page_size="50").load()


@query("F11_sorted_videos", "videos", sql="SELECT video_id FROM videos ORDER BY like_count, video_id LIMIT 40")
def _(v):
    return v.orderBy(*FL.sort_order({"sort_by": "like_count", "sort_order": "asc"})).limit(40).select("video_id")


@query("F18_serialised", "orders", sql="SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders")
def _(o):
    return o.select(c("o_orderkey").cast("string").alias("id"), F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("F21_document_kind", "videos", "chunks", sql="SELECT CASE WHEN transcript IS NOT NULL THEN 'video' ELSE 'reference' END AS kind, count(*) AS k FROM videos GROUP BY 1")
def _(v, k):
    kind = F.when(c("transcript").isNotNull(), "video").when(c("title").isNotNull(), "reference").otherwise("document")
    return v.groupBy(kind.alias("kind")).agg(F.count("*").alias("k"))


@query("G13_degree_centrality", "relations", sql="WITH d AS (SELECT id, count(*) AS k FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id) SELECT id AS entity_id, round(k / (SELECT max(k) FROM d), 6) AS centrality FROM d")
def _(r):
    return G.degree_centrality(r).select("entity_id", r6("centrality").alias("centrality"))


@query("G22_community_summaries", "mentions", "relations", "entities", sql="""
WITH m AS (SELECT DISTINCT video_id AS community, entity_id FROM mentions), e AS (SELECT community, name, type, row_number() OVER (PARTITION BY community ORDER BY confidence * source_count DESC, m.entity_id) AS i FROM m JOIN entities USING (entity_id)),
w AS (SELECT community, string_agg(name || ' (' || type || ')', ', ' ORDER BY i) AS who FROM e WHERE i <= 20 GROUP BY community),
s AS (SELECT a.community, subject_id || ' ' || predicate || ' ' || object_id AS said, row_number() OVER (PARTITION BY a.community ORDER BY r.confidence DESC, subject_id, object_id, predicate) AS i FROM relations r JOIN m a ON a.entity_id = subject_id JOIN m b ON b.entity_id = object_id AND b.community = a.community),
t AS (SELECT community, string_agg(said, '; ' ORDER BY i) AS what FROM s WHERE i <= 30 GROUP BY community)
SELECT community, sha256('Entities: ' || who || coalesce('. Relations: ' || what, '')) AS h FROM w LEFT JOIN t USING (community)""")
def _(m, r, e):
    members = m.select(c("video_id").alias("community"), "entity_id").distinct()
    return A.community_summaries(members, r, e).select("community", F.sha2("summary", 256).alias("h"))


@query("K10_failure_marking", "chunks", sql="SELECT chunk_id, CASE WHEN n_chars > 4000 THEN 'failed' ELSE extraction END AS extraction FROM chunks")
def _(k):
    return ST.set_status(k, "extraction", "failed", c("n_chars") > 4000).select("chunk_id", "extraction")


@query("K13_collection_copy", "nation", sql="SELECT * FROM nation")
def _(t):
    import uuid

    path = f"{M.shared_dir(t.sparkSession).rstrip('/')}/copies/nation-{uuid.uuid4().hex}"
    t.write.parquet(path)
    return t.sparkSession.read.parquet(path)


@query("K15_snapshot", "entities", sql="SELECT type, count(*) AS k FROM entities GROUP BY type")
def _(e):
    import uuid

    trace = uuid.uuid4().hex
    path = M.snapshot(e, "entities_resolved", trace)
    return e.sparkSession.read.parquet(path).where(c("trace_id") == trace).groupBy("type").agg(F.count("*").alias("k"))


@query("K22_outbox_insert", "documents", sql="""SELECT doc_id, 'pending' AS status, '{"id":"' || doc_id || '","type":"document.process","attempt":0}' AS envelope FROM documents WHERE doc_id % 3 <> 0""")
def _(d):
    # the rows that a unique index lets in: every third document has its message already
    envelope = F.to_json(F.struct(c("doc_id").cast("string").alias("id"), F.lit("document.process").alias("type"), F.lit(0).alias("attempt")))
    return R.insert_new(d.where("doc_id % 3 = 0"), d.select("doc_id", F.lit("pending").alias("status"), envelope.alias("envelope")), ["doc_id"])


@query("K26_profile_upsert", "customer", "orders", sql="SELECT c_custkey, coalesce(max(o_orderpriority), c_mktsegment) AS persona FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def _(u, o):
    changes = o.groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("persona"))
    return R.merge(u.select("c_custkey", c("c_mktsegment").alias("persona")), changes, ["c_custkey"])


@query("K32_memory_log", "conversations", sql="SELECT conv_id AS session_id, turn, length(text) AS letters FROM conversations WHERE role = 'assistant'")
def _(v):
    return v.where("role = 'assistant'").select(c("conv_id").alias("session_id"), "turn", F.length("text").cast("long").alias("letters"))


@query("U03_add_to_set", "mentions", sql="SELECT entity_id, list_sort(list_distinct(list_concat(list(DISTINCT chunk_id), ['new']))) AS chunks FROM mentions GROUP BY entity_id")
def _(m):
    return m.groupBy("entity_id").agg(F.array_sort(F.array_union(F.collect_set("chunk_id"), F.array(F.lit("new")))).alias("chunks"))


@query("A36_metrics_unpivoted", "mentions", "entities", sql="""
WITH s AS (SELECT count(DISTINCT entity_id) AS size FROM mentions GROUP BY video_id) SELECT 'communities' AS name, count(*)::DOUBLE AS value FROM s UNION ALL SELECT 'largest', max(size)::DOUBLE FROM s UNION ALL SELECT 'avg_size', round(avg(size), 6) FROM s""")
def _(m, e):
    flat = Q.unpivoted(Q.detection_quality(m, e, "video_id"))
    return flat.where(c("name").isin("communities", "largest", "avg_size")).select("name", r6("value").alias("value"))


@query("X18_multi_strategy_score", "entities")
def _(e):
    from ..operators.resolution import multi_strategy_score

    return e.select("entity_id", r6(multi_strategy_score(c("name"), c("canonical_name"))).alias("score"))


@query("X21_resolved_descriptions", "entities", sql="SELECT name, sha256(string_agg(d, '. ' ORDER BY d)) AS h FROM (SELECT DISTINCT name, lower(description) AS d FROM entities WHERE description IS NOT NULL) GROUP BY name")
def _(e):
    merged = e.where("description is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.lower("description"))).alias("d"))
    return merged.select("name", F.sha2(F.array_join("d", ". "), 256).alias("h"))


@query("X24_ambiguous_tokens", "entities", sql="SELECT entity_id, length(name) <= 3 OR NOT contains(name, ' ') AS ambiguous FROM entities")
def _(e):
    return e.select("entity_id", ((F.length("name") <= 3) | ~F.contains("name", F.lit(" "))).alias("ambiguous"))


@query("X33_pruned_catalog", "part", sql="""
WITH v AS (SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name), t AS (SELECT max(n) AS top FROM v)
SELECT value, round(1.0 + 0.2 * n / top, 6) AS score FROM v, t WHERE contains(lower(value), 'red') ORDER BY round(1.0 + 0.2 * n / top, 9) DESC, n DESC, value LIMIT 20""")
def _(p):
    values = p.groupBy(c("p_name").alias("value")).agg(F.count("*").alias("n"))
    return A.pruned_catalog(values, ["red"], least=0.99).select("value", r6("score").alias("score"))


@query("X35_embedding_text", "chunks", sql="SELECT chunk_id, sha256('Entities: ' || channel_id || ', ' || video_id || chr(10) || text) AS h FROM chunks")
def _(k):
    return k.select("chunk_id", F.sha2(A.embedding_text(F.lit(""), F.array("channel_id", "video_id"), F.array().cast("array<string>"), c("text")), 256).alias("h"))


@query("X36_enrichment_quality", "chunks", sql="""
SELECT chunk_id, round((0.4 * redundancy_score + 0.2 * engagement_norm) / 0.6, 6) AS score, CASE WHEN (0.4 * redundancy_score + 0.2 * engagement_norm) / 0.6 >= 0.8 THEN 'high' WHEN (0.4 * redundancy_score + 0.2 * engagement_norm) / 0.6 >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM chunks""")
def _(k):
    q = A.enrichment_quality(F.array("redundancy_score"), F.array().cast("array<double>"), F.array("engagement_norm"))
    return k.select("chunk_id", q.alias("q")).select("chunk_id", r6("q.score").alias("score"), "q.level")


@query("X37_normalised_payload", "events", sql="SELECT event_id, CASE event_type WHEN 'view' THEN 'Person' ELSE 'Other' END AS type, round(least(1.0, value / 100), 6) AS relevance FROM events")
def _(e):
    payload = F.array(F.struct(F.lit(" x ").alias("name"), F.when(c("event_type") == "view", "PERSON").otherwise(c("event_type")).alias("type"), (c("value") / 100).alias("relevance")), F.struct(F.lit(" ").alias("name"), F.lit("event").alias("type"), F.lit(0.5).alias("relevance")))
    return e.select("event_id", F.explode(A.normalised_payload(payload)).alias("x")).select("event_id", "x.type", r6("x.relevance").alias("relevance"))


@query("X39_compressed_text", "documents", sql=r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\s+([''’])\s*([A-Za-z0-9_])', '\1\2', 'g'), '([A-Za-z0-9_])\s*-\s+([A-Za-z0-9_])', '\1-\2', 'g'), '([A-Za-z0-9_])\s*_\s*([A-Za-z0-9_])', '\1_\2', 'g') AS t FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(CASE WHEN 2 * len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) <= 1)) > len(string_split(t, chr(10))) THEN replace(t, chr(10), '') ELSE t END, '\s+', ' ', 'g'))) AS h FROM a""")
def _(d):
    return d.select("doc_id", F.sha2(T.compressed_text(c("text")), 256).alias("h"))


@query("X41_document_diff", "documents")
def _(d):
    return A.document_diff(d.select("doc_id", c("text").alias("old"), F.upper("text").alias("new"))).select("doc_id", "ratio", F.size("changes").alias("changes"))


@query("X42_issues", "chunks", sql=r"""
SELECT chunk_id, unnest(list_filter([CASE WHEN redundancy_score < 0.6 THEN 'low_trust' END, CASE WHEN extraction = 'failed' THEN 'failed_extraction' END, CASE WHEN resolution = 'failed' THEN 'failed_resolution' END, CASE WHEN regexp_matches(text, '\[\d+\]|\(\d{4}\)') THEN 'citation' END], lambda x: x IS NOT NULL)) AS issue FROM chunks""")
def _(k):
    return A.issues(k.withColumnRenamed("redundancy_score", "trust"))


@query("L07_ranked", "chunks", sql="SELECT chunk_id, round(redundancy_score, 6) AS score FROM chunks ORDER BY redundancy_score DESC, chunk_id LIMIT 30")
def _(k):
    return R.page(k.select("chunk_id", r6("redundancy_score").alias("score")), [c("score").desc(), c("chunk_id").asc()], 0, 30)


@query("X29_rerank_defaults", "chunks", sql="SELECT chunk_id, round(0.6 * engagement_norm + 0.125 + 0.075, 6) AS score FROM chunks")
def _(k):
    return k.select("chunk_id", r6(S.rerank_score(c("engagement_norm"), F.lit(None).cast("double"), F.lit(0.0))).alias("score"))


@query("V06_dispatch", "documents", sql=f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), a AS (SELECT count(*) AS n, avg(len(w)) AS m FROM t), x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t), tf AS (SELECT doc_id, l, count(*) AS tf FROM x WHERE term = 'license' GROUP BY ALL), df AS (SELECT count(*) AS df FROM tf)
SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM tf, df, a ORDER BY round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)), 9) DESC, doc_id LIMIT 10""")
def _(d):
    return A.retrieve(d, "license").select("doc_id", r6("score").alias("score"))


@query("V08_answer_context", "documents")
def _(d):
    hits = RT.keyword_search(d, "the license version", 5)
    return A.context(hits, d)


@query("V11_understood_questions", "conversations", sql=rf"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({_WORDS}, lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w)))), ' ') AS keywords FROM conversations WHERE role = 'user'""")
def _(v):
    return A.understood(v.where("role = 'user'")).select("conv_id", "turn", F.array_join(F.array_sort("keywords"), " ").alias("keywords"))


@query("V12_template_answers", "documents")
def _(d):
    from ..providers import complete

    return complete(d.select("doc_id", "text"), c("text")).select("doc_id", "answer")


@query("V13_simulated_query", "entities", "relations", "mentions", sql="""
WITH s AS (SELECT entity_id FROM entities WHERE regexp_matches(name, '(?i)small ring') OR regexp_matches(description, '(?i)small ring') ORDER BY trust_score DESC NULLS LAST, centrality_score DESC, confidence DESC, entity_id LIMIT 5),
n AS (SELECT * FROM relations WHERE subject_id IN (SELECT entity_id FROM s) OR object_id IN (SELECT entity_id FROM s) ORDER BY confidence DESC, subject_id, object_id, predicate LIMIT 100),
r AS (SELECT subject_id AS entity_id FROM n UNION SELECT object_id FROM n UNION SELECT entity_id FROM s), m AS (SELECT * FROM mentions WHERE entity_id IN (SELECT entity_id FROM r))
SELECT 1 AS step, 'extraction' AS name, count(*) AS found FROM s UNION ALL SELECT 2, 'search', count(*) FROM n UNION ALL SELECT 3, 'traversal', count(*) FROM r UNION ALL SELECT 4, 'community', least(10, count(DISTINCT video_id)) FROM m UNION ALL SELECT 5, 'assembly', count(DISTINCT chunk_id) FROM m""")
def _(e, r, m):
    return A.graph_steps(e, r, m, "small ring")


@query("V15_rewritten_queries", "conversations", sql=rf"""
WITH k AS (SELECT conv_id, turn, text, list_distinct(list_filter({_WORDS}, lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w))) AS own, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
b AS (SELECT k.*, list_distinct(list_filter(regexp_extract_all(lower(coalesce(before, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w))) AS earlier FROM k),
x AS (SELECT *, list_sort(list_filter(earlier, lambda w: NOT list_contains(own, w))) AS extra FROM b)
SELECT conv_id, turn, len(regexp_split_to_array(trim(text), '\s+')) <= 12 AND len(extra) > 0 AS longer, CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 12 THEN array_to_string(extra, ' ') ELSE '' END AS added FROM x""")
def _(v):
    # the words that a rewritten turn has behind its text, in order
    added = F.substr("query", F.length("text") + 2)
    return A.rewritten(v, longest=12).select("conv_id", "turn", (c("query") != c("text")).alias("longer"), F.array_join(F.array_sort(F.filter(F.split(added, " "), lambda w: w != "")), " ").alias("added"))


@query("P01_ingest_stage", "videos", sql="SELECT video_id, round(least(1.0, (2 * like_count + 3 * comment_count) / greatest(100, view_count)), 6) AS engagement, duration_seconds::BIGINT AS seconds FROM videos WHERE view_count > 0")
def _(v):
    d = c("duration_seconds")
    raw = v.withColumn("duration", F.concat(F.lit("PT"), F.floor(d / 60), F.lit("M"), d % 60, F.lit("S")))
    return raw.where("view_count > 0").select("video_id", r6(S.engagement_score(c("view_count"), c("like_count"), c("comment_count"))).alias("engagement"), T.iso8601_seconds(c("duration")).cast("long").alias("seconds"))


@query("P02_clean_stage", "videos", sql=r"""
SELECT video_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(transcript, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g'), '(?i)[\[(](applause|music|laughter|inaudible|silence|noise|crosstalk)[\])]', '', 'g'), '[ \t]{2,}', ' ', 'g'))) AS h FROM videos WHERE transcript IS NOT NULL AND transcript <> ''""")
def _(v):
    return v.where(~FL.missing(c("transcript"))).select("video_id", F.sha2(T.remove_cues(T.normalize_newlines(c("transcript"))), 256).alias("h"))


@query("P06_embed_stage", "chunks")
def _(k):
    text = A.embedding_text(F.lit(None).cast("string"), F.array("channel_id"), F.array().cast("array<string>"), c("text"))
    return V.hashing_embedding(k.select("chunk_id", text.alias("text"))).select("chunk_id", "embedding")


@query("P09_backfill_stage", "videos", "conversations", sql="SELECT video_id, sha256(coalesce(nullif(transcript, ''), s.text)) AS h FROM videos LEFT JOIN (SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) s ON conv_id = video_id")
def _(v, t):
    from ..operators.chunking import segment_join

    joined = segment_join(t, "conv_id", "turn").select(c("conv_id").alias("video_id"), c("text").alias("joined"))
    return v.select("video_id", "transcript").join(joined, "video_id", "left").select("video_id", F.sha2(F.coalesce(F.nullif(c("transcript"), F.lit("")), c("joined")), 256).alias("h"))


@query("P10_extraction_stage", "relation_rows", "entities", sql="""
SELECT predicate, count(*) AS k FROM relation_rows r JOIN entities a ON a.entity_id = r.subject_id AND a.confidence >= 0.3 JOIN entities b ON b.entity_id = r.object_id AND b.confidence >= 0.3 WHERE r.confidence >= 0.3 GROUP BY predicate""")
def _(r, e):
    kept = e.where("confidence >= 0.3").select("entity_id")
    return r.where("confidence >= 0.3").join(kept, c("subject_id") == c("entity_id"), "left_semi").join(kept, c("object_id") == c("entity_id"), "left_semi").groupBy("predicate").agg(F.count("*").alias("k"))


@query("P11_resolution_stage", "entities", "mentions", sql="""
WITH k AS (SELECT lower(trim(name)) AS nm, type, min(entity_id) AS keep FROM entities GROUP BY 1, 2), m AS (SELECT e.entity_id, keep FROM entities e JOIN k ON nm = lower(trim(e.name)) AND k.type = e.type)
SELECT keep AS entity_id, count(DISTINCT (chunk_id, position)) AS mentions FROM mentions JOIN m USING (entity_id) GROUP BY keep""")
def _(e, m):
    keep = e.groupBy(T.normalize_entity_name(c("name")).alias("nm"), "type").agg(F.min("entity_id").alias("keep"))
    ids = e.select("entity_id", T.normalize_entity_name(c("name")).alias("nm"), "type").join(keep, ["nm", "type"]).select("entity_id", "keep")
    return M.remapped_mentions(m, ids).groupBy("entity_id").agg(F.count("*").alias("mentions"))


@query("P14_runner", "chunks", sql="SELECT extraction AS status, count(*) AS k FROM (SELECT CASE WHEN extraction = 'failed' THEN NULL ELSE extraction END AS extraction FROM chunks) GROUP BY 1")
def _(k):
    from .stages import Runner, Stage, closure

    steps = [Stage("clear", lambda s, df: ST.clear_status(df, "extraction")), Stage("count", lambda s, df: df.groupBy(c("extraction").alias("status")).agg(F.count("*").alias("k")), needs=("clear",))]
    import uuid

    runner = Runner(k.sparkSession, f"{M.shared_dir(k.sparkSession).rstrip('/')}/runs/{uuid.uuid4().hex}")
    return runner.run(closure(steps, ["count"]), k.select("chunk_id", "extraction"))


@query("T06_compression_units", "documents", sql=r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n|\n'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS units FROM documents")
def _(d):
    from ..operators.chunking import paragraphs

    return d.select("doc_id", F.size(paragraphs(c("text"))).cast("long").alias("units"))


@query("T03_semantic_split", "documents")
def _(d):
    from ..operators.chunking import semantic_split

    return semantic_split(d)


@query("P11_fuzzy_resolution", "entities")
def _(e):
    """Entities that equal names leave apart, by blocking keys and fuzzy scores: (entity_id, match, score)."""
    from ..operators.resolution import best_matches

    keep = e.groupBy(T.normalize_entity_name(c("name")).alias("nm"), "type").agg(F.min("entity_id").alias("entity_id"))
    one = e.join(keep.select("entity_id"), "entity_id", "left_semi")
    return best_matches(one, one).select("entity_id", "match", r6("score").alias("score"))


_SPECS = [("plain", {"channels": ["a"], "limit": 10}, 0), ("types", {"channels": "a", "keywords_any": [1]}, 2), ("range", {"duration": {"min_seconds": 9, "max_seconds": 3}}, 1), ("numbers", {"engagement": {"min_views": -1, "min_likes": True}, "limit": 0}, 3), ("sort", {"sort_by": "nothing", "has_transcript": "yes"}, 2)]


@query("F10_filter_validation", "region", sql="SELECT * FROM (VALUES " + ", ".join(f"('{name}', {n}::BIGINT)" for name, _, n in _SPECS) + ") v(spec, wrong)")
def _(r):
    return r.sparkSession.createDataFrame([(name, len(FL.validate_filter(spec))) for name, spec, _ in _SPECS], "spec string, wrong long")


@query("K27_saved_filters", "nation", sql="""
SELECT 'f' || n_nationkey AS filter_id, CASE n_nationkey WHEN 3 THEN 'renamed' ELSE n_name END AS name, '{"limit": ' || (n_nationkey + 1) || '}' AS spec, CASE n_nationkey WHEN 5 THEN 2 ELSE 0 END::BIGINT AS uses FROM nation WHERE n_nationkey <> 4
UNION ALL SELECT 'copy', n_name || ' (copy)', '{"limit": 6}', 0 FROM nation WHERE n_nationkey = 5
UNION ALL SELECT 'new', 'mine', '{"channels": ["en"], "limit": 5}', 0""")
def _(n):
    from ..operators import saved_filters as SF

    have = n.select(F.concat(F.lit("f"), "n_nationkey").alias("filter_id"), c("n_name").alias("name"), F.concat(F.lit('{"limit": '), c("n_nationkey") + 1, F.lit("}")).alias("spec"), F.lit(0).cast("long").alias("uses"))
    have = SF.used(SF.used(have, "f5"), "f5")
    have = SF.delete(SF.update(SF.duplicate(have, "f5", "copy"), "f3", name="renamed"), "f4")
    return SF.create(SF.create(have, "new", "mine", {"limit": 5, "channels": ["en"]}), "f1", "taken", {})


@query("T04_whole_text_fallback", "documents", sql=r"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE greatest(0, ceil((n - 500) / 450))::BIGINT + 1 END AS chunks FROM w WHERE n > 0 AND source IS NOT NULL""")
def _(d):
    from ..operators.chunking import token_windows, with_whole_texts

    # a splitter that gives nothing for two sources
    pieces = token_windows(d.where(~c("source").isin("src1", "src2")), 500, 50)
    some = d.where(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)) > 0).where("source is not null")
    return with_whole_texts(some, pieces).groupBy("doc_id").agg(F.count("*").alias("chunks"))

