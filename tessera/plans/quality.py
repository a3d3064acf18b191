"""Queries: quality metrics, trends, gates and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import relational as R
from ..registry import query

c = F.col
n = lambda: F.count("*")
r6 = lambda x: F.round(x, 6)


def _rounded(df, digits=6):
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else c(f.name) for f in df.schema.fields])


@query("A08_retrieval_stats", "entities", "orders", sql="SELECT 'type' AS kind, type AS value, count(*) AS count FROM entities GROUP BY type UNION ALL SELECT 'level', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def _(e, o):
    return R.distribution(e, "type").select(F.lit("type").alias("kind"), c("type").alias("value"), "count").unionAll(R.distribution(o, "o_orderpriority").select(F.lit("level").alias("kind"), c("o_orderpriority").alias("value"), "count"))


@query("A25_coherence", "mentions", "entities", "relations", sql="""
WITH m AS (SELECT DISTINCT 'n' || (substr(video_id, 2)::BIGINT % 25) AS community, entity_id FROM mentions), s AS (SELECT 'n' || (substr(entity_id, 2)::BIGINT % 25) AS community, entity_id FROM entities WHERE entity_id LIKE 's%'), a AS (SELECT * FROM m UNION SELECT * FROM s),
e AS (SELECT community, count(*) AS n, avg(confidence) AS ec FROM a JOIN entities USING (entity_id) GROUP BY community),
l AS (SELECT x.community, count(*) AS links, avg(confidence) AS rc FROM relations r JOIN a x ON x.entity_id = r.subject_id JOIN a y ON y.entity_id = r.object_id AND x.community = y.community GROUP BY x.community)
SELECT community, round(CASE WHEN n <= 1 THEN 0 ELSE least(1.0, 0.4 * coalesce(links, 0) / (n * (n - 1) / 2) + 0.3 * ec + 0.3 * coalesce(rc, 0)) END, 6) AS coherence FROM e LEFT JOIN l USING (community)""")
def _(m, e, r):
    mine = m.select(F.concat(F.lit("n"), F.substring("video_id", 2, 20).cast("long") % 25).alias("community"), "entity_id").distinct()
    sup = e.where(c("entity_id").startswith("s")).select(F.concat(F.lit("n"), F.substring("entity_id", 2, 20).cast("long") % 25).alias("community"), "entity_id")
    return _rounded(Q.coherence(mine.unionByName(sup).distinct(), e, r))


@query("A26_community_quality", "mentions", "entities", sql="""
WITH s AS (SELECT video_id, count(DISTINCT entity_id) AS size FROM mentions GROUP BY video_id)
SELECT count(*) AS communities, round(avg(size), 6) AS avg_size, list_sort(list(size))[(count(*) * 0.5)::INT + CASE WHEN (count(*) * 0.5)::INT > count(*) * 0.5 THEN 0 ELSE 1 END] AS p50_size, list_sort(list(size))[floor(count(*) * 0.95)::INT + 1] AS p95_size, round(count(*) FILTER (size = 1) / count(*), 6) AS singleton_rate, max(size) AS largest,
  round((SELECT count(DISTINCT entity_id) FROM mentions) / (SELECT count(*) FROM entities), 6) AS coverage FROM s""")
def _(m, e):
    return _rounded(Q.detection_quality(m, e, "video_id"))


@query("A27_quality_gates", "mentions", "entities", sql="""
WITH s AS (SELECT video_id, count(DISTINCT entity_id) AS size FROM mentions GROUP BY video_id), q AS (SELECT max(size) AS largest, count(*) FILTER (size = 1) / count(*) AS single, (SELECT count(DISTINCT entity_id) FROM mentions) / (SELECT count(*) FROM entities) AS cover FROM s)
SELECT 'coverage' AS gate, cover >= 0.7 AS passed FROM q UNION ALL SELECT 'size', largest <= 5000 FROM q UNION ALL SELECT 'singletons', single <= 0.3 FROM q""")
def _(m, e):
    return Q.quality_gates(Q.detection_quality(m, e, "video_id"))


@query("A28_size_bands", "orders", sql="SELECT CASE WHEN k <= 2 THEN 'small' WHEN k <= 5 THEN 'medium' ELSE 'large' END AS band, count(*) AS count FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY 1")
def _(o):
    return Q.size_bands(o.groupBy("o_custkey").agg(n().alias("size")))


@query("A29_size_histogram", "orders", sql="SELECT k AS size, count(*) AS count FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) GROUP BY k")
def _(o):
    return o.groupBy("o_custkey").agg(n().alias("size")).groupBy("size").agg(n().alias("count"))


@query("A30_predicate_profile", "relation_rows", sql="SELECT predicate, count(*) AS k, round(count(*) * avg(confidence), 4) AS score FROM relation_rows GROUP BY predicate ORDER BY score DESC, predicate LIMIT 10")
def _(r):
    return r.groupBy("predicate").agg(n().alias("k"), F.round(n() * F.avg("confidence"), 4).alias("score")).orderBy(F.desc("score"), "predicate").limit(10)


@query("A31_extraction_quality", "relation_rows", "entities", sql="""
SELECT round(count(*) / count(DISTINCT chunk_id), 6) AS relations_per_chunk, round(count(DISTINCT predicate) / count(*), 6) AS predicate_diversity, round(least(1.0, (SELECT count(DISTINCT type) FROM entities) / 5), 6) AS type_coverage, round(avg(confidence), 6) AS confidence FROM relation_rows""")
def _(r, e):
    return _rounded(Q.extraction_quality(r, e))


@query("A32_resolution_quality", "relation_rows", "relations", sql="""
SELECT (SELECT count(*) FROM relation_rows) AS raw, (SELECT count(*) FROM relations) AS resolved, round(1 - (SELECT count(*) FROM relations) / (SELECT count(*) FROM relation_rows), 6) AS merge_rate, round((SELECT avg(confidence) FROM relations) / (SELECT avg(confidence) FROM relation_rows), 6) AS confidence_preservation""")
def _(a, b):
    return _rounded(Q.resolution_quality(a, b))


@query("A33_construction_quality", "relations", "entities", sql="""
WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relations UNION ALL SELECT object_id FROM relations) GROUP BY id), v AS (SELECT coalesce(degree, 0) AS degree FROM entities LEFT JOIN d ON id = entity_id), s AS (SELECT count(*) AS n, avg(degree) AS m, max(degree) AS t, stddev_pop(degree) AS sd FROM v)
SELECT round((SELECT count(*) FROM relations) / (n * (n - 1)), 6) AS density, round(m, 6) AS avg_degree, CASE WHEN t > 10 * m THEN 'power_law' WHEN sd < m THEN 'random' ELSE 'small_world' END AS degree_type FROM s""")
def _(r, e):
    return _rounded(Q.construction_quality(r, e))


@query("A34_size_percentiles", "orders", sql="""
WITH s AS (SELECT count(*) AS k FROM orders GROUP BY o_custkey), a AS (SELECT list_sort(list(k)) AS l FROM s) SELECT l[floor(len(l) * 0.5)::INT + 1] AS p50, l[floor(len(l) * 0.95)::INT + 1] AS p95 FROM a""")
def _(o):
    return Q.index_percentiles(o.groupBy("o_custkey").agg(n().alias("k")), "k", {"p50": 0.5, "p95": 0.95})


@query("A35_healthy_ranges", "mentions", "entities", sql="""
WITH s AS (SELECT count(DISTINCT entity_id) AS size FROM mentions GROUP BY video_id) SELECT 'singleton_rate' AS name, round(count(*) FILTER (size = 1) / count(*), 6) AS value, count(*) FILTER (size = 1) / count(*) BETWEEN 0 AND 0.3 AS in_range FROM s
UNION ALL SELECT 'coverage', round((SELECT count(DISTINCT entity_id) FROM mentions) / (SELECT count(*) FROM entities), 6), (SELECT count(DISTINCT entity_id) FROM mentions) / (SELECT count(*) FROM entities) BETWEEN 0.7 AND 1""")
def _(m, e):
    return Q.unpivoted(Q.detection_quality(m, e, "video_id")).where("low is not null").select("name", r6("value").alias("value"), "in_range")


@query("A37_raw_and_resolved", "relation_rows", "relations", sql="""
WITH a AS (SELECT count(*) AS raw, avg(confidence) AS c0 FROM relation_rows), b AS (SELECT count(*) AS resolved, avg(confidence) AS c1 FROM relations)
SELECT raw, resolved, round((raw - resolved) / raw, 6) AS merge_rate, round(c1 / c0, 6) AS confidence_preservation FROM a, b""")
def _(a, b):
    return Q.resolution_quality(a, b).select("raw", "resolved", F.round("merge_rate", 6).alias("merge_rate"), F.round("confidence_preservation", 6).alias("confidence_preservation"))


@query("A38_historical_stats", "events", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events), k AS (SELECT * FROM r WHERE i <= 10)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, list_sort(list(value))[floor(count(*) * 0.9)::INT + 1] AS p90 FROM k GROUP BY event_type""")
def _(e):
    return Q.historical(e, "value", "event_type", [c("ts").desc(), c("event_id").desc()]).withColumn("avg", r6("avg"))


@query("A39_trend", "events", sql="""
WITH m AS (SELECT event_type, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS recent, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS older FROM events GROUP BY event_type)
SELECT event_type, round(recent, 6) AS recent, round(older, 6) AS older, CASE WHEN (recent - older) / abs(older) > 0.05 THEN 'improving' WHEN (recent - older) / abs(older) < -0.05 THEN 'declining' WHEN recent IS NOT NULL AND older IS NOT NULL THEN 'stable' ELSE 'unknown' END AS trend FROM m""")
def _(e):
    return _rounded(Q.trend(e, "value", "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "event_type"))


@query("A40_comparison", "events", sql="""
WITH a AS (SELECT avg(value) AS m FROM events) SELECT user_id, round(avg(value), 6) AS mean, CASE WHEN avg(value) > 1.1 * any_value(m) THEN 'above' WHEN avg(value) < 0.9 * any_value(m) THEN 'below' ELSE 'average' END AS verdict, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate FROM events, a GROUP BY user_id""")
def _(e):
    mean = e.agg(F.avg("value").alias("m"))
    by = e.groupBy("user_id").agg(F.avg("value").alias("v"), (F.count_if(c("event_type") != "error") / n()).alias("s")).crossJoin(F.broadcast(mean))
    return by.select("user_id", r6("v").alias("mean"), F.when(c("v") > 1.1 * c("m"), "above").when(c("v") < 0.9 * c("m"), "below").otherwise("average").alias("verdict"), r6("s").alias("success_rate"))


@query("A41_insights", "events", sql="""
WITH r AS (SELECT user_id AS run_id, sum(value) AS seconds, count(*) AS docs, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id), a AS (SELECT avg(seconds) AS u FROM r)
SELECT run_id, unnest(list_filter([CASE WHEN seconds > 1.5 * u THEN 'slow' END, CASE WHEN errors / docs > 0.1 THEN 'many_retries' END, CASE WHEN docs / seconds < 0.5 THEN 'low_throughput' END, CASE WHEN errors >= 3 THEN 'repeated_error' END], lambda x: x IS NOT NULL)) AS insight FROM r, a""")
def _(e):
    runs = e.groupBy(c("user_id").alias("run_id")).agg(F.sum("value").alias("seconds"), n().alias("docs"), F.count_if(c("event_type") == "error").alias("retries"))
    usual = runs.agg(F.avg("seconds").alias("usual_seconds"))
    full = runs.crossJoin(F.broadcast(usual)).withColumns({"cost": F.lit(0.0), "usual_cost": F.lit(0.0), "tokens": F.lit(0), "same_errors": c("retries")})
    return Q.insights(full)


@query("A43_trust_statistics", "chunks", sql="""
SELECT round(avg(t), 6) AS avg, round(min(t), 6) AS min, round(max(t), 6) AS max, count(*) FILTER (t >= 0.7) AS high, count(*) FILTER (t <= 0.3) AS low, round(100 * count(*) FILTER (t >= 0.7) / count(t), 6) AS high_percent, round(100 * count(*) FILTER (t <= 0.3) / count(t), 6) AS low_percent FROM (SELECT redundancy_score AS t FROM chunks)""")
def _(k):
    return _rounded(Q.trust_statistics(k, "redundancy_score"))


@query("A44_relation_stats", "relation_rows", sql="SELECT predicate, count(*) AS n, round(avg(confidence), 6) AS avg, count(DISTINCT subject_id) AS subjects, count(DISTINCT object_id) AS objects FROM relation_rows GROUP BY predicate")
def _(r):
    return r.groupBy("predicate").agg(n().alias("n"), r6(F.avg("confidence")).alias("avg"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("object_id").alias("objects"))


@query("A48_token_cost", "documents", sql="""
SELECT doc_id, round((length(text) // 4 * CASE WHEN m LIKE 'large-fast%' THEN 1.0 WHEN m LIKE 'large%' THEN 5.0 ELSE 2.0 END + n_chars * CASE WHEN m LIKE 'large-fast%' THEN 2.0 WHEN m LIKE 'large%' THEN 15.0 ELSE 4.0 END) / 1e6, 6) AS cost FROM (SELECT *, CASE n_chars % 3 WHEN 0 THEN 'large-fast-1' WHEN 1 THEN 'large-2' ELSE 'small' END AS m FROM documents)""")
def _(d):
    usage = d.select("doc_id", F.when(c("n_chars") % 3 == 0, "large-fast-1").when(c("n_chars") % 3 == 1, "large-2").otherwise("small").alias("model"), F.floor(F.length("text") / 4).alias("tokens_in"), c("n_chars").alias("tokens_out"))
    return Q.token_cost(usage, {"large": (5.0, 15.0), "large-fast": (1.0, 2.0)}, (2.0, 4.0)).select("doc_id", r6("cost").alias("cost"))


@query("A51_pipeline_history", "events", sql="SELECT event_id, ts, (SELECT count(*) FROM events WHERE event_type = 'signup') AS total, (SELECT count(*) FROM events WHERE event_type = 'signup') > 20 AS has_more FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id LIMIT 20")
def _(e):
    return R.page_with_total(e.where("event_type = 'signup'").select("event_id", "ts"), [c("ts").desc(), c("event_id").asc()], 0, 20)


@query("A52_percentile_rank", "events", sql="SELECT event_type, round(avg(pr), 6) AS rank FROM (SELECT event_type, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS pr FROM events) GROUP BY event_type")
def _(e):
    from pyspark.sql import Window

    return e.select("event_type", F.percent_rank().over(Window.partitionBy("event_type").orderBy("value")).alias("pr")).groupBy("event_type").agg(r6(F.avg("pr")).alias("rank"))


@query("A54_quality_endpoint", "mentions", "entities", sql="SELECT round(((SELECT count(*) FROM mentions) - count(*)) / (SELECT count(*) FROM mentions), 6) AS merge_rate, count(*) AS entities FROM entities")
def _(m, e):
    k = m.agg(n().alias("m"))
    return e.agg(n().alias("entities")).crossJoin(F.broadcast(k)).select(r6((c("m") - c("entities")) / c("m")).alias("merge_rate"), "entities")
