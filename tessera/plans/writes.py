"""Queries: inserts, merges, upserts, deletes and exports, as the tables they would leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as M
from ..operators import relational as R
from ..operators import stages as ST
from ..registry import query
from ..sources import exports as X

c = F.col
n = lambda: F.count("*")


@query("K01_batch_insert", "orders", "lineitem", sql="SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(o, l):
    return R.insert_new(o.where("o_orderstatus = 'F'"), l.select(c("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("K02_batch_update", "customer", "orders", sql="""
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, round(coalesce(t, c_acctbal), 2) AS c_acctbal FROM customer FULL JOIN s ON o_custkey = c_custkey""")
def _(u, o):
    changes = o.groupBy(c("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("c_acctbal"))
    return R.merge(u.select("c_custkey", "c_name", "c_acctbal"), changes, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("K03_batch_delete", "events", sql="SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value < 10)")
def _(e):
    return R.delete_where(e, (c("event_type") == "error") & (c("value") < 10)).select("event_id")


@query("K04_entity_upsert", "mentions", sql="""
SELECT entity_id, arg_min(video_id, (said_at, chunk_id, position)) AS first_seen, arg_max(video_id, (said_at, chunk_id, position)) AS last_seen, max(confidence) AS confidence, count(DISTINCT chunk_id) AS source_count, list_sort(list(DISTINCT video_id)) AS videos FROM mentions GROUP BY entity_id""")
def _(m):
    return M.upsert_entities(m)


@query("K05_mention_insert", "mentions", "entities", sql="""
WITH canon AS (SELECT name, min(entity_id) AS keep FROM entities GROUP BY name), ids AS (SELECT entity_id, keep FROM entities JOIN canon USING (name))
SELECT DISTINCT coalesce(keep, entity_id) AS entity_id, chunk_id, position FROM mentions LEFT JOIN ids USING (entity_id)""")
def _(m, e):
    keep = e.groupBy("name").agg(F.min("entity_id").alias("keep"))
    return M.remapped_mentions(m, e.join(keep, "name").select("entity_id", "keep")).select("entity_id", "chunk_id", "position")


@query("K06_relation_upsert", "relation_rows", sql="""
SELECT subject_id, object_id, predicate, max(confidence) AS confidence, arg_max(description, (length(description), description)) AS description, count(DISTINCT chunk_id) AS source_count FROM relation_rows GROUP BY ALL""")
def _(r):
    return M.upsert_relations(r)


@query("K07_community_upsert", "documents", sql="SELECT source AS community_id, arg_max(doc_id, (length(text), doc_id)) AS summary_of, list_sort(list(DISTINCT lang)) AS chunks FROM documents GROUP BY source")
def _(d):
    return d.groupBy(c("source").alias("community_id")).agg(F.max_by("doc_id", F.struct(F.length("text"), "doc_id")).alias("summary_of"), F.array_sort(F.collect_set("lang")).alias("chunks"))


@query("K08_assignment", "mentions", sql="SELECT entity_id, count(DISTINCT video_id) AS k, list_sort(list(DISTINCT video_id)) AS level_1 FROM mentions GROUP BY entity_id")
def _(m):
    found = M.assignments(m.select("entity_id", F.lit("level_1").alias("level"), c("video_id").alias("community")))
    level = F.try_element_at("assignments", F.lit("level_1"))
    return found.select("entity_id", F.size(level).cast("long").alias("k"), level.alias("level_1"))


@query("K09_set_status", "chunks", sql="SELECT chunk_id, CASE WHEN construction = 'completed' THEN 'completed' ELSE resolution END AS resolution FROM chunks")
def _(k):
    return ST.set_status(k, "resolution", "completed", c("construction") == "completed").select("chunk_id", "resolution")


@query("K11_clear_failed", "chunks", sql="SELECT chunk_id, CASE WHEN extraction = 'failed' THEN NULL ELSE extraction END AS extraction FROM chunks")
def _(k):
    return ST.clear_status(k, "extraction").select("chunk_id", "extraction")


@query("K12_clean_status", "chunks", sql="SELECT chunk_id, NULL::VARCHAR AS extraction, resolution FROM chunks")
def _(k):
    return ST.clear_status(k, "extraction", None).select("chunk_id", "extraction", "resolution")


@query("K14_partition_replace", "chunks", "documents", sql="SELECT video_id, chunk_id FROM chunks WHERE video_id NOT IN ('src1', 'src2') UNION ALL SELECT source, doc_id + 1000000 FROM documents WHERE source IN ('src1', 'src2')")
def _(k, d):
    new = d.where(c("source").isin("src1", "src2")).select(c("source").alias("video_id"), (c("doc_id") + 1_000_000).alias("chunk_id"))
    return M.replace_groups(k.select("video_id", "chunk_id"), new, "video_id")


@query("K18_csv_rows", "entities", sql="SELECT entity_id || ',' || type || ',' || source_count AS line FROM entities")
def _(e):
    return e.select(F.concat_ws(",", "entity_id", "type", c("source_count").cast("string")).alias("line"))


@query("K20_chat_export", "conversations", sql="SELECT conv_id, turn, upper(role) || ': ' || text AS line FROM conversations")
def _(v):
    return X.chat_lines(v, "txt")


@query("K23_cascade_delete", "customer", "orders", sql="SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(u, o):
    gone = u.where("c_acctbal < 0").select(c("c_custkey").alias("o_custkey"))
    return o.join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("K24_login_lockout", "events", sql="""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
a AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS attempts FROM s)
SELECT event_id, attempts::BIGINT AS attempts, attempts >= 5 AS locked FROM a""")
def _(e):
    return M.login_attempts(e, c("event_type") == "error", c("event_type") == "signup").select("event_id", "attempts", "locked")


@query("K25_feedback_upsert", "events", sql="SELECT user_id, event_type, arg_max(least(5, greatest(1, floor(value / 20)::INT)), (ts, event_id)) AS rating, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id, event_type")
def _(e):
    rows = e.select("user_id", "event_type", F.floor(c("value") / 20).cast("int").alias("rating"), "ts", "event_id")
    return M.upsert_feedback(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "rating", "created_at", "updated_at")


@query("K28_latest_runs", "events", sql="SELECT event_type, user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS runs FROM events GROUP BY event_type, user_id")
def _(e):
    return e.groupBy("event_type", "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), n().alias("runs"))


@query("K29_prometheus_lines", "samples", sql="""SELECT name || '{user="' || label || '"} ' || count(*) AS line FROM samples GROUP BY name, label""")
def _(s):
    return X.prometheus_lines(s.groupBy("name", "label").agg(n().alias("value")).select("name", F.create_map(F.lit("user"), c("label").cast("string")).alias("labels"), "value"))


@query("K16_transformation_log", "entities", sql="SELECT 'MERGE' AS operation, name AS target, count(*) - 1 AS merged FROM entities GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'CREATE', name, 0 FROM entities GROUP BY name HAVING count(*) = 1")
def _(e):
    return e.groupBy(c("name").alias("target")).agg((n() - 1).alias("merged")).select(F.when(c("merged") > 0, "MERGE").otherwise("CREATE").alias("operation"), "target", "merged")
