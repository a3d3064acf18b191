"""Queries: message streams, each run to its end and read from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..sources.shared import shared_dir
from ..streaming import queues as K

c = F.col
n = lambda: F.count("*")


def _messages(events):
    """Events as JSON envelopes with an attempt; errors have no readable body, and every seventh lacks its field."""
    kind = F.when(c("event_type") == "view", "document.process").when(c("event_type") == "click", "email.send").when(c("event_type") == "purchase", "image.process").when(c("event_type") == "signup", "profile.task")
    field = F.when(c("event_type") == "view", "document_id").when(c("event_type") == "click", "to").when(c("event_type") == "purchase", "image_url").otherwise("profile_id")
    payload = F.when(c("event_id") % 7 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"'), field, F.lit('": "x", "subject": "s", "task_type": "sync"}')))
    body = F.when(c("event_type") == "error", F.lit("not json")).otherwise(F.to_json(F.struct(c("event_id").cast("string").alias("id"), kind.alias("type"), payload.alias("payload"))))
    return events.select(body.alias("value"), c("ts").cast("timestamp").alias("ts"), "event_id", "user_id")


_ROUTED = """
SELECT CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'dead_letter' ELSE 'accept' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_id % 7 = 0 THEN 'missing ' || CASE event_type WHEN 'view' THEN 'document_id' WHEN 'click' THEN 'to' WHEN 'purchase' THEN 'image_url' ELSE 'profile_id' END END AS reason, count(*) AS k FROM events GROUP BY 1, 2"""


@query("R01_route_batch", "events", sql=_ROUTED)
def _(e):
    return K.routed(K.decode(_messages(e))).groupBy("outcome", "reason").agg(n().alias("k"))


def _run(stream, name: str, mode: str = "append", transform=None):
    """Runs a stream over all that is there, and reads what it has written."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    if transform is None:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(transform(folder)).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return folder


def _source(spark, sf_dir: str):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def _stream(name: str, sql: str | None = None):
    """Registers a query that builds a stream of the events table."""
    from .. import registry
    from ..sources.model import oracle

    def keep(f):
        def run(spark, sf_dir):
            return f(spark, _source(spark, sf_dir))

        run.__name__ = name
        registry._QUERIES[name] = run
        if sql:
            registry._SQL[name] = oracle(sql)
        return f

    return keep


@_stream("R01_route_stream", _ROUTED)
def _(spark, events):
    folder = _run(K.routed(K.decode(_messages(events))), "route", transform=lambda f: K.sink_by_outcome(f"{f}/out", ("accept", "dead_letter")))
    out = spark.read.parquet(f"{folder}/out/accept").unionByName(spark.read.parquet(f"{folder}/out/dead_letter"))
    return out.groupBy("outcome", "reason").agg(n().alias("k"))


@_stream("R02_deduplicate_stream", "SELECT count(*) AS k, count(DISTINCT event_id) AS ids FROM events")
def _(spark, events):
    m = _messages(events).select(c("event_id").cast("string").alias("id"), F.lit("q").alias("queue"), F.lit(0).alias("attempt"), "ts")
    twice = m.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    folder = _run(K.deduplicated(twice), "dedupe")
    return spark.read.parquet(f"{folder}/out").agg(n().alias("k"), F.count_distinct("id").alias("ids"))


@query("R02_idempotency_keys", "events", sql="SELECT count(*) AS k FROM (SELECT DISTINCT event_type, user_id, floor(value / 10) FROM events)")
def _(e):
    m = e.select(c("event_type").alias("queue"), c("user_id").alias("id"), F.floor(c("value") / 10).alias("attempt"))
    return K.deduplicated(m).agg(n().alias("k"))


@query("R03_R04_retry_tiers", "events", sql="""
WITH d AS (SELECT event_id, event_id % 4 + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS deaths FROM events) SELECT event_id, deaths, CASE deaths WHEN 0 THEN '5s' WHEN 1 THEN '30s' WHEN 2 THEN '2m' END AS tier FROM d""")
def _(e):
    entry = lambda q, k: F.struct(F.lit(q).alias("queue"), k.cast("bigint").alias("count"))
    headers = F.array(entry("work.retry.5s", c("event_id") % 4), entry("work.retry.30s", F.when(c("user_id") % 2 == 1, 1)), entry("work", F.lit(9)), entry("other.retry.5s", F.lit(3)))
    d = e.select("event_id", K.death_count(headers, F.lit("work")).alias("deaths"))
    return d.select("event_id", "deaths", K.retry_tier(c("deaths")).alias("tier"))


@query("R06_expired", "events", sql="""
SELECT CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'dead_letter' WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR THEN 'expired' ELSE 'accept' END AS outcome, count(*) AS k FROM events GROUP BY 1""")
def _(e):
    routed = K.routed(K.decode(_messages(e)))
    return K.expired(routed, F.lit("2024-01-20 00:00:00+00:00").cast("timestamp")).groupBy("outcome").agg(n().alias("k"))


_STATUS = "CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END"
_FINAL = f"""
WITH s AS (SELECT user_id, {_STATUS} AS status, ts, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS document_id, coalesce(arg_min(status, (ts, event_id)) FILTER (status <> 'processing'), 'processing') AS status FROM s GROUP BY user_id"""


def _results(events):
    status = F.when(c("event_type") == "purchase", "completed").when(c("event_type") == "error", "failed").otherwise("processing")
    return events.select(c("user_id").cast("string").alias("document_id"), status.alias("status"), c("ts").cast("timestamp").alias("ts"), "event_id")


@query("R07_final_status", "events", sql=_FINAL)
def _(e):
    return K.final_status(_results(e))


@query("R08_result_envelopes", "events", sql="SELECT event_type, count(*) AS k FROM events GROUP BY event_type")
def _(e):
    results = e.select(c("event_id").cast("string").alias("task_id"), c("event_type").alias("task_type"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), c("event_id").cast("string").alias("envelope_id"), c("user_id").cast("string").alias("document_id"))
    out = K.result_envelope(results)
    return out.groupBy(F.get_json_object(F.get_json_object("value", "$.payload"), "$.task_type").alias("event_type")).agg(n().alias("k"))


@query("R09_outbox_relay", "orders", "events", sql="SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events) ORDER BY o_orderkey LIMIT 100")
def _(o, e):
    return K.pending_outbox(o.select(c("o_orderkey").alias("id"), "o_orderstatus"), e.select(c("event_id").alias("id")))


@query("R11_task_routing", "events", sql="""
SELECT CASE event_type WHEN 'view' THEN 'document-processing' WHEN 'click' THEN 'email-processing' WHEN 'purchase' THEN 'image-processing' WHEN 'signup' THEN 'profile-tasks' END AS queue, count(*) AS k FROM events GROUP BY 1""")
def _(e):
    return K.routed(K.decode(_messages(e))).groupBy("queue").agg(n().alias("k"))


@query("R12_validation", "events", sql="SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 7 = 0")
def _(e):
    d = K.decode(_messages(e))
    return d.where(c("envelope").isNotNull() & K.missing_field(c("envelope.type"), c("envelope.payload")).isNotNull()).select("event_id")


@query("R13_profile_status", "events", sql="SELECT event_id, CASE event_type WHEN 'view' THEN 'synced' WHEN 'click' THEN 'validated' WHEN 'signup' THEN 'enriched' ELSE 'processed' END AS status FROM events")
def _(e):
    task = F.when(c("event_type") == "view", "sync").when(c("event_type") == "click", "validate").when(c("event_type") == "signup", "enrich").otherwise("other")
    return e.select("event_id", K.profile_status(task).alias("status"))


@query("X44_envelope_parse", "events", sql="SELECT event_id, event_type <> 'error' AS readable FROM events")
def _(e):
    return K.decode(_messages(e)).select("event_id", c("envelope.id").isNotNull().alias("readable"))
