"""Queries: rates, quantiles, alerts and assertions over sampled metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as T
from ..registry import query

c = F.col
n = lambda: F.count("*")
r6 = lambda x: F.round(x, 6)
_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]
_BUCKETS = "b AS (" + " UNION ALL ".join(f"SELECT name, {x}::DOUBLE AS le, count(*) FILTER (value <= {x}) AS count FROM samples GROUP BY name" for x in _BOUNDS) + " UNION ALL SELECT name, NULL, count(value) FROM samples GROUP BY name)"
_INC = "i AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS inc FROM samples WINDOW w AS (PARTITION BY name, label ORDER BY ts, event_id))"


@query("M01_rate", "samples", sql=f"WITH {_INC} SELECT event_id, round(sum(inc) OVER (PARTITION BY name, label ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400, 9) AS rate FROM i")
def _(s):
    return T.rate(s, ["name", "label"], 86400.0, tie="event_id").select("event_id", F.round("rate", 9).alias("rate"))


@query("M02_sum_by_label", "samples", sql="SELECT label, round(sum(value), 4) AS total FROM samples GROUP BY label")
def _(s):
    return s.groupBy("label").agg(F.round(F.sum("value"), 4).alias("total"))


@query("M03_histogram_quantile", "samples", sql=f"""
WITH {_BUCKETS}, x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(count) OVER w, 0) AS below, 0.95 * max(count) OVER (PARTITION BY name) AS rnk FROM b WINDOW w AS (PARTITION BY name ORDER BY le NULLS LAST))
SELECT name, round(min(CASE WHEN le IS NULL THEN lo ELSE lo + (le - lo) * (rnk - below) / (count - below) END), 6) AS quantile FROM x WHERE count >= rnk AND (below < rnk OR below = 0) GROUP BY name""")
def _(s):
    return T.histogram_quantile(T.bucket_counts(s, "value", _BOUNDS, ["name"]), 0.95, ["name"]).withColumn("quantile", r6("quantile"))


@query("M04_increase", "samples", sql=f"WITH {_INC} SELECT name, label, round(sum(inc), 6) AS increase FROM i GROUP BY name, label")
def _(s):
    return T.increases(s, ["name", "label"], tie="event_id").groupBy("name", "label").agg(r6(F.sum("increase")).alias("increase"))


@query("M05_label_matcher", "samples", sql="SELECT event_id FROM samples WHERE regexp_full_match(name, 'err.*|click')")
def _(s):
    return s.where(T.label_matches(c("name"), "err.*|click")).select("event_id")


@query("M06_error_ratio", "samples", sql="SELECT label, round(count(*) FILTER (name = 'error') / count(*), 6) AS ratio, count(*) FILTER (name = 'error') / count(*) > 0.005 AS alert FROM samples GROUP BY label")
def _(s):
    ratio = F.try_divide(F.count_if(c("name") == "error"), n())
    return s.groupBy("label").agg(ratio.alias("x")).select("label", r6("x").alias("ratio"), (c("x") > 0.005).alias("alert"))


@query("M07_firing_runs", "samples", sql="""
WITH o AS (SELECT *, value > 20 AS hot FROM samples), r AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT name, min(ts) AS since, max(ts) AS until, CASE WHEN epoch(max(ts)) - epoch(min(ts)) >= 3600 THEN 'firing' ELSE 'pending' END AS state FROM r WHERE hot GROUP BY name, run""")
def _(s):
    return T.firing(s, ["name"], c("value") > 20, 3600.0, tie="event_id")


@query("M08_gauge_comparison", "samples", sql="SELECT name, arg_max(value, (ts, event_id)) AS value FROM samples GROUP BY name HAVING arg_max(value, (ts, event_id)) > 5")
def _(s):
    return s.groupBy("name").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).where("value > 5")


@query("M09_max_over_time", "samples", sql="SELECT name, date_trunc('hour', ts) AS start, max(value) AS value FROM samples GROUP BY ALL")
def _(s):
    return T.over_time(s, ["name"], "1 hour", F.max("value")).withColumn("start", c("start").cast("timestamp_ntz"))


@query("M10_assertion", "samples", sql="SELECT value, value >= 1 AS passed FROM (SELECT coalesce(first(value ORDER BY ts, event_id), 0) AS value FROM samples WHERE name = 'error')")
def _(s):
    return T.assertion(s.where("name = 'error'"), ">=", 1.0, [c("ts"), c("event_id")])


@query("M11_notifications", "samples", sql="""
SELECT name || '-' || label AS name, CASE label % 3 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 3 END AS priority, CASE WHEN count(*) % 2 = 0 THEN 'white_check_mark' ELSE 'rotating_light' END AS tag, upper(CASE WHEN count(*) % 2 = 0 THEN 'resolved' ELSE 'firing' END) || ' ' || name || '-' || label AS title FROM samples s GROUP BY s.name, label""")
def _(s):
    a = s.groupBy("name", "label").agg(n().alias("k"))
    return T.notifications(a.select(F.concat_ws("-", "name", c("label").cast("string")).alias("name"), F.when(c("label") % 3 == 0, "critical").when(c("label") % 3 == 1, "warning").otherwise("other").alias("severity"), F.when(c("k") % 2 == 0, "resolved").otherwise("firing").alias("status")))


@query("A46_histogram", "samples", sql="SELECT name, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM samples GROUP BY name")
def _(s):
    return T.histogram(s, "value", ["name"]).withColumns({"sum": F.round("sum", 4), "avg": r6("avg")})


@query("A47_cumulative_buckets", "samples", sql=f"WITH {_BUCKETS} SELECT name, le, count FROM b")
def _(s):
    return T.bucket_counts(s, "value", _BOUNDS, ["name"])


@query("W08_token_window", "samples", sql="""
SELECT event_id, round(sum(k) OVER w, 6) AS in_window, sum(k) OVER w > 1.2 * 100 AS waits FROM (SELECT *, floor(value) AS k FROM samples) WINDOW w AS (PARTITION BY name ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""")
def _(s):
    calls = s.select("event_id", "name", "ts", F.floor("value").cast("double").alias("tokens"))
    return T.token_window(calls, 100.0, 3600.0, key="name").select("event_id", r6("in_window").alias("in_window"), "waits")


@query("W10_performance_trend", "samples", sql="SELECT name, label, round(avg(value), 6) AS mean, count(*) AS runs, max(ts) AS last FROM samples GROUP BY name, label")
def _(s):
    return s.groupBy("name", "label").agg(r6(F.avg("value")).alias("mean"), n().alias("runs"), F.max("ts").alias("last"))


@query("R15_windows", "samples", sql="""
SELECT 'tumbling' AS kind, name, date_trunc('day', ts) AS start, count(*) AS k FROM samples GROUP BY ALL""")
def _(s):
    return T.over_time(s, ["name"], "1 day", n()).select(F.lit("tumbling").alias("kind"), "name", c("start").cast("timestamp_ntz").alias("start"), c("value").alias("k"))
