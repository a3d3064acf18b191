"""Time-series operators of the metrics layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def increases(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Samples with "increase" over the one before in its series; a fall is a reset, and counts from zero. The first has none."""
    w = Window.partitionBy(*keys).orderBy(ts, *([tie] if tie else []))
    before = F.lag(value).over(w)
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def rate(samples: DataFrame, keys: list[str], window: float, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Samples with "rate": the increase of the last ``window`` seconds, a second. Windows are not extrapolated to their edges."""
    w = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-int(window * 1_000_000), 0)
    inc = increases(samples, keys, ts, value, tie)
    return inc.withColumn("rate", F.sum("increase").over(w) / window)


def over_time(samples: DataFrame, keys: list[str], step: str, how: Column, ts: str = "ts") -> DataFrame:
    """One row a series and step: (keys, start, value) of an aggregate over tumbling windows."""
    return samples.groupBy(*keys, F.window(ts, step).alias("w")).agg(how.alias("value")).select(*keys, F.col("w.start").alias("start"), "value")


def bucket_counts(rows: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, le, count): cumulative counts of values up to each bound, the bound included, and of all (le null)."""
    keys = keys or []
    one = rows.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("count")))
    return one.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.le", "x.count")


def histogram_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """(keys, quantile): linear inside the bucket in which it falls, from 0 in the lowest; beyond the last bound, that bound."""
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    total = F.max("count").over(Window.partitionBy(*keys))
    b = buckets.withColumns({"lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("count").over(w), F.lit(0)), "rank": total * q})
    hit = b.where((F.col("count") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("below") == 0)))
    value = F.when(F.col("le").isNull(), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(F.col("rank") - F.col("below"), F.col("count") - F.col("below")))
    return hit.groupBy(*keys).agg(F.min(value).alias("quantile"))


def histogram(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, count, sum, min, max, avg)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))


def label_matches(x: Column, pattern: str) -> Column:
    """A label matcher: the pattern has to match all of the label."""
    return F.coalesce(x, F.lit("")).rlike(f"^(?:{pattern})$")


def firing(samples: DataFrame, keys: list[str], condition: Column, hold: float, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """(keys, since, until, state): runs of samples for which the condition holds; firing if they last ``hold`` seconds."""
    order = [ts, *([tie] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    on = F.coalesce(condition, F.lit(False))
    runs = samples.withColumn("_on", on).withColumn("_run", F.sum(F.when(on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_on")
    spans = runs.groupBy(*keys, "_run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    return spans.select(*keys, "since", "until", F.when(seconds("until") - seconds("since") >= hold, "firing").otherwise("pending").alias("state"))


def notifications(alerts: DataFrame) -> DataFrame:
    """(name, priority, tag, title) of (name, severity, status)."""
    # Priorities by severity and tags by status.
    priority = F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "warning", 4).when(F.col("severity") == "info", 2).otherwise(3)
    return alerts.select("name", priority.alias("priority"), F.when(F.col("status") == "resolved", "white_check_mark").otherwise("rotating_light").alias("tag"), F.concat_ws(" ", F.upper("status"), "name").alias("title"))


def assertion(samples: DataFrame, op: str, expected: float, order: list[Column]) -> DataFrame:
    """One row (value, passed): the first sample, 0 if there is none, against what is expected."""
    from ..functions.scores import compare

    first = samples.orderBy(*order).limit(1).agg(F.coalesce(F.first("value"), F.lit(0.0)).alias("value"))
    return first.select("value", compare(F.lit(op), F.col("value"), F.lit(float(expected))).alias("passed"))


def token_window(calls: DataFrame, target: float, window: float = 60.0, slack: float = 1.2, ts: str = "ts", key: str = "model") -> DataFrame:
    """Calls with the tokens of the last ``window`` seconds, themselves included, and whether they had to wait: above the
    slack over the target. Every call counts once."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-int(window * 1_000_000), 0)
    return calls.withColumn("in_window", F.sum("tokens").over(w)).withColumn("waits", F.col("in_window") > slack * target)
