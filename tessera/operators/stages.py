"""Status columns of pipeline stages: what is pending, done, failed, and how far a pipeline has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, before: str, stage: str, exclude: str | None = None) -> DataFrame:
    """Rows whose stage before is completed and whose own is not; a null status is not completed."""
    out = rows.where((F.col(before) == "completed") & ~F.col(stage).eqNullSafe("completed"))
    return out.where(~F.coalesce(F.col(exclude), F.lit(False))) if exclude else out


def progress(rows: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, total, completed, failed, pending, completion_rate, failure_rate) in one scan."""
    done = lambda s, v: F.count_if(F.col(s).eqNullSafe(v))
    one = rows.agg(F.count("*").alias("total"), *[F.struct(done(s, "completed").alias("completed"), done(s, "failed").alias("failed"), done(s, "skipped").alias("skipped")).alias(s) for s in stages])
    flat = one.select("total", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}.completed"), F.col(f"{s}.failed"), F.col(f"{s}.skipped")) for s in stages])).alias("x"))
    t = F.col("total")
    return flat.select("x.stage", "total", "x.completed", "x.failed", (t - F.col("x.completed") - F.col("x.failed") - F.col("x.skipped")).alias("pending"), F.try_divide("x.completed", t).alias("completion_rate"), F.try_divide("x.failed", t).alias("failure_rate"))


def resume_plan(rows: DataFrame, stages: list[str], enough: float = 0.95) -> DataFrame:
    """(stage, completion_rate, run): a stage runs unless enough of its rows are completed."""
    return progress(rows, stages).select("stage", F.coalesce("completion_rate", F.lit(0.0)).alias("completion_rate"), (F.coalesce("completion_rate", F.lit(0.0)) < enough).alias("run"))


def set_status(rows: DataFrame, stage: str, status: str, condition) -> DataFrame:
    """One set-based update of a status column."""
    return rows.withColumn(stage, F.when(F.coalesce(condition, F.lit(False)), status).otherwise(F.col(stage)))


def clear_status(rows: DataFrame, stage: str, status: str | None = "failed") -> DataFrame:
    """The status reset to null where it is ``status``, or everywhere."""
    return rows.withColumn(stage, F.when(F.col(stage) == status, None).otherwise(F.col(stage)) if status else F.lit(None).cast("string"))
