"""Reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; on a local master, as in tests, a temporary folder where none is set."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        got = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(got)
    return got


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and read from the shared folder from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
