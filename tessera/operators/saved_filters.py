"""Saved filters as a table (filter_id, name, spec: JSON, uses): each change gives the table as it is afterwards."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import validate_filter

COLUMNS = ["filter_id", "name", "spec", "uses"]


def create(filters: DataFrame, filter_id: str, name: str, spec: dict[str, Any]) -> DataFrame:
    """With a new filter that was never used; an invalid one is refused, and one whose id is there already is not added."""
    if wrong := validate_filter(spec):
        raise ValueError("; ".join(wrong))
    new = filters.sparkSession.createDataFrame([(filter_id, name, json.dumps(spec, sort_keys=True), 0)], "filter_id string, name string, spec string, uses long")
    return filters.select(*COLUMNS).unionByName(new.join(filters.select("filter_id"), "filter_id", "left_anti").select(*COLUMNS))


def _change(filters: DataFrame, which: Column, **values: Column) -> DataFrame:
    return filters.select(*[(F.when(which, values[n]).otherwise(F.col(n)) if n in values else F.col(n)).alias(n) for n in COLUMNS])


def update(filters: DataFrame, filter_id: str, name: str | None = None, spec: dict[str, Any] | None = None) -> DataFrame:
    """With another name or specification; an invalid one is refused, and an unknown id changes nothing."""
    if spec is not None and (wrong := validate_filter(spec)):
        raise ValueError("; ".join(wrong))
    values = {"name": F.lit(name)} if name is not None else {}
    if spec is not None:
        values["spec"] = F.lit(json.dumps(spec, sort_keys=True))
    return _change(filters, F.col("filter_id") == filter_id, **values)


def delete(filters: DataFrame, filter_id: str) -> DataFrame:
    return filters.select(*COLUMNS).where(F.col("filter_id") != filter_id)


def duplicate(filters: DataFrame, filter_id: str, copy_id: str) -> DataFrame:
    """With a copy under another id, named as one and never used."""
    own = filters.select(*COLUMNS)
    made = own.where(F.col("filter_id") == filter_id).select(F.lit(copy_id).alias("filter_id"), F.concat("name", F.lit(" (copy)")).alias("name"), "spec", F.lit(0).cast("long").alias("uses"))
    return own.unionByName(made.join(own.select("filter_id"), "filter_id", "left_anti").select(*COLUMNS))


def used(filters: DataFrame, filter_id: str) -> DataFrame:
    """With one more use of a filter."""
    return _change(filters, F.col("filter_id") == filter_id, uses=F.col("uses") + 1)
