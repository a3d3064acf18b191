"""Validation rules: Columns that are true where a row is valid, and the table of what violates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_between(x: Column, low: int = 0, high: int | None = None) -> Column:
    n = F.length(F.coalesce(x, F.lit("")))
    return (n >= low) if high is None else (n >= low) & (n <= high)


def matches(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(pattern), F.lit(False))


def within(x: Column, low: float, high: float) -> Column:
    return F.coalesce(x.between(low, high), F.lit(False))


def not_empty(x: Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with a column "rule", once for every rule that they break; any Column makes a rule."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(broken))
