"""Rollups, pages, windows and set operations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """(key, count), most frequent first; ``top`` for a top-k report."""
    out = rows.groupBy(key).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), key).limit(top) if top else out


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page whose rows also say how many rows there are, and whether more follow. The total is one row, broadcast."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, order, offset, limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def first_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(rows: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def degrees(edges: DataFrame, src: str = "subject_id", dst: str = "object_id") -> DataFrame:
    """(entity_id, degree): edges that begin or end at it. Both ends come from one scan."""
    return edges.select(F.explode(F.array(src, dst)).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))


def merge(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The target with changes by key: changed columns win, unmatched changes are inserted."""
    names = [c for c in target.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in key], F.lit(True).alias("_hit"))
    joined = target.join(new, key, "full_outer")
    return joined.select(*key, *[(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if f"_new_{c}" in new.columns else F.col(c)).alias(c) for c in names])


def insert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a unique index on ``key`` would accept: not in the target, and one of each key."""
    return rows.join(target.select(*key), key, "left_anti").dropDuplicates(key)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """The target without the rows for which the condition holds; rows for which it is null stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def flatten(rows: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as top-level columns, with the path as name."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return rows.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(rows.schema, ())])


def schema_profile(rows: DataFrame) -> DataFrame:
    """(field, type, nulls, longest): one scan of the rows, then a row a field."""
    longest = lambda f: F.max(F.length(F.col(f.name))) if f.dataType.typeName() == "string" else F.lit(None).cast("int")
    one = rows.agg(*[F.struct(F.lit(f.dataType.simpleString()).alias("type"), F.count_if(F.col(f.name).isNull()).alias("nulls"), longest(f).alias("longest")).alias(f.name) for f in rows.schema.fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"{f.name}.type"), F.col(f"{f.name}.nulls"), F.col(f"{f.name}.longest").cast("long").alias("longest")) for f in rows.schema.fields])).alias("x")).select("x.*")
