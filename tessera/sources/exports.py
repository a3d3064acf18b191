"""Exports of graphs and chats: lines for text writers, and writers that leave the folder to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape


def graphml_nodes(entities: DataFrame) -> DataFrame:
    return entities.select(F.concat(F.lit('<node id="'), xml_escape(F.col("entity_id")), F.lit('"><data key="name">'), xml_escape(F.coalesce("name", F.lit(""))), F.lit("</data></node>")).alias("line"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), xml_escape(F.col("subject_id")), F.lit('" target="'), xml_escape(F.col("object_id")), F.lit('"><data key="predicate">'), xml_escape(F.col("predicate")), F.lit("</data></edge>")).alias("line"))


def gexf_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), xml_escape(F.col("subject_id")), F.lit('" target="'), xml_escape(F.col("object_id")), F.lit('" weight="'), F.col("confidence").cast("string"), F.lit('"/>')).alias("line"))


def write_node_link_json(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as JSON lines in two folders."""
    entities.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumnsRenamed({"subject_id": "source", "object_id": "target"}).write.mode("overwrite").json(f"{path}/links")


def write_csv(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as CSV with headers in two folders; arrays become text joined by semicolons."""
    flat = lambda df: df.select(*[F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])
    flat(entities).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    flat(edges).write.mode("overwrite").option("header", True).csv(f"{path}/links")


def chat_lines(turns: DataFrame, form: str = "json") -> DataFrame:
    """(conv_id, turn, line) of chat turns as json, txt or md; any other form is json."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    line = {"txt": F.concat(F.upper(role), F.lit(": "), text), "md": F.concat(F.lit("**"), F.initcap(role), F.lit("**\n\n"), text)}.get(form, F.to_json(F.struct(role.alias("role"), text.alias("content"))))
    return turns.select("conv_id", "turn", line.alias("line"))


def prometheus_lines(samples: DataFrame) -> DataFrame:
    """Text exposition lines of (name, labels: map, value), labels in order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return samples.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))
