"""The data model over the base tables, as SQL that Spark and DuckDB both run.

Entities are parts and suppliers, relations are what lineitem says of a supplier and a part, mentions are parts in
orders, videos and chunks are documents, stage statuses and metric samples are events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "entities": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS entity_id, p_name AS name, lower(trim(p_name)) AS canonical_name,
               CASE p_size % 7 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'TECHNOLOGY' WHEN 3 THEN 'CONCEPT' WHEN 4 THEN 'LOCATION' WHEN 5 THEN 'EVENT' ELSE 'OTHER' END AS type,
               p_type || ' ' || p_brand AS description, CAST(p_partkey % 71 + 29 AS DOUBLE) / 100 AS confidence, CAST(p_size AS BIGINT) AS source_count,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 97 AS DOUBLE) / 97 END AS trust_score, CAST(p_partkey % 89 AS DOUBLE) / 89 AS centrality_score
        FROM part
        UNION ALL
        SELECT 's' || CAST(s_suppkey AS STRING), s_name, lower(trim(s_name)), 'ORGANIZATION', 'supplier of nation ' || CAST(s_nationkey AS STRING),
               CAST(s_suppkey % 71 + 29 AS DOUBLE) / 100, CAST(s_nationkey AS BIGINT), CAST(s_suppkey % 97 AS DOUBLE) / 97, CAST(s_suppkey % 89 AS DOUBLE) / 89
        FROM supplier""",
    "relation_rows": """
        SELECT 's' || CAST(l_suppkey AS STRING) AS subject_id, 'p' || CAST(l_partkey AS STRING) AS object_id,
               CASE l_returnflag WHEN 'A' THEN 'uses' WHEN 'N' THEN 'part_of' ELSE 'related_to' END AS predicate,
               CAST(l_quantity AS DOUBLE) / 50 AS confidence, 'o' || CAST(l_orderkey AS STRING) AS chunk_id, l_linenumber AS position,
               l_linestatus || ' ' || CAST(l_linenumber AS STRING) AS description
        FROM lineitem""",
    "relations": """
        SELECT subject_id, object_id, predicate, max(confidence) AS confidence, count(*) AS source_count, min(chunk_id) AS first_chunk
        FROM relation_rows GROUP BY subject_id, object_id, predicate""",
    "mentions": """
        SELECT 'p' || CAST(l_partkey AS STRING) AS entity_id, 'o' || CAST(l_orderkey AS STRING) AS chunk_id, 'c' || CAST(o_custkey AS STRING) AS video_id,
               1 - CAST(l_discount AS DOUBLE) AS confidence, l_linenumber AS position, o_orderdate AS said_at, l_orderkey AS chunk_number
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "videos": """
        SELECT doc_id AS video_id, 'Video ' || CAST(doc_id AS STRING) AS title, lang AS channel_id, source AS playlist_id, n_chars AS view_count, n_chars % 97 AS like_count, n_chars % 13 AS comment_count,
               n_chars % 7200 AS duration_seconds, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS transcript, 2023 + doc_id % 2 AS published_year, 1 + doc_id % 12 AS published_month, text
        FROM documents""",
    "chunks": """
        SELECT d.doc_id AS chunk_id, source AS video_id, lang AS channel_id, text, n_chars, quality, toxic,
               CASE WHEN doc_id % 10 < 6 THEN 'completed' WHEN doc_id % 10 < 7 THEN 'failed' WHEN doc_id % 10 < 8 THEN 'skipped' ELSE NULL END AS extraction,
               CASE WHEN doc_id % 10 < 4 THEN 'completed' WHEN doc_id % 10 < 5 THEN 'failed' ELSE NULL END AS resolution,
               CASE WHEN doc_id % 10 < 3 THEN 'completed' ELSE NULL END AS construction,
               CAST(n_chars % 730 AS DOUBLE) AS age_days, CAST(n_chars % 101 AS DOUBLE) / 101 AS redundancy_score, n_chars % 4 = 0 AS is_redundant, n_chars % 3 = 0 AS code_present, CAST(n_chars % 37 AS DOUBLE) / 37 AS engagement_norm
        FROM documents d LEFT JOIN (SELECT doc_id AS label_id, quality, toxic FROM labels) l ON d.doc_id = l.label_id""",
    "samples": """
        SELECT event_type AS name, user_id AS label, ts, value, event_id FROM events""",
}


def needs(sql: str) -> list[str]:
    """The views that a query uses, each after those that it builds on."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in found and VIEWS[name] is not text:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it uses as leading CTEs."""
    sql = sql.strip()
    parts = [f"{name} AS ({VIEWS[name]})" for name in needs(sql)]
    if not parts:
        return sql
    if re.match(r"WITH RECURSIVE\b", sql, re.I):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql[len("WITH RECURSIVE") :]
    if re.match(r"WITH\b", sql, re.I):
        return "WITH " + ", ".join(parts) + ", " + sql[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view of the model. Views are planned with the tables passed as arguments, not by global names."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = {n: view(spark, sf_dir, n) for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b(FROM|JOIN) {n}\b", sql)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **used)
