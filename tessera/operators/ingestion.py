"""Composite stages over texts: compression and enrichment, each with a model or without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import text as T
from ..providers import Model, complete
from . import answers as A
from .chunking import packed_units, paragraphs


def compressed(rows: DataFrame, model: Model | None = None, key: str = "video_id", text: str = "transcript", limit: int = 4000, tidy: bool = True) -> DataFrame:
    """(key, units, compressed_text, ratio): texts in units of whole paragraphs of at most ``limit`` letters, each rewritten
    by the model if there is one, put together again in order and tidied; ratio is what is left of the letters.

    Null and blank texts, and texts of which nothing is left, give no row. Keys are taken to be unique. Without a model
    nothing is shuffled.
    """
    some = rows.where(~FL.missing(F.trim(F.col(text)))).select(key, F.length(text).alias("n"), packed_units(paragraphs(F.col(text)), limit).alias("units"))
    if model is None:
        whole = some.select(key, "n", F.size("units").alias("units"), F.array_join("units", "\n").alias("t"))
    else:
        parts = some.select(key, "n", F.posexplode("units").alias("i", "unit"))
        told = complete(parts, F.col("unit"), model, "said").groupBy(key, "n").agg(F.count("*").cast("int").alias("units"), F.array_sort(F.collect_list(F.struct("i", "said"))).alias("x"))
        whole = told.select(key, "n", "units", F.array_join(F.transform("x", lambda r: r["said"]), "\n").alias("t"))
    out = whole.withColumn("t", T.compressed_text(F.col("t"))) if tidy else whole
    return out.where(F.col("t") != "").select(key, "units", F.col("t").alias("compressed_text"), (F.length("t") / F.col("n")).alias("ratio"))


#: What an enrichment answers of a chunk.
PAYLOAD = "summary string, entities array<struct<name:string,type:string,relevance:double>>, concepts array<struct<name:string,confidence:double>>, relations array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def enriched(chunks: DataFrame, answer: Column, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, status, summary, entities, concepts, relations, quality, embedding_text) of chunks with a JSON answer each.

    An answer that is null or no JSON object of PAYLOAD's shape fails the chunk: its lists are empty and its quality is 0.
    Names are trimmed, nameless entities go, unknown types become Other, and relevance lies between 0 and 1.
    """
    parsed = chunks.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.from_json(answer, PAYLOAD).alias("p"))
    read = F.coalesce(F.col("p.summary").isNotNull() | F.col("p.entities").isNotNull(), F.lit(False))
    listed = lambda name, kind: F.coalesce(F.col(f"p.{name}"), F.array().cast(kind))
    e = A.normalised_payload(listed("entities", "array<struct<name:string,type:string,relevance:double>>"))
    concepts = listed("concepts", "array<struct<name:string,confidence:double>>")
    relations = listed("relations", "array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    flat = parsed.select(key, "_text", F.when(read, "completed").otherwise("failed").alias("status"), F.col("p.summary").alias("summary"), e.alias("entities"), concepts.alias("concepts"), relations.alias("relations"))
    numbers = lambda a, field: F.transform(a, lambda x: F.coalesce(x[field], F.lit(0.0)))
    score = A.enrichment_quality(numbers("entities", "relevance"), numbers("concepts", "confidence"), numbers("relations", "confidence"))
    names = lambda a: F.transform(a, lambda x: x["name"])
    return flat.select(key, "status", "summary", "entities", "concepts", "relations", score.alias("quality"), A.embedding_text(F.coalesce("summary", F.lit("")), names("entities"), names("concepts"), F.col("_text")).alias("embedding_text"))


def enriched_by(chunks: DataFrame, prompt: Column, model: Model, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """enriched() of chunks by a model's answers to a prompt each; blank chunks are not asked about."""
    return enriched(complete(chunks.where(~FL.missing(F.trim(F.col(text)))).select(key, text, prompt.alias("prompt")), F.col("prompt"), model, "answer"), F.col("answer"), key, text)
