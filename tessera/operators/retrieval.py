"""Keyword search, fusion, reranking, diversification and context building."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rerank_score

WORDS = r"([\p{L}\p{N}_]+)"


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) of all words of all documents."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 1)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def keyword_search(docs: DataFrame, query: str, k: int | None = None, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 of documents that have any word of the query, best first; all of them, or the top k.

    Only the query's words are exploded, so the shuffle holds matches alone; lengths are counted in the same scan.
    """
    import re

    wanted = sorted(set(re.findall(r"\w+", query.lower())))
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), 1)
    counted = docs.select(key, F.size(terms).alias("length"), F.filter(terms, lambda t: t.isin(*wanted) if wanted else F.lit(False)).alias("hits"))
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = counted.where(F.size("hits") > 0).select(key, "length", F.explode("hits").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # at most as many rows as the query has words, and one row of totals
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    out = s.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, weight: float = 0.5) -> DataFrame:
    """(key, score): scores of both lists, each divided by its largest, weighted and added; a missing one counts 0."""
    top = lambda hits, name: hits.crossJoin(F.broadcast(hits.agg(F.max("score").alias("_top")))).select(key, F.coalesce(F.try_divide("score", "_top"), F.lit(0.0)).alias(name))
    both = top(vector_hits, "v").join(top(keyword_hits, "t"), key, "full_outer")
    return both.select(key, F.round(weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("t", F.lit(0.0)), 9).alias("score"))


def rerank(hits: DataFrame, key: str, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), k: int | None = None) -> DataFrame:
    """Hits (score, trust_score, age_days) by their weighted score, as "final"."""
    out = hits.withColumn("final", F.round(rerank_score(F.col("score"), F.col("trust_score"), F.col("age_days"), weights), 9)).orderBy(F.desc("final"), key)
    return out.limit(k) if k else out


def diversify(hits: DataFrame, key: str, query: str = "query", score: str = "score", tags: str = "tags", balance: float = 0.7, k: int = 8, pool: int = 50) -> DataFrame:
    """(query, key, rank): hits of each query chosen one after the other, by score less the largest overlap of their first
    six tags with those chosen before. Each query's ``pool`` best hits are weighed: a limit of the feature."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    best = hits.select(query, key, F.col(score).alias("s"), F.slice(tags, 1, 6).alias("t")).withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("s"), key))).where(F.col("_n") <= pool)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        left = [(r[key], r["s"], set(r["t"]) if r["t"] is not None else set()) for r in group.sort_values("_n").to_dict("records")]
        chosen: list[tuple] = []
        overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        while left and len(chosen) < k:
            i = max(range(len(left)), key=lambda i: (balance * left[i][1] - (1 - balance) * max((overlap(left[i][2], c[2]) for c in chosen), default=0.0), -i))
            chosen.append(left.pop(i))
        return pd.DataFrame({query: [group[query].iloc[0]] * len(chosen), key: [c[0] for c in chosen], "rank": range(1, len(chosen) + 1)})

    schema = f"{query} {hits.schema[query].dataType.simpleString()}, {key} {hits.schema[key].dataType.simpleString()}, rank int"
    return best.groupBy(query).applyInPandas(pick, schema)


def bundles(hits: DataFrame, video: str = "video_id", chunk: str = "chunk_id", score: str = "score") -> DataFrame:
    """(video, best, hits, first, middle, last): hits by video, with the best score and the chunks to show."""
    place = Window.partitionBy(video).orderBy(chunk)
    size = hits.groupBy(video).agg(F.max(score).alias("best"), F.count("*").alias("hits"))
    n = hits.select(video, chunk, F.row_number().over(place).alias("i")).join(size, video)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col(chunk)))
    return n.groupBy(video, "best", "hits").agg(at(F.lit(1)).alias("first"), at(F.floor(F.col("hits") / 2) + 1).alias("middle"), at(F.col("hits")).alias("last"))


def entity_search(entities: DataFrame, pattern: str, types: list[str] | None = None, least_confidence: float = 0.0, least_trust: float | None = None, k: int = 20) -> DataFrame:
    """Entities whose name or description matches; with a least trust, those without trust are left out."""
    from ..functions.filters import search

    out = entities.where(search(pattern, "name", "description") & (F.col("confidence") >= least_confidence))
    if types:
        out = out.where(F.col("type").isin(*types))
    if least_trust is not None:
        out = out.where(F.col("trust_score") >= least_trust)
    return out.orderBy(F.col("trust_score").desc_nulls_last(), F.desc("centrality_score"), F.desc("confidence"), "entity_id").limit(k)


def graph_search(entities: DataFrame, relations: DataFrame, mentions: DataFrame, pattern: str, seeds: int = 5, related: int = 5, chunks: int = 10) -> DataFrame:
    """(kind, id, rank): seed entities by the pattern, what is one edge away by weight, and chunks that mention the most of
    both. The numbers of each are the feature's."""
    seed = entity_search(entities, pattern, k=seeds).select("entity_id")
    ends = relations.select("confidence", F.explode(F.array(F.struct(F.col("subject_id").alias("a"), F.col("object_id").alias("b")), F.struct(F.col("object_id").alias("a"), F.col("subject_id").alias("b")))).alias("x")).select("confidence", "x.a", "x.b")
    near = ends.join(F.broadcast(seed), F.col("a") == F.col("entity_id"), "left_semi").groupBy(F.col("b").alias("entity_id")).agg(F.round(F.sum("confidence"), 9).alias("w")).join(F.broadcast(seed), "entity_id", "left_anti").orderBy(F.desc("w"), "entity_id").limit(related).select("entity_id")
    wanted = seed.unionByName(near)
    said = mentions.join(F.broadcast(wanted), "entity_id", "left_semi").groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(chunks)
    return seed.select(F.lit("seed").alias("kind"), F.col("entity_id").alias("id")).unionByName(near.select(F.lit("related").alias("kind"), F.col("entity_id").alias("id"))).unionByName(said.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")))
