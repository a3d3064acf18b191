"""Query understanding, contexts and answers, enrichment and review of documents."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from .retrieval import entity_search, graph_search, keyword_search


def understood(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions with intent, keywords, and names: words with a capital that do not begin a sentence."""
    names = F.regexp_extract_all(F.col(text), F.lit(r"(?<=[\p{Ll},;] )(\p{Lu}[\p{L}\p{N}]+)"), 1)
    return questions.withColumns({"intent": T.query_intent(F.col(text)), "keywords": T.keywords(F.col(text)), "names": F.array_distinct(names)})


def rewritten(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", longest: int = 6) -> DataFrame:
    """Turns with "query": a follow-up of at most ``longest`` words takes the keywords of the turn before it along."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    short = F.size(F.split(F.trim(text), r"\s+")) <= longest
    extra = F.array_join(F.array_except(T.keywords(before), T.keywords(F.col(text))), " ")
    return turns.withColumn("query", F.when(short & before.isNotNull() & (extra != ""), F.concat_ws(" ", text, extra)).otherwise(F.col(text)))


def retrieve(docs: DataFrame, query: str, mode: str = "keyword", vector_hits: DataFrame | None = None, filtered: bool = False, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, score) by mode: hybrid where there are vectors and no filter, keyword, or else the vector hits."""
    from .retrieval import hybrid

    words = lambda: keyword_search(docs, query, k, key)
    if mode == "hybrid" and vector_hits is not None and not filtered:
        return hybrid(vector_hits, words(), key).orderBy(F.desc("score"), key).limit(k)
    if mode == "keyword" or vector_hits is None:
        return words()
    return vector_hits.orderBy(F.desc("score"), key).limit(k)


def graph_query(entities: DataFrame, relations: DataFrame, mentions: DataFrame, pattern: str, mode: str = "hybrid", texts: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(kind, id) of a graph query: what the graph search finds; in the mode "hybrid" also the k best texts by keywords.
    The modes "local" and "global" find the same; an unknown mode or a blank pattern is an error."""
    if mode not in ("local", "global", "hybrid"):
        raise ValueError(f"no mode {mode}")
    if not pattern.strip():
        raise ValueError("a query needs a text")
    found = graph_search(entities, relations, mentions, pattern)
    if mode != "hybrid" or texts is None:
        return found
    return found.unionByName(keyword_search(texts, pattern, k).select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("id")))


def context(hits: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 4000) -> DataFrame:
    """One row (context, sources): texts of the hits, best first, until ``letters`` are used. The hits are a top-k list."""
    near = docs.select(key, F.col(text).alias("t")).join(F.broadcast(hits), key)
    run = F.sum(F.length("t")).over(Window.orderBy(F.desc("score"), key).rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("n", run).where(F.col("n") - F.length("t") < letters)
    both = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), "t")))
    return kept.agg(both.alias("x")).select(F.substring(F.array_join(F.transform("x", lambda r: r["t"]), "\n\n"), 1, letters).alias("context"), F.transform("x", lambda r: r["k"]).alias("sources"))


def graph_steps(entities: DataFrame, relations: DataFrame, mentions: DataFrame, pattern: str, seeds: int = 5, edges: int = 100, groups: int = 10) -> DataFrame:
    """(step, found) of a simulated query: seeds, their relations by confidence, entities reached, communities, chunks. The
    numbers kept at each step are the feature's."""
    seed = entity_search(entities, pattern, k=seeds).select("entity_id")
    ends = lambda end: relations.join(F.broadcast(seed.withColumnRenamed("entity_id", end)), end, "left_semi")
    # a relation with two seeds is found from its subject alone
    both = ends("object_id").join(F.broadcast(seed.withColumnRenamed("entity_id", "subject_id")), "subject_id", "left_anti").select(*relations.columns)
    near = ends("subject_id").select(*relations.columns).unionByName(both).orderBy(F.desc("confidence"), "subject_id", "object_id", "predicate").limit(edges)
    reached = near.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).unionByName(seed).distinct()
    said = mentions.join(F.broadcast(reached), "entity_id", "left_semi")
    top = said.groupBy("video_id").agg(F.count_distinct("entity_id").alias("n")).orderBy(F.desc("n"), "video_id").limit(groups)
    parts = [("extraction", seed), ("search", near), ("traversal", reached), ("community", top), ("assembly", said.select("chunk_id").distinct())]
    out = None
    for i, (name, df) in enumerate(parts, 1):
        one = df.agg(F.count("*").alias("found")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "found")
        out = one if out is None else out.unionAll(one)
    return out


def answer_confidence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", S.answer_confidence(F.col("entities"), F.col("communities"), F.col("length")))


def community_summaries(members: DataFrame, relations: DataFrame, entities: DataFrame, group: str = "community", most_entities: int = 20, most_relations: int = 30) -> DataFrame:
    """(group, summary): a text of a community's foremost entities and relations, which a model can rewrite; how many of
    each is the feature's."""
    e = members.join(entities.select("entity_id", "name", "type", "confidence", "source_count"), "entity_id")
    order = Window.partitionBy(group).orderBy(F.desc(F.col("confidence") * F.col("source_count")), "entity_id")
    top = e.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most_entities).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "type"))), lambda x: F.concat(x["name"], F.lit(" ("), x["type"], F.lit(")"))), ", ").alias("who"))
    side = lambda end: members.select(F.col("entity_id").alias(end), F.col(group).alias(f"_{end}"))
    inside = relations.join(side("subject_id"), "subject_id").join(side("object_id"), "object_id").where(F.col("_subject_id") == F.col("_object_id"))
    rank = Window.partitionBy("_subject_id").orderBy(F.desc("confidence"), "subject_id", "object_id", "predicate")
    said = inside.withColumn("i", F.row_number().over(rank)).where(F.col("i") <= most_relations).groupBy(F.col("_subject_id").alias(group)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "subject_id", "predicate", "object_id"))), lambda x: F.concat_ws(" ", x["subject_id"], x["predicate"], x["object_id"])), "; ").alias("what"))
    return top.join(said, group, "left").select(group, F.concat(F.lit("Entities: "), "who", F.when(F.col("what").isNotNull(), F.concat(F.lit(". Relations: "), "what")).otherwise("")).alias("summary"))


# Types that an extraction may name; all others are Other.
ENTITY_TYPES = ("Person", "Organization", "Technology", "Concept", "Location", "Event", "Other")


def normalised_payload(payload: Column) -> Column:
    """Entities of an extraction: trimmed names, known types, relevance from 0 to 1; without nameless ones."""
    def one(e: Column) -> Column:
        kind = F.initcap(F.trim(F.coalesce(e["type"], F.lit(""))))
        return F.struct(F.trim(e["name"]).alias("name"), F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("Other").alias("type"), S.clamp(F.coalesce(e["relevance"].cast("double"), F.lit(0.0)), 0.0, 1.0).alias("relevance"))

    return F.filter(F.transform(payload, one), lambda e: F.coalesce(e["name"], F.lit("")) != "")


def enrichment_quality(entities: Column, concepts: Column, relations: Column) -> Column:
    """struct(score, level): means of three lists of numbers weighted .4, .4 and .2 over those that are not empty."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    parts = [(entities, 0.4), (concepts, 0.4), (relations, 0.2)]
    there = [F.coalesce(F.size(a), F.lit(0)) > 0 for a, _ in parts]
    total = sum((F.when(t, w).otherwise(0.0) for t, (_, w) in zip(there, parts)), F.lit(0.0))
    value = F.coalesce(F.try_divide(sum((F.when(t, w * mean(a)).otherwise(0.0) for t, (a, w) in zip(there, parts)), F.lit(0.0)), total), F.lit(0.0))
    return F.struct(value.alias("score"), F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low").alias("level"))


def embedding_text(summary: Column, entities: Column, concepts: Column, text: Column) -> Column:
    """What is embedded of a chunk: its summary, three entities, three concepts and its text."""
    listed = lambda name, a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(a, 1, 3), ", ")))
    return F.concat_ws("\n", F.nullif(summary, F.lit("")), listed("Entities", entities), listed("Concepts", concepts), F.nullif(text, F.lit("")))


def pruned_catalog(values: DataFrame, query_words: list[str], keep: int = 20, least: float = 0.3) -> DataFrame:
    """(value, score): catalog values (value, n) by their best match with any of the words and up to .2 for frequency; the
    most frequent ones where none matches. The words are a driver-side list."""
    top = values.agg(F.max("n").alias("top"))
    best = F.greatest(F.lit(0.0), *[T.fuzzy_match_score(F.lit(w), F.col("value")) for w in query_words]) if query_words else F.lit(0.0)
    scored = values.crossJoin(F.broadcast(top)).withColumn("match", best).withColumn("score", F.round(F.when(F.col("match") >= least, F.col("match") + 0.2 * F.col("n") / F.col("top")).otherwise(0.0), 9))
    any_ = scored.agg(F.max(F.col("score") > 0).alias("any"))
    kept = scored.crossJoin(F.broadcast(any_)).where(~F.col("any") | (F.col("score") > 0))
    return kept.orderBy(F.desc("score"), F.desc("n"), "value").limit(keep).select("value", "score")


def issues(chunks: DataFrame) -> DataFrame:
    """(chunk_id, issue): low trust, failed stages, and texts that cite what they do not have."""
    rules = {"low_trust": F.col("trust") < 0.6, "failed_extraction": F.col("extraction") == "failed", "failed_resolution": F.col("resolution") == "failed", "citation": F.col("text").rlike(r"\[\d+\]|\(\d{4}\)")}
    hits = F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return chunks.select("chunk_id", F.explode(hits).alias("issue"))


def document_diff(pairs: DataFrame, old: str = "old", new: str = "new", most: int = 50) -> DataFrame:
    """Pairs with "ratio" of their lines' similarity and "changes" (tag, old lines, new lines), at most ``most``: the limit
    of the feature."""

    def run(parts):
        for part in parts:
            ratio, changes = [], []
            for a, b in zip(part[old].fillna(""), part[new].fillna("")):
                x, y = a.split("\n"), b.split("\n")
                m = SequenceMatcher(None, x, y, autojunk=False)
                ratio.append(m.ratio())
                changes.append([{"tag": t, "old_lines": i2 - i1, "new_lines": j2 - j1} for t, i1, i2, j1, j2 in m.get_opcodes() if t != "equal"][:most])
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame({"ratio": ratio, "changes": changes})], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{schema}, ratio double, changes array<struct<tag:string,old_lines:int,new_lines:int>>")
