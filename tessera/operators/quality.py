"""Quality metrics of graphs, communities and runs, and the rules that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a healthy graph's metrics lie between.
HEALTHY = {"merge_rate": (0.1, 0.6), "coverage": (0.7, 1.0), "modularity": (0.3, 1.0), "singleton_rate": (0.0, 0.3), "avg_degree": (1.0, 20.0), "density": (0.0, 0.3)}


def index_percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with sorted[int(n * share)] for each name.

    Ranks are running counts of distinct values, so what is sorted in one task is a value each, not a row each; integer
    sizes and rounded metrics have few.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    at = lambda s: F.least(F.floor(F.col("t") * s), F.col("t") - 1)
    return upto.agg(*[F.min(F.when(F.col("upto") > at(s), F.col("v"))).alias(name) for name, s in shares.items()])


def extraction_quality(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: relations a chunk, distinct predicates a relation, types of entities used out of five, mean confidence."""
    r = relations.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("predicate").alias("predicates"), F.avg("confidence").alias("confidence"))
    t = entities.agg(F.count_distinct("type").alias("types"))
    return r.crossJoin(F.broadcast(t)).select((F.col("n") / F.col("chunks")).alias("relations_per_chunk"), (F.col("predicates") / F.col("n")).alias("predicate_diversity"), F.least(F.lit(1.0), F.col("types") / 5).alias("type_coverage"), "confidence")


def resolution_quality(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: the share of raw entities that merging removed, and resolved to raw mean confidence."""
    a = raw.agg(F.count("*").alias("raw"), F.avg("confidence").alias("c0"))
    b = resolved.agg(F.count("*").alias("resolved"), F.avg("confidence").alias("c1"))
    return a.crossJoin(F.broadcast(b)).select("raw", "resolved", F.try_divide(F.col("raw") - F.col("resolved"), F.col("raw")).alias("merge_rate"), F.try_divide("c1", "c0").alias("confidence_preservation"))


def construction_quality(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: directed density, mean degree, and what the degrees look like."""
    from .relational import degrees

    d = vertices.select("entity_id").join(degrees(edges), "entity_id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    v = d.agg(F.count("*").alias("n"), F.avg("degree").alias("mean"), F.max("degree").alias("top"), F.stddev_pop("degree").alias("sd"))
    m = edges.agg(F.count("*").alias("m"))
    kind = F.when(F.col("top") > 10 * F.col("mean"), "power_law").when(F.col("sd") < F.col("mean"), "random").otherwise("small_world")
    return v.crossJoin(F.broadcast(m)).select((F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"), F.col("mean").alias("avg_degree"), kind.alias("degree_type"))


def community_sizes(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.count_distinct("entity_id").alias("size"))


def detection_quality(members: DataFrame, vertices: DataFrame, group: str = "community") -> DataFrame:
    """One row: communities, mean, middle and 95 % size by index, singletons, and the share of entities covered."""
    sizes = community_sizes(members, group)
    one = sizes.agg(F.count("*").alias("communities"), F.avg("size").alias("avg_size"), F.try_divide(F.count_if(F.col("size") == 1), F.count("*")).alias("singleton_rate"), F.max("size").alias("largest"))
    cover = members.select("entity_id").distinct().agg(F.count("*").alias("covered"))
    all_ = vertices.agg(F.count("*").alias("n"))
    p = index_percentiles(sizes, "size", {"p50_size": 0.5, "p95_size": 0.95})
    return one.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(all_)).select("communities", "avg_size", "p50_size", "p95_size", "singleton_rate", "largest", F.try_divide("covered", "n").alias("coverage"))


def quality_gates(metrics: DataFrame, modularity: Column | None = None) -> DataFrame:
    """(gate, passed): modularity of .3, coverage of .7, at most 5000 members, at most .3 singletons."""
    gates = [("coverage", F.col("coverage") >= 0.7), ("size", F.col("largest") <= 5000), ("singletons", F.col("singleton_rate") <= 0.3)]
    if modularity is not None:
        gates.append(("modularity", modularity >= 0.3))
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), ok.alias("passed")) for n, ok in gates])).alias("x")).select("x.*")


def coherence(members: DataFrame, entities: DataFrame, edges: DataFrame, group: str = "community") -> DataFrame:
    """(group, coherence): .4 of the share of linked pairs, .3 of the mean confidence of members and .3 of that of links;
    0 for a single member, 1 at most."""
    m = members.select(group, "entity_id").distinct()
    e = m.join(entities.select("entity_id", "confidence"), "entity_id").groupBy(group).agg(F.count("*").alias("n"), F.avg("confidence").alias("ec"))
    left, right = m.select(group, F.col("entity_id").alias("subject_id")), m.select(F.col(group).alias("_g"), F.col("entity_id").alias("object_id"))
    inside = edges.join(left, "subject_id").join(right, "object_id").where(F.col(group) == F.col("_g")).groupBy(group).agg(F.count("*").alias("links"), F.avg("confidence").alias("rc"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    value = F.least(F.lit(1.0), 0.4 * F.coalesce("links", F.lit(0)) / pairs + 0.3 * F.col("ec") + 0.3 * F.coalesce("rc", F.lit(0.0)))
    return e.join(inside, group, "left").select(group, F.when(F.col("n") <= 1, 0.0).otherwise(value).alias("coherence"))


def size_bands(sizes: DataFrame) -> DataFrame:
    """(band, count): of at most 2, at most 5, and more members."""
    return sizes.groupBy(F.when(F.col("size") <= 2, "small").when(F.col("size") <= 5, "medium").otherwise("large").alias("band")).agg(F.count("*").alias("count"))


def unpivoted(metrics: DataFrame) -> DataFrame:
    """(name, value, low, high, in_range) of all numeric columns of one row, with their healthy range if there is one."""
    numeric = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    flat = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in numeric])).alias("x")).select("x.*")
    low = F.create_map(*[F.lit(x) for k, v in HEALTHY.items() for x in (k, v[0])])
    high = F.create_map(*[F.lit(x) for k, v in HEALTHY.items() for x in (k, v[1])])
    out = flat.withColumns({"low": F.try_element_at(low, F.col("name")), "high": F.try_element_at(high, F.col("name"))})
    return out.withColumn("in_range", F.when(F.col("low").isNotNull(), F.col("value").between(F.col("low"), F.col("high"))))


def trend(rows: DataFrame, value: str, at: str, cutoff: Column, group: str, band: float = 0.05) -> DataFrame:
    """(group, recent, older, trend): means from the cutoff on and before it; within the band they are stable."""
    means = rows.groupBy(group).agg(F.avg(F.when(F.col(at) >= cutoff, F.col(value))).alias("recent"), F.avg(F.when(F.col(at) < cutoff, F.col(value))).alias("older"))
    change = F.try_divide(F.col("recent") - F.col("older"), F.abs("older"))
    return means.select(group, "recent", "older", F.when(change > band, "improving").when(change < -band, "declining").when(change.isNotNull(), "stable").otherwise("unknown").alias("trend"))


def historical(rows: DataFrame, value: str, group: str, order: list[Column], last: int = 10) -> DataFrame:
    """(group, n, avg, min, max, p90) of the last runs of each group; p90 is sorted[int(.9 n)]."""
    w = Window.partitionBy(group).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    a = F.array_sort(F.collect_list(value))
    return kept.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.element_at(a, F.least(F.floor(F.size(a) * 0.9).cast("int") + 1, F.size(a))).alias("p90"))


def insights(runs: DataFrame) -> DataFrame:
    """(run_id, insight) from (run_id, seconds, usual_seconds, cost, usual_cost, retries, docs, tokens, same_errors)."""
    d = F.greatest(F.col("docs"), F.lit(1))
    rules = {"slow": F.col("seconds") > 1.5 * F.col("usual_seconds"), "costly": F.col("cost") > 1.3 * F.col("usual_cost"), "many_retries": F.col("retries") / d > 0.1, "low_throughput": F.try_divide(F.col("docs"), F.col("seconds")) < 0.5, "many_tokens": F.col("tokens") / d > 5000, "repeated_error": F.col("same_errors") >= 3}
    hits = F.filter(F.array(*[F.when(ok, F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return runs.select("run_id", F.explode(hits).alias("insight"))


def trust_statistics(rows: DataFrame, trust: str = "trust") -> DataFrame:
    """One row: mean, least, largest, and how many and what share are .7 or more, and .3 or less."""
    t = F.col(trust)
    return rows.agg(F.avg(t).alias("avg"), F.min(t).alias("min"), F.max(t).alias("max"), F.count_if(t >= 0.7).alias("high"), F.count_if(t <= 0.3).alias("low"), (100 * F.count_if(t >= 0.7) / F.count(t)).alias("high_percent"), (100 * F.count_if(t <= 0.3) / F.count(t)).alias("low_percent"))


def token_cost(usage: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float], model: str = "model") -> DataFrame:
    """usage (model, tokens_in, tokens_out) with "cost": the longest listed prefix of the model sets its price of a million."""
    pick = lambda i: F.coalesce(*[F.when(F.col(model).startswith(p), F.lit(prices[p][i])) for p in sorted(prices, key=len, reverse=True)], F.lit(default[i]))
    return usage.withColumn("cost", (F.col("tokens_in") * pick(0) + F.col("tokens_out") * pick(1)) / 1e6)
