"""Scalar functions on numbers, vectors and keys, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def engagement_score(views: Column, likes: Column, comments: Column) -> Column:
    """min(1, (2 likes + 3 comments) / max(100, views)); null without views."""
    return F.when(views > 0, F.least(F.lit(1.0), (2 * likes + 3 * comments) / F.greatest(F.lit(100), views)))


def trust_score(redundancy: Column, redundant: Column, age_days: Column, engagement: Column, code: Column) -> Column:
    """Consensus, recency, engagement and code, weighted .4, .3, .2 and .1; an age of 0 or null counts as 365 days."""
    score = F.coalesce(redundancy, F.lit(0.0))
    consensus = F.when(F.coalesce(redundant, F.lit(False)), score).otherwise(0.5 * score)
    age = F.coalesce(F.nullif(age_days, F.lit(0.0)), F.lit(365.0))
    recency = sigmoid(clamp((180 - age) / 60, -6.0, 6.0))
    valid = F.when(F.coalesce(code, F.lit(False)), 1.0).otherwise(0.6)
    return clamp(0.4 * consensus + 0.3 * recency + 0.2 * clamp(F.coalesce(engagement, F.lit(0.0)), 0.0, 1.0) + 0.1 * valid, 0.0, 1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or null, has another length or norm 0."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def rerank_score(score: Column, trust: Column, age_days: Column, weights: tuple[float, float, float] = (0.6, 0.25, 0.15)) -> Column:
    """Vector score, trust and recency; a trust of 0 or null counts as .5 and an age of 0 or null as 180 days."""
    t = F.coalesce(F.nullif(trust, F.lit(0.0)), F.lit(0.5))
    age = F.coalesce(F.nullif(age_days, F.lit(0.0)), F.lit(180.0))
    return weights[0] * score + weights[1] * t + weights[2] / (1 + age / 180)


def answer_confidence(entities: Column, communities: Column, length: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * F.least(entities / 5, one) + 0.3 * F.least(communities / 3, one) + 0.3 * F.least(length / 2000, one)


def redundancy_decision(score: Column, me: Column, other: Column, adjacent: Column, threshold: float = 0.92, adjacent_threshold: float = 0.975) -> Column:
    """struct(is_redundant, duplicate_of): neighbours in a video need a higher score, and the smaller id is the primary,
    which never is a duplicate."""
    near = score >= F.when(adjacent, adjacent_threshold).otherwise(threshold)
    primary = F.least(me, other)
    duplicate = near & (primary != me)
    return F.struct(F.coalesce(duplicate, F.lit(False)).alias("is_redundant"), F.when(duplicate, primary).alias("duplicate_of"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long") + 1000


def age_in_days(published: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.datediff(now, published)), F.lit(180))


def compare(op: Column, left: Column, right: Column, tolerance: float = 1e-12) -> Column:
    """left op right for ==, !=, <, <=, >, >=, with a tolerance where equality counts."""
    same = F.abs(left - right) <= tolerance
    return F.when(op == "==", same).when(op == "!=", ~same).when(op == "<", left < right).when(op == "<=", (left < right) | same).when(op == ">", left > right).when(op == ">=", (left > right) | same)


def group_confidence(mean: Column, count: Column, agreement: Column) -> Column:
    return clamp(mean + 0.1 * F.log10(1 + count) + 0.05 * agreement, 0.0, 1.0)


# Keys: hashes that are the same wherever they are computed.
def entity_id(name: Column, kind: Column | None = None) -> Column:
    plain = F.lower(F.trim(name))
    return F.md5(plain if kind is None else F.concat_ws("|", plain, kind))


def relationship_id(subject: Column, object_: Column, predicate: Column) -> Column:
    return F.md5(F.lower(F.concat_ws(":", subject, object_, predicate)))


def community_id(level: Column, members: Column) -> Column:
    return F.concat(F.lit("lvl"), level.cast("string"), F.lit("-"), F.substring(F.sha1(F.array_join(F.array_sort(members), ",")), 1, 12))


def split_id(base: Column, members: Column) -> Column:
    return F.concat(base, F.lit("-p"), F.substring(F.sha1(F.array_join(F.array_sort(members), ",")), 1, 8))


def idempotency_key(queue: Column, envelope: Column, attempt: Column) -> Column:
    return F.concat_ws(":", F.lit("idem"), queue, envelope, attempt.cast("string"))
