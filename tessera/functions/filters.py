"""Filters as data: dictionaries compiled to Columns, so that Spark plans and pushes them down."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Sort keys that a saved filter may name, and what it sorts by if it names none.
SORT_KEYS = ("published_at", "view_count", "like_count", "duration_seconds", "title", "engagement_score")
MOST_RESULTS = 10_000


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def missing(x: Column) -> Column:
    return x.isNull() | (x.cast("string") == "")


def _test(op: str, v: Any):
    """A function of one Column, as higher-order functions take them."""
    tests = {"==": lambda e: e == v, "in": lambda e: e.isin(*v), "rlike": lambda e: e.rlike(v), "$gt": lambda e: e > v, "$gte": lambda e: e >= v, "$lt": lambda e: e < v, "$lte": lambda e: e <= v}
    return tests[op]


def compile_query(spec: dict[str, Any], schema: StructType) -> Column:
    """A document-store filter as a Column: {field: value}, operators $eq $ne $in $nin $gt $gte $lt $lte $exists $regex $all
    $type, and $and $or $nor $not. $ne and $nin hold for null, and on arrays an operator holds if it does for any element.
    Operators that run code are refused."""

    def field(name: str, want: Any) -> Column:
        x = F.col(name)
        kind = schema
        for part in name.split("."):
            kind = kind[part].dataType if isinstance(kind, StructType) else kind
        is_array = isinstance(kind, ArrayType)
        if not (isinstance(want, dict) and any(str(k).startswith("$") for k in want)):
            want = {"$eq": want}
        each = (lambda f: F.coalesce(F.exists(x, f), F.lit(False))) if is_array else (lambda f: F.coalesce(f(x), F.lit(False)))
        parts = []
        for op, v in want.items():
            match op:
                case "$eq":
                    parts.append(x.isNull() if v is None else each(_test("==", v)))
                case "$ne":
                    parts.append(x.isNotNull() if v is None else ~each(_test("==", v)))
                case "$in":
                    parts.append(each(_test("in", v)) | (x.isNull() if None in v else F.lit(False)) if v else F.lit(False))
                case "$nin":
                    parts.append(~each(_test("in", v)) if v else F.lit(True))
                case "$gt" | "$gte" | "$lt" | "$lte":
                    parts.append(each(_test(op, v)))
                case "$exists":
                    parts.append(x.isNotNull() if v else x.isNull())
                case "$regex":
                    flags = "(?i)" if "i" in want.get("$options", "") else ""
                    parts.append(each(_test("rlike", flags + v)))
                case "$options":
                    pass
                case "$all":
                    parts.append(F.size(F.array_except(F.array(*[F.lit(i) for i in v]), x)) == 0)
                case "$type":
                    parts.append(F.lit(kind.typeName() in ({"string": ("string",), "number": ("integer", "long", "double", "float", "decimal", "short", "byte")}[v])) & x.isNotNull())
                case "$not":
                    parts.append(~field(name, v))
                case _:
                    raise ValueError(f"operator {op} is not supported")
        return _all(parts)

    parts = []
    for k, v in spec.items():
        match k:
            case "$and":
                parts.append(_all([compile_query(s, schema) for s in v]))
            case "$or":
                parts.append(_any([compile_query(s, schema) for s in v]))
            case "$nor":
                parts.append(~_any([compile_query(s, schema) for s in v]))
            case _ if k.startswith("$"):
                raise ValueError(f"operator {k} is not supported")
            case _:
                parts.append(field(k, v))
    return _all(parts)


def query_collection(rows: DataFrame, spec: dict[str, Any], fields: list[str] | None = None, sort: list[tuple[str, int]] | None = None, skip: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(a page, a row of total and has_more) of the rows that the filter keeps."""
    kept = rows.where(compile_query(spec, rows.schema))
    order = [F.col(k).asc() if d > 0 else F.col(k).desc() for k, d in sort or []]
    page = kept.orderBy(*order) if order else kept
    page = page.select(*fields) if fields else page
    return page.offset(skip).limit(limit), kept.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > skip + limit)


def saved_filter(spec: dict[str, Any]) -> Column:
    """A saved video filter: channels, playlists, date_range (start, end), engagement (min_views, min_likes, min_score),
    duration (min_seconds, max_seconds), keywords_any and keywords_all (in keywords), has_transcript.

    keywords_any and has_transcript=false widen the filter together: either suffices.
    """
    parts, either = [], []
    if spec.get("channels"):
        parts.append(F.col("channel_id").isin(*spec["channels"]))
    if spec.get("playlists"):
        parts.append(F.col("playlist_id").isin(*spec["playlists"]))
    span = spec.get("date_range") or {}
    if span.get("start"):
        parts.append(F.col("published_at") >= span["start"])
    if span.get("end"):
        parts.append(F.col("published_at") <= span["end"])
    e = spec.get("engagement") or {}
    for key, name in (("min_views", "view_count"), ("min_likes", "like_count"), ("min_score", "engagement_score")):
        if e.get(key) is not None:
            parts.append(F.col(name) >= e[key])
    d = spec.get("duration") or {}
    if d.get("min_seconds") is not None:
        parts.append(F.col("duration_seconds") >= d["min_seconds"])
    if d.get("max_seconds") is not None:
        parts.append(F.col("duration_seconds") <= d["max_seconds"])
    if spec.get("keywords_all"):
        parts.append(F.size(F.array_except(F.array(*[F.lit(k) for k in spec["keywords_all"]]), F.col("keywords"))) == 0)
    if spec.get("keywords_any"):
        either.append(F.arrays_overlap(F.col("keywords"), F.array(*[F.lit(k) for k in spec["keywords_any"]])))
    if spec.get("has_transcript") is True:
        parts.append(~missing(F.col("transcript")))
    elif spec.get("has_transcript") is False:
        either.append(missing(F.col("transcript")))
    return F.coalesce(_all(parts + ([_any(either)] if either else [])), F.lit(False))


def validate_filter(spec: dict[str, Any]) -> list[str]:
    """What is wrong with a saved filter; nothing if it can be compiled."""
    wrong = []
    for k in ("channels", "playlists", "keywords_any", "keywords_all"):
        if k in spec and not (isinstance(spec[k], list) and all(isinstance(x, str) for x in spec[k])):
            wrong.append(f"{k}: a list of strings is needed")
    for k, names in (("engagement", ("min_views", "min_likes", "min_score")), ("duration", ("min_seconds", "max_seconds"))):
        for n in names:
            v = (spec.get(k) or {}).get(n)
            if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0):
                wrong.append(f"{k}.{n}: a number of 0 or more is needed")
    if (d := spec.get("duration")) and None not in (d.get("min_seconds"), d.get("max_seconds")) and d["min_seconds"] > d["max_seconds"]:
        wrong.append("duration: the least is above the most")
    if spec.get("sort_by") not in (None, *SORT_KEYS):
        wrong.append("sort_by: no such key")
    if spec.get("limit") is not None and not (isinstance(spec["limit"], int) and 1 <= spec["limit"] <= MOST_RESULTS):
        wrong.append(f"limit: 1 to {MOST_RESULTS}")
    if spec.get("has_transcript") not in (None, True, False):
        wrong.append("has_transcript: true or false")
    return wrong


def sort_order(spec: dict[str, Any], key: str = "video_id") -> list[Column]:
    """A whitelisted key, else newest first; ties by id."""
    by = spec.get("sort_by") if spec.get("sort_by") in SORT_KEYS else "published_at"
    down = spec.get("sort_order", "desc") != "asc"
    return [F.col(by).desc_nulls_last() if down else F.col(by).asc_nulls_first(), F.col(key).asc()]


def resolve_filter(videos: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """The ids that a saved filter selects, in its order, at most MOST_RESULTS of them: that limit is the feature's."""
    return videos.where(saved_filter(spec)).orderBy(*sort_order(spec)).limit(min(spec.get("limit") or MOST_RESULTS, MOST_RESULTS))


def retrieval_filter(topic: str | None = None, channel: str | None = None, max_age: float | None = None, least_trust: float | None = None, exclude_redundant: bool = False) -> Column:
    """Chunks by topic, channel, age and trust; without redundant ones nulls stay."""
    parts = []
    if topic is not None:
        parts.append(F.array_contains("topics", topic))
    if channel is not None:
        parts.append(F.col("channel_id") == channel)
    if max_age is not None:
        parts.append(F.col("age_days") <= max_age)
    if least_trust is not None:
        parts.append(F.col("trust_score") >= least_trust)
    if exclude_redundant:
        parts.append(~F.col("is_redundant").eqNullSafe(True))
    return _all(parts)


# Names that a chat filter may use, and what they stand for.
CHAT_FIELDS = {"topic": "topics", "topics": "topics", "channel": "channel_id", "channel_id": "channel_id", "video": "video_id", "video_id": "video_id", "trust": "trust_score", "trust_score": "trust_score", "age": "age_days", "age_days": "age_days"}


def chat_filter(spec: dict[str, Any], schema: StructType) -> Column:
    """A filter from a chat: unknown names are left out, aliases resolved, and lists mean any of."""
    clean = {CHAT_FIELDS[k]: ({"$in": v} if isinstance(v, list) else v) for k, v in spec.items() if k in CHAT_FIELDS and v not in (None, "", [])}
    return compile_query({k: v for k, v in clean.items() if k in schema.names}, schema)


def search(pattern: str, *fields: str, arrays: tuple[str, ...] = ()) -> Column:
    """Rows of which any field, or any element of the array fields, matches the pattern, whatever the case."""
    return F.coalesce(_any([F.coalesce(F.col(f).rlike(f"(?i){pattern}"), F.lit(False)) for f in fields] + [F.coalesce(F.exists(f, lambda x: x.rlike(f"(?i){pattern}")), F.lit(False)) for f in arrays]), F.lit(False))


def expand_values(catalog: DataFrame, wanted: list[str], value: str = "value") -> DataFrame:
    """(wanted, value): catalog values that have a wanted word, whole if it has three letters or fewer, else as a prefix
    of a word. The patterns are a driver-side list, so each is a literal and no pattern is joined."""
    word = lambda w: rf"(?i)\b\Q{w}\E" + (r"\b" if len(w) <= 3 else "")
    hits = F.filter(F.array(*[F.when(F.col(value).rlike(word(w)), F.lit(w)) for w in wanted]), lambda x: x.isNotNull())
    return catalog.select(F.explode(hits).alias("wanted"), F.col(value).alias("value")).distinct()
