"""Graph operators over edge tables: degrees, traversal, components, communities, prediction.

Loops write their state to the checkpoint folder each round and end on totals; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import community_id
from ..sources.shared import cut
from .louvain import _pack, _small, _unpack, louvain
from .relational import degrees

S, O = "subject_id", "object_id"


def neighbours(edges: DataFrame, ids: list[str]) -> DataFrame:
    """(entity_id, neighbour, predicate, direction) of some entities, by one scan of the edges."""
    out = F.when(F.col(S).isin(*ids), F.struct(F.col(S).alias("entity_id"), F.col(O).alias("neighbour"), F.lit("out").alias("direction")))
    into = F.when(F.col(O).isin(*ids), F.struct(F.col(O).alias("entity_id"), F.col(S).alias("neighbour"), F.lit("in").alias("direction")))
    return edges.where(F.col(S).isin(*ids) | F.col(O).isin(*ids)).select("predicate", F.explode(F.filter(F.array(out, into), lambda x: x.isNotNull())).alias("x")).select("x.entity_id", "x.neighbour", "predicate", "x.direction")


def hop(edges: DataFrame, ids: list[str]) -> DataFrame:
    """(entity_id): what is one edge away from any of the seeds, without the seeds."""
    return neighbours(edges, ids).select(F.col("neighbour").alias("entity_id")).where(~F.col("entity_id").isin(*ids)).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of every edge in both directions, from one scan."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select(F.explode(F.array(pair(S, O), pair(O, S))).alias("x")).select("x.src", "x.dst")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(entity_id, degree, centrality: its share of the largest degree). The largest is one row, broadcast."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.max("degree").alias("top")))).select("entity_id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))


def undirected(edges: DataFrame, vertices: DataFrame | None = None, weight: str = "confidence") -> DataFrame:
    """(a, b, weight) with a < b: parallel edges collapse to their largest weight; loops, and edges that lack an end, go."""
    e = edges.select(F.least(S, O).alias("a"), F.greatest(S, O).alias("b"), F.col(weight).cast("double").alias("weight")).where("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    if vertices is not None:
        ids = vertices.select("entity_id")
        e = e.join(ids, F.col("a") == F.col("entity_id"), "left_semi").join(ids, F.col("b") == F.col("entity_id"), "left_semi")
    return e


def graph_statistics(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: entities, relations, density, edge to node ratio, mean, least and largest degree, isolated entities.

    The edges are planned once: each adds two to the degrees, also of ends that are no vertex, so half their sum is the
    number of relations. An end that is null counts as an entity of its own without a row.
    """
    all_ = vertices.select("entity_id", F.lit(True).alias("here")).join(degrees(edges), "entity_id", "full_outer").select("here", F.coalesce("degree", F.lit(0)).alias("degree"))
    mine = F.when(F.col("here"), F.col("degree"))
    v = all_.agg(F.count("here").alias("entities"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("relations"), F.avg(mine).alias("avg_degree"), F.max(mine).alias("max_degree"), F.min(mine).alias("min_degree"), F.count_if(mine == 0).alias("isolated"))
    n, m = F.col("entities"), F.col("relations")
    return v.select("entities", "relations", F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, m / n).otherwise(0.0).alias("edge_node_ratio"), F.coalesce("avg_degree", F.lit(0.0)).alias("avg_degree"), "max_degree", "min_degree", "isolated")


def degree_histogram(edges: DataFrame, vertices: DataFrame, width: int = 5) -> DataFrame:
    """(bucket, count) of degrees; a bucket begins at a multiple of ``width``."""
    d = vertices.select("entity_id").join(degrees(edges), "entity_id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.groupBy((F.floor(F.col("degree") / width) * width).alias("bucket")).agg(F.count("*").alias("count"))


def pair_density(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pairs, density): linked unordered pairs, and their share of all pairs."""
    pairs = undirected(edges.withColumn("confidence", F.lit(1.0))).agg(F.count("*").alias("pairs"))
    n = vertices.agg(F.count("*").alias("n"))
    return pairs.crossJoin(F.broadcast(n)).select("pairs", F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("density"))


def graph_signature(edges: DataFrame) -> DataFrame:
    """(signature, edges): the sum of 48-bit hashes of all edges, so the order of edges does not matter and no task sorts
    or holds all of them. (The reference hashes one sorted string.)"""
    h = F.conv(F.substring(F.sha1(F.concat_ws("|", S, O, "predicate", F.format_string("%.2f", F.col("confidence").cast("double")))), 1, 12), 16, 10).cast("decimal(38,0)")
    return edges.agg(F.sum(h).cast("string").alias("signature"), F.count("*").alias("edges"))


def cooccurrence(mentions: DataFrame, edges: DataFrame | None = None, cap: int = 200, confidence: float = 0.7) -> DataFrame:
    """(subject_id, object_id, chunk_id, confidence): pairs of distinct entities of a chunk, the smaller id first, with the
    smallest chunk. Pairs that are linked already are left out, and so are entities of ``cap`` persisted edges or more:
    that cap is the feature's."""
    m = mentions.select("chunk_id", "entity_id").distinct()
    if edges is not None:
        full = degrees(edges).where(F.col("degree") >= cap).select("entity_id")
        m = m.join(full, "entity_id", "left_anti")
    pairs = m.select("chunk_id", F.col("entity_id").alias(S)).join(m.select("chunk_id", F.col("entity_id").alias(O)), "chunk_id").where(F.col(S) < F.col(O)).groupBy(S, O).agg(F.min("chunk_id").alias("chunk_id"))
    if edges is not None:
        linked = edges.select(F.least(S, O).alias(S), F.greatest(S, O).alias(O)).distinct()
        pairs = pairs.join(linked, [S, O], "left_anti")
    return pairs.withColumn("confidence", F.lit(confidence))


# What links entities of two types in neighbouring chunks, either way round.
CROSS_CHUNK = {("PERSON", "CONCEPT"): "discusses", ("PERSON", "TECHNOLOGY"): "uses", ("PERSON", "ORGANIZATION"): "affiliated_with", ("CONCEPT", "CONCEPT"): "related_to", ("CONCEPT", "TECHNOLOGY"): "implemented_in", ("TECHNOLOGY", "TECHNOLOGY"): "works_with", ("ORGANIZATION", "TECHNOLOGY"): "develops"}
# The predicate of a link's other direction.
REVERSE = {"uses": "used_by", "teaches": "taught_by", "creates": "created_by", "develops": "developed_by", "implements": "implemented_by", "contains": "contained_in", "has": "belongs_to", "manages": "managed_by", "leads": "led_by", "explains": "explained_by", "demonstrates": "demonstrated_by", "requires": "required_by", "depends_on": "dependency_of", "applies_to": "applied_by", "works_at": "employs", "part_of": "has_part", "subtype_of": "has_subtype", "is_a": "has_instance"}


def type_pair_predicate(a: Column, b: Column, table: dict[tuple[str, str], str], otherwise: str) -> Column:
    """The table's predicate of two types in either order."""
    both = {f"{x}|{y}": p for (x, y), p in table.items()}
    m = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.concat_ws("|", a, b)), F.try_element_at(m, F.concat_ws("|", b, a)), F.lit(otherwise))


def chunk_window(chunks: Column) -> Column:
    """How many chunks on an entity still meets others: more in longer videos."""
    return F.when(chunks <= 15, 1).when(chunks <= 30, 2).when(chunks <= 60, 3).otherwise(5)


def cross_chunk(mentions: DataFrame, entities: DataFrame, window: int | None = None, order: tuple[str, ...] = ("said_at", "chunk_id")) -> DataFrame:
    """(subject_id, object_id, predicate, confidence, chunk_id): entities of chunks at most a window apart in one video.

    Chunks are numbered in each video; a link of the same ends and predicate keeps the first pair of chunks. The band
    is met by copying each later chunk to the numbers before it, so the join is an equi-join on (video, number).
    """
    chunks = mentions.select("video_id", "chunk_id", *[o for o in order if o != "chunk_id"]).distinct()
    numbered = chunks.withColumn("i", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))
    size = numbered.groupBy("video_id").agg(F.max("i").alias("k"))
    w = F.lit(window) if window else chunk_window(F.col("k"))
    placed = numbered.join(size, "video_id").select("video_id", "chunk_id", "i", w.alias("w"))
    m = mentions.select("video_id", "chunk_id", "entity_id").distinct().join(placed, ["video_id", "chunk_id"]).join(entities.select("entity_id", "type"), "entity_id")
    left = m.select("video_id", "i", F.col("chunk_id"), F.col("entity_id").alias(S), F.col("type").alias("t1"))
    right = m.select("video_id", F.col("entity_id").alias(O), F.col("type").alias("t2"), F.explode(F.transform(F.sequence(F.lit(1), "w"), lambda d: F.struct((F.col("i") - d).alias("i"), d.alias("d")))).alias("x")).where("x.i >= 1").select("video_id", "x.i", O, "t2", "x.d")
    pairs = left.join(right, ["video_id", "i"]).where(F.col(S) != F.col(O)).withColumn("predicate", type_pair_predicate(F.col("t1"), F.col("t2"), CROSS_CHUNK, "mentioned_together"))
    first = pairs.groupBy(S, O, "predicate").agg(F.min(F.struct("video_id", "i", "d", "chunk_id")).alias("x"))
    return first.select(S, O, "predicate", F.greatest(F.lit(0.4), F.lit(0.6) - 0.05 * (F.col("x.d") - 1)).alias("confidence"), F.col("x.chunk_id").alias("chunk_id"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """The edges with the other direction of each whose predicate has one; it merges into an existing edge, whose
    confidence becomes the larger of both."""
    m = F.create_map(*[F.lit(x) for kv in REVERSE.items() for x in kv])
    back = edges.select(F.col(O).alias(S), F.col(S).alias(O), F.try_element_at(m, F.col("predicate")).alias("predicate"), "confidence").where("predicate is not null")
    return edges.select(S, O, "predicate", "confidence").unionByName(back).groupBy(S, O, "predicate").agg(F.max("confidence").alias("confidence"))


def without_linked(predicted: DataFrame, edges: DataFrame) -> DataFrame:
    """Predicted edges of pairs that no edge links in either direction."""
    linked = edges.select(F.least(S, O).alias("_a"), F.greatest(S, O).alias("_b")).distinct()
    return predicted.join(linked, (F.least(S, O) == F.col("_a")) & (F.greatest(S, O) == F.col("_b")), "left_anti")


#: Ways (an edge has two) to a block of vertices; a task meets the ways into two blocks. Entries that a task adds up at once.
BLOCK_WAYS, ENTRIES = 8_000_000, 500_000


def _packed(batches: Iterator[pa.RecordBatch], flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(i, j, blob) of rows (i, j, via, d, nodes): lists of one place as one, of which steps from node to node are kept."""

    def packed(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(kept)
        i, j, via, d = (t.column(x).to_numpy() for x in ("i", "j", "via", "d"))
        lists = t.column("nodes").combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        begin = np.cumsum(size) - size
        order = np.lexsort((via, j, i))
        first = np.flatnonzero(np.r_[True, (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])])
        out = []
        for rows in np.split(order, first[1:]):
            l = size[rows]
            at = np.repeat(begin[rows] - (np.cumsum(l) - l), l) + np.arange(l.sum())
            nodes = flat[at]
            # in order within a list
            nodes = nodes[np.lexsort((nodes, np.repeat(np.arange(len(rows)), l)))]
            out.append((i[rows[0]], j[rows[0]], _pack(via=np.diff(via[rows], prepend=0), d=_small(d[rows]), size=_small(l), nodes=np.diff(nodes, prepend=0))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["i", "j", "blob"])

    kept, n = [], 0
    for t in batches:
        if t.num_rows:
            kept, n = [*kept, t], n + len(t.column("nodes").flatten())
        if n >= flush:
            yield packed(kept)
            kept, n = [], 0
    if n:
        yield packed(kept)


def _pair_scores(t: pa.Table, least_score: float, entries: int) -> Iterator[pa.Table]:
    """The scores over ``least_score`` of a task's pairs: lists of the left and the right block are met by neighbour. Lists are
    unpacked one blob at a time, and the arrays of all ways are few and of 4 bytes where they can be."""
    one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    vias, ds, sizes, rights, names = [], [], [], [], [np.zeros(0, np.int64)]
    for blob, side in zip(t.column("blob"), t.column("right").to_pylist(), strict=True):
        x = _unpack(blob)
        vias.append(np.cumsum(x["via"]))
        ds.append(x["d"].astype(np.int64))
        sizes.append(x["size"].astype(np.int64))
        rights.append(np.full(len(x["d"]), side))
        names.append(np.unique(np.cumsum(x["nodes"])))
        if len(names) > 64:
            names = [np.unique(np.concatenate(names))]
    names = np.unique(np.concatenate(names))
    via, d, size, right = (np.concatenate(x) for x in (vias, ds, sizes, rights))
    del vias, ds, sizes, rights
    n, at = len(names), np.r_[0, np.cumsum(size)]
    known, mine = d == 0, (d > 0) & ~right
    other = mine if one else (d > 0) & right
    least = np.int32 if max(n, len(size), at[-1]) < 2**31 else np.int64
    col = np.empty(at[-1], least)
    begin = 0
    for blob in t.column("blob"):
        nodes = np.cumsum(_unpack(blob)["nodes"])
        col[begin : begin + len(nodes)] = np.searchsorted(names, nodes)
        begin += len(nodes)
    ends_of = lambda which: np.repeat(np.flatnonzero(which).astype(least), size[which])
    places = lambda which: np.flatnonzero(np.repeat(which, size)).astype(least)
    low = via[ends_of(known)]
    x, y = np.searchsorted(names, low), col[places(known)]
    # an edge's lesser end need not be in any list
    there = (x < n) & (names[np.minimum(x, n - 1)] == low)
    linked = np.sort(np.minimum(x, y)[there].astype(np.int64) * n + np.maximum(x, y)[there])
    order = np.flatnonzero(other)[np.argsort(via[other], kind="stable")]
    vias = via[order]
    # of each list, the one of the same neighbour in the other block, or -1
    p = np.minimum(np.searchsorted(vias, via), max(len(vias) - 1, 0))
    meets = np.where(mine & (vias[p] == via), order[p], -1) if len(vias) else np.full(len(via), -1)
    both = meets >= 0
    left = places(both)
    by = np.argsort(col[left], kind="stable").astype(least)
    a_of = col[left[by]]
    del left
    to = meets[ends_of(both)].astype(least)[by]
    del by
    much = np.cumsum(size[to])
    ends = np.flatnonzero(np.r_[a_of[1:] != a_of[:-1], True]) + 1 if len(to) else np.zeros(0, int)
    start = 0
    while start < len(to):
        # whole vertices, at least one
        stop = ends[max(np.searchsorted(much[ends - 1], (much[start - 1] if start else 0) + entries, side="right") - 1, np.searchsorted(ends, start, side="right"))]
        q, l = to[start:stop], size[to[start:stop]]
        begin = np.cumsum(l) - l
        b = col[np.repeat(at[q] - begin, l) + np.arange(l.sum())].astype(np.int64)
        a = np.repeat(a_of[start:stop].astype(np.int64), l)
        w = np.repeat(1 / np.log(d[q]), l)
        start = stop
        if one:
            a, b, w = a[a < b], b[a < b], w[a < b]
        if not len(a):
            continue
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rows, place = a[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(a)]))
        cell = place * n + b
        if len(rows) * n <= 20 * len(cell):
            score = np.bincount(cell, w, len(rows) * n)
            cell = np.flatnonzero(score > least_score)
            score = score[cell]
        else:
            by = np.argsort(cell)
            cell, w = cell[by], w[by]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            cell, score = cell[first], np.add.reduceat(w, first)
            cell, score = cell[score > least_score], score[score > least_score]
        a, b = rows[cell // n], cell % n
        key = np.minimum(a, b).astype(np.int64) * n + np.maximum(a, b)
        if len(linked):
            keep = linked[np.minimum(np.searchsorted(linked, key), len(linked) - 1)] != key
            key, score = key[keep], score[keep]
        yield pa.table({"a": names[key // n], "b": names[key % n], "score": score})


def adamic_adar(graph: DataFrame, least_score: float = 0.5, named: bool = True) -> DataFrame:
    """(a, b, score, confidence) of unlinked pairs with common neighbours: the sum of 1 / ln(degree) over these. Without
    ``named``, a and b are numbers in the order of the ids, and no names are joined. A neighbour of degree 1 has no pairs.

    Two-hop paths are never written: vertices lie in blocks, each pair of blocks is a task that is sent the neighbours'
    lists of both, and only pairs over the score leave it. Lists are copied once for each block, packed.
    """
    ways = graph.select(F.explode(F.array(F.struct(F.col("a").alias("src")), F.struct(F.col("b").alias("src")))).alias("x")).select("x.src")
    ids = cut(ways.groupBy("src").agg(F.count("*").alias("d")).orderBy("src").select("src", "d", F.monotonically_increasing_id().alias("id")))
    end = lambda x: ids.select(F.col("src").alias(x), F.col("id").alias(f"i{x}"), F.col("d").alias(f"d{x}"))
    e = cut(graph.select("a", "b").join(end("a"), "a").join(end("b"), "b").select("ia", "ib", "da", "db"))
    blocks = max(8, -(-2 * e.count() // BLOCK_WAYS))
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    way = lambda x, y: F.struct(F.col(f"i{x}").alias("via"), F.col(f"d{x}").alias("d"), F.col(f"i{y}").alias("node"))
    w = e.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*").where("d > 1")
    lists = w.groupBy("via", "d", block("node").alias("k")).agg(F.collect_list("node").alias("nodes"))
    placed = "i int, j int, blob binary"
    mine = lists.select(F.col("k").alias("i"), F.lit(0).alias("j"), "via", "d", "nodes").mapInArrow(_packed, placed)
    sent = mine.select(F.col("i").alias("k"), "blob", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select(F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).alias("right"), "blob")
    edges = e.select(F.least(block("ia"), block("ib")).alias("i"), F.greatest(block("ia"), block("ib")).alias("j"), F.col("ia").alias("via"), F.lit(0).cast("long").alias("d"), F.array("ib").alias("nodes"))
    linked = edges.mapInArrow(_packed, placed).select("i", "j", F.lit(False).alias("right"), "blob")
    entries, kind = ENTRIES, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def score(t: pa.Table) -> pa.Table:
        return pa.concat_tables([kind.empty_table(), *_pair_scores(t, least_score, entries)])

    tasks = blocks * (blocks + 1) // 2
    found = sent.unionByName(linked).repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(score, "a long, b long, score double")
    if named:
        name = lambda x: ids.select(F.col("src").alias(f"_{x}"), F.col("id").alias(x))
        found = found.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "score")
    return found.withColumn("confidence", F.least(F.lit(0.9), F.col("score") / 10))


def deduplicated_predictions(predicted: DataFrame) -> DataFrame:
    """One row for each unordered pair and predicate, with the largest confidence."""
    return predicted.groupBy(F.least(S, O).alias(S), F.greatest(S, O).alias(O), "predicate").agg(F.max("confidence").alias("confidence"))


def connected_components(graph: DataFrame, least_size: int = 1) -> DataFrame:
    """(entity_id, component: the smallest id reachable) over (a, b); components of fewer members are left out.

    Stars are moved to smaller ids until nothing changes, so rounds grow with the logarithm of the longest path.
    """
    now = cut(graph.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).where("src <> dst").distinct())
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        step = large.join(low, "src").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("low").alias("b")), F.struct(F.col("dst").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = cut(step.select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).where("src <> dst").distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    members = now.groupBy("src").agg(F.min("dst").alias("component")).withColumnRenamed("src", "entity_id")
    members = members.unionByName(now.select(F.col("dst").alias("entity_id"), F.col("dst").alias("component")).distinct())
    if least_size > 1:
        big = members.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("component")
        members = members.join(big, "component", "left_semi").select("entity_id", "component")
    return members


def ego_network(edges: DataFrame, start: str, hops: int = 2, most: int = 100) -> DataFrame:
    """(entity_id, hop): the nearest ``most`` entities, by hop and id, within so many edges; the limit is the feature's."""
    ways = both_ways(edges)
    seen = edges.sparkSession.createDataFrame([(start, 0)], "entity_id string, hop int")
    frontier = seen
    for h in range(1, hops + 1):
        new = ways.join(frontier.select(F.col("entity_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti").withColumn("hop", F.lit(h))
        frontier = cut(new)
        seen = seen.unionByName(frontier)
    return seen.orderBy("hop", "entity_id").limit(most)


def shortest_paths(edges: DataFrame, start: str, end: str, longest: int = 5, most: int = 3) -> DataFrame:
    """(length, path) of at most ``most`` shortest paths, in order of their ids; edges may be walked either way.

    One breadth-first search marks each entity's distance once; paths are then walked back from the end over
    entities that are one nearer, so no path is grown that is not a shortest one.
    """
    spark = edges.sparkSession
    ways = both_ways(edges).distinct()
    seen = cut(spark.createDataFrame([(start, 0)], "entity_id string, hop int"))
    found = start == end
    for h in range(1, longest + 1):
        if found:
            break
        frontier = seen.where(F.col("hop") == h - 1).select(F.col("entity_id").alias("src"))
        new = ways.join(frontier, "src", "left_semi").select(F.col("dst").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti").withColumn("hop", F.lit(h))
        new = cut(new)
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        found = not new.where(F.col("entity_id") == end).isEmpty()
    last = seen.where(F.col("entity_id") == end)
    paths = last.select(F.array("entity_id").alias("path"), F.col("entity_id").alias("at"), "hop", F.col("hop").alias("length"))
    for _ in range(longest):
        step = paths.where("hop > 0").join(ways.withColumnRenamed("src", "at"), "at").join(seen.select(F.col("entity_id").alias("dst"), F.col("hop").alias("h")), "dst").where(F.col("h") == F.col("hop") - 1)
        grown = step.select(F.concat(F.array("dst"), "path").alias("path"), F.col("dst").alias("at"), F.col("h").alias("hop"), "length")
        paths = grown.unionByName(paths.where("hop = 0"))
    return paths.where("hop = 0").orderBy(F.array_join("path", ">")).limit(most).select(F.col("length").cast("long").alias("length"), F.array_join("path", ">").alias("path"))


def modularity(graph: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a weighted graph (a, b, weight) and (entity_id, community)."""
    c1, c2 = (members.select(F.col("entity_id").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b"))
    e = graph.join(c1, "a").join(c2, "b")
    part = F.explode(F.array(F.struct(F.col("ca").alias("community"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside"), F.col("weight").alias("d")), F.struct(F.col("cb").alias("community"), F.lit(0.0).alias("inside"), F.col("weight").alias("d"))))
    by = e.select(part.alias("x")).groupBy("x.community").agg(F.sum("x.inside").alias("inside"), F.sum("x.d").alias("d"))
    m = graph.agg(F.sum("weight").alias("m"))
    return by.crossJoin(F.broadcast(m)).agg(F.sum(F.col("inside") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def label_propagation(graph: DataFrame, rounds: int = 10) -> DataFrame:
    """(entity_id, community): each round an entity takes the label of the largest weight around it, itself included with
    the weight of its strongest link, ties to the smallest label. Ends when nothing changes."""
    ways = cut(graph.select(F.explode(F.array(F.struct(F.col("a").alias("entity_id"), F.col("b").alias("o"), "weight"), F.struct(F.col("b").alias("entity_id"), F.col("a").alias("o"), "weight"))).alias("x")).select("x.*"))
    own = ways.groupBy("entity_id").agg(F.max("weight").alias("weight"))
    labels = ways.select("entity_id").distinct().withColumn("community", F.col("entity_id"))
    mark = None
    for _ in range(rounds):
        votes = ways.join(labels.select(F.col("entity_id").alias("o"), "community"), "o").select("entity_id", "community", "weight").unionByName(own.join(labels, "entity_id").select("entity_id", "community", "weight"))
        totals = votes.groupBy("entity_id", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        labels = cut(totals.groupBy("entity_id").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community")))
        new = labels.agg(F.sum(F.xxhash64("entity_id", "community").cast("decimal(38,0)"))).first()[0]
        if new == mark:
            break
        mark = new
    return labels


def both_names(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()


def leiden(graph: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Louvain's communities, of which each that is not connected is split into its components."""
    found = louvain(graph, resolution)
    side = lambda x: found.select(F.col("entity_id").alias(x), F.col("community").alias(f"c{x}"))
    inside = graph.join(side("a"), "a").join(side("b"), "b").where("ca = cb")
    parts = connected_components(inside.select("a", "b"))
    return found.join(parts, "entity_id", "left").select("entity_id", F.coalesce("component", "entity_id").alias("community"))


def multi_resolution(graph: DataFrame, resolutions: list[float]) -> DataFrame:
    """(level, entity_id, community): Louvain at each resolution, one level each."""
    out = None
    for level, g in enumerate(resolutions, 1):
        one = louvain(graph, g).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out.select("level", "entity_id", "community")


def split_oversized(graph: DataFrame, members: DataFrame, most: int = 1000, resolution: float = 1.8) -> DataFrame:
    """Communities of more than ``most`` members are split by Louvain, at a finer resolution, on their own edges."""
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    large = cut(members.join(size.where(F.col("n") > most), "community", "left_semi"))
    if large.isEmpty():
        return members
    side = lambda x: large.select(F.col("entity_id").alias(x), F.col("community").alias(f"c{x}"))
    inside = graph.join(side("a"), "a").join(side("b"), "b").where("ca = cb").select("a", "b", "weight")
    finer = louvain(inside, resolution).select("entity_id", F.concat(F.col("community"), F.lit("-p")).alias("fine"))
    return members.join(finer, "entity_id", "left").select("entity_id", F.coalesce("fine", "community").alias("community"))


def merge_small(graph: DataFrame, members: DataFrame, least: int = 5, weight: float = 0.1) -> DataFrame:
    """Communities of fewer members join the neighbour of the largest total weight over ``weight``, ties to the smallest
    name. All choose at once, from the communities as they were: no cascade."""
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    side = lambda x: members.select(F.col("entity_id").alias(x), F.col("community").alias(f"c{x}"))
    across = graph.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
    links = across.select(F.explode(F.array(F.struct(F.col("ca").alias("community"), F.col("cb").alias("to"), "weight"), F.struct(F.col("cb").alias("community"), F.col("ca").alias("to"), "weight"))).alias("x")).select("x.*").groupBy("community", "to").agg(F.round(F.sum("weight"), 9).alias("w")).where(F.col("w") > weight)
    small = size.where(F.col("n") < least).select("community")
    to = links.join(small, "community", "left_semi").groupBy("community").agg(F.min_by("to", F.struct(-F.col("w"), F.col("to"))).alias("to"))
    return members.join(to, "community", "left").select("entity_id", F.coalesce("to", "community").alias("community"))


def organised(graph: DataFrame, members: DataFrame, level: int = 1, least: int = 2) -> DataFrame:
    """(community_id, level, entities, entity_count, relationship_count) of communities of ``least`` members or more."""
    groups = members.groupBy("community").agg(F.array_sort(F.collect_list("entity_id")).alias("entities"), F.count("*").alias("entity_count")).where(F.col("entity_count") >= least)
    side = lambda x: members.select(F.col("entity_id").alias(x), F.col("community").alias(f"c{x}"))
    inside = graph.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("relationship_count"))
    return groups.join(inside, "community", "left").select(community_id(F.lit(level), F.col("entities")).alias("community_id"), F.lit(level).alias("level"), "entities", "entity_count", F.coalesce("relationship_count", F.lit(0)).alias("relationship_count"))


def pagerank(graph: DataFrame, rounds: int = 20, damping: float = 0.85, normalise: bool = True) -> DataFrame:
    """(entity_id, rank) of a weighted undirected graph (a, b, weight), after a fixed number of rounds; ranks are divided
    by the largest if ``normalise``."""
    ways = graph.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))).alias("x")).select("x.*")
    out = ways.groupBy("src").agg(F.sum("weight").alias("total"))
    share = cut(ways.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    n = out.count()
    ranks = out.select(F.col("src").alias("entity_id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        # every entity has a link, so none is left out of the join
        ranks = share.join(ranks.withColumnRenamed("entity_id", "src"), "src").groupBy(F.col("dst").alias("entity_id")).agg((F.sum(F.col("p") * F.col("rank")) * damping + (1 - damping) / max(n, 1)).alias("rank"))
        if k % 5 == 4:
            ranks = cut(ranks)
    if not normalise:
        return ranks
    return ranks.crossJoin(F.broadcast(ranks.agg(F.max("rank").alias("top")))).select("entity_id", (F.col("rank") / F.col("top")).alias("rank"))
