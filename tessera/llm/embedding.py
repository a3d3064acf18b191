"""Embedding near-dedup by sorted projection passes.

Each pass orders all distinct vectors by a string of random bits, and compares every vector with its next neighbours in
that order; pairs of sufficient cosine are links. A bit tells on which side of a random hyperplane a vector lies. The
hyperplane goes through the middle of the vectors whose bits before are the same, as a sample has it, so bits part a dense
cone of vectors as evenly as scattered ones. How many passes it takes is reckoned from the number of vectors and from how
often such bits tell a sampled vector from another at the threshold. The links of all passes together give components.
Inside a component all pairs count, however many lie between them in every order: small components are compared
whole, and large ones in chunks by the angle to their centre, where the triangle inequality settles most pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_forest, written

BITS, WINDOW = 40, 512
#: The chance to be found that passes are reckoned for, on the average over sampled vectors with a partner at the threshold.
RECALL = 0.98
MIN_PASSES = 6
#: Middles are those of so many sampled vectors at most; every vector is in every pass.
SAMPLE, PARTNERS = 50_000, 1000
#: The first bits have a middle for each string of bits before, down to about so many sampled vectors; the others have one
#: for each string of those first bits.
LEAST, LEVELS = 32, 10
#: Rows between two bounds of a pass, as long as MAX_BLOCKS bounds suffice.
BLOCK, MAX_BLOCKS = 16384, 1000
#: Components of more vectors are compared in chunks of about so many; a component has about MAX_CHUNKS at most.
CHUNK, MAX_CHUNKS = 2048, 1000
#: Rows and columns of one product of a pair of chunks, which grow with components beyond CHUNK * MAX_CHUNKS vectors.
TILE = 2048
#: Degrees in a shell around a component's centre.
SHELL = 0.25


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with vectors of one length; there is one part where all have the same length."""
    size = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(size):
        part = batch if len(size) and (size == d).all() else batch.filter(pa.array(size == d))
        yield part, matrix(part.column(column))


class Order:
    """The bits of some passes for vectors of one length."""

    def __init__(self, sample: np.ndarray, first: int, passes: int, seed: int = 11):
        n, d = sample.shape
        self.passes = passes
        self.planes = np.concatenate([np.random.default_rng([seed, d, first + p]).standard_normal((d, BITS)) for p in range(passes)], axis=1)
        self.levels = int(min(LEVELS, max(0, np.log2(max(n, 1) / LEAST))))
        self.inner = np.zeros((passes, (1 << self.levels) - 1), np.float32)
        self.deep = np.zeros((passes, 1 << self.levels, BITS - self.levels), np.float32)
        for p in range(passes):
            side = sample @ self.planes[:, p * BITS : (p + 1) * BITS]
            groups = [np.arange(n)]
            for level in range(self.levels):
                below = []
                for k, g in enumerate(groups):
                    middle = np.float32(np.median(side[g, level])) if len(g) else np.float32(0)
                    self.inner[p, (1 << level) - 1 + k] = middle
                    below += [g[side[g, level] <= middle], g[side[g, level] > middle]]
                groups = below
            for k, g in enumerate(groups):
                if len(g):
                    self.deep[p, k] = np.median(side[g, self.levels :], axis=0)

    def bits(self, x: np.ndarray, like: np.ndarray | None = None) -> np.ndarray:
        """n x passes x BITS; with ``like``, by the hyperplanes that those vectors meet."""
        side = (x @ self.planes).reshape(len(x), self.passes, BITS)
        lead = side if like is None else (like @ self.planes).reshape(len(x), self.passes, BITS)
        out = np.empty(side.shape, bool)
        node, each = np.zeros((len(x), self.passes), np.int64), np.arange(self.passes)
        for level in range(self.levels):
            middle = self.inner[each, (1 << level) - 1 + node]
            out[:, :, level] = side[:, :, level] > middle
            node = 2 * node + (lead[:, :, level] > middle)
        out[:, :, self.levels :] = side[:, :, self.levels :] > self.deep[each, node]
        return out

    def keys(self, x: np.ndarray, ids: np.ndarray, step: int = 2000) -> np.ndarray:
        """passes x n sort keys: the bits, then bits of a hash of the id, so that equal strings still spread over blocks."""
        code = np.concatenate([self.bits(x[a : a + step]) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)) for a in range(0, max(len(x), 1), step)])
        rest = (ids[:, None] * 2654435761 + np.arange(self.passes) * 40503) & ((1 << 22) - 1)
        return (code << 22 | rest).T


def passes_for(sample: np.ndarray, total: int, window: int, threshold: float, seed: int = 5) -> int:
    """So many passes that a vector and another at the threshold are neighbours in one with a chance of RECALL.

    They are if they share so many first bits that no more vectors than a window holds have the same. The chance to share
    each bit is measured on sampled vectors, each with a partner in a random direction.
    """
    shared = int(np.ceil(max(0.0, np.log2(max(total, 1) / window))))
    if not len(sample) or not shared or sample.shape[1] < 2:
        return MIN_PASSES
    r = np.random.default_rng(seed)
    x = sample[r.permutation(len(sample))[:PARTNERS]]
    away = r.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    trial = Order(sample, 0, 16)
    other = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away
    agree = np.concatenate([(trial.bits(x[a : a + 200]) == trial.bits(other[a : a + 200], x[a : a + 200])).mean(1) for a in range(0, len(x), 200)])
    agree = agree[:, : min(shared, BITS)]
    meet = np.prod((agree * 16 + agree.mean(0) * 4) / 20, axis=1)  # a vector's 16 trials, steadied by the others'
    passes = MIN_PASSES
    while np.mean(1 - (1 - meet) ** passes) < RECALL:
        passes += 1
    return passes


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``names``: tables of complete groups, and where each group begins (one more entry at the end)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        new = _begins(batch, names)
        if len(new) > 1 or (len(held) > 1 and not _same(held[-2], held[-1], names)):
            cut = int(new[-1])
            yield from _table(held[:-1] + [batch.slice(0, cut)], names)
            held = [batch.slice(cut)]
    yield from _table(held, names)


def _begins(t, names: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for n in names:
        x = t.column(n).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, names: list[str]) -> bool:
    return all(a.column(n)[-1] == b.column(n)[0] for n in names)


def _table(held: list[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    t = pa.Table.from_batches(held).combine_chunks() if held else None
    if t is not None and t.num_rows:
        yield t, np.append(_begins(t, names), t.num_rows)


def _window_links(threshold: float, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between rows at most ``window`` places apart in one block, from batches sorted by block and key."""
    tail: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        tail = t.slice(max(0, t.num_rows - window))
        known = 0 if t is batch else t.num_rows - batch.num_rows
        block = t.column("block").to_numpy()
        edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = np.diff(t.column("vec").offsets.to_numpy())
        uid = t.column("uid").to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = matrix(t.column("vec") if len(at) == len(size) else t.column("vec").take(pa.array(at)))
            for a in range(0, len(at), 512):
                b = min(a + 512 + window, len(at))
                i, j = np.nonzero(x[a : a + 512] @ x[a:b].T >= threshold)
                i, j = at[a + i], at[a + j]
                good = (j > i) & (j - i <= window) & (j >= known) & (block[i] == block[j])
                edges[0].append(uid[i[good]])
                edges[1].append(uid[j[good]])
        p, q = local_forest(np.concatenate(edges[0]), np.concatenate(edges[1]))
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["src", "dst"])


def links(vectors: DataFrame, threshold: float, passes: int | None = None, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(src, dst) links that connect what the passes find among (uid, vec)."""
    spark = vectors.sparkSession
    total = vectors.count()
    blocks = int(min(max(1, -(-total // block)), MAX_BLOCKS))
    drawn = vectors.select("uid", "vec").orderBy(F.xxhash64("uid")).limit(SAMPLE).toArrow().combine_chunks().to_batches()
    samples = {x.shape[1]: x for batch in drawn for _, x in by_length(batch)}
    if passes is None:
        passes = max((passes_for(x, -(-total * len(x) // sum(map(len, samples.values()))), window, threshold) for x in samples.values()), default=MIN_PASSES)
    fitted = spark.sparkContext.broadcast({d: Order(x, 0, passes) for d, x in samples.items()})

    def keys(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order = fitted.value.get(x.shape[1]) or Order(x[:0], 0, passes)
        return order.keys(x, ids)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in by_length(batch):
                k = keys(x, part.column("uid").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(passes, dtype=np.int32), len(x))), pa.array(k.ravel())], ["pass", "key"])

    # block bounds, and for each the place up to which its first rows are also shown to the block before
    shares = [x for b in range(1, blocks) for x in (b / blocks, min(1.0, b / blocks + 4 * window / max(total, 1)))]
    found = vectors.select("uid", "vec").mapInArrow(only_keys, "pass int, key long").groupBy("pass").agg(F.percentile_approx("key", shares, 100_000).alias("k")).collect() if shares else []
    bounds = spark.sparkContext.broadcast({r["pass"]: (np.array(r["k"][::2]), np.array(r["k"][1::2])) for r in found})

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for part, x in by_length(batch):
                for p, k in enumerate(keys(x, part.column("uid").to_numpy())):
                    low, ahead = bounds.value.get(p, (none, none))
                    own = np.searchsorted(low, k, "right")
                    early = np.flatnonzero((own > 0) & (k <= np.append(ahead, 0)[own - 1])) if len(low) else np.zeros(0, np.int64)
                    rows = pa.array(np.concatenate((np.arange(len(k)), early)))
                    where = np.concatenate((own, own[early] - 1)) + p * MAX_BLOCKS
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(k).take(rows), part.column("uid").take(rows), part.column("vec").take(rows)], ["block", "key", "uid", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    dealt = vectors.select("uid", "vec").mapInArrow(to_blocks, f"block int, key long, uid long, vec {kind}").repartition("block").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(partial(_window_links, threshold, window), "src long, dst long")


def _group_counts(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the number of vectors linked in its component, from batches sorted by component."""
    for t, at in whole_groups(batches, ["component"]):
        mult, out = t.column("mult").to_numpy(), np.zeros(t.num_rows, np.int64)
        vec = t.column("vec").combine_chunks()
        for a, b in zip(at, at[1:]):
            x = matrix(vec.slice(a, b - a))
            out[a:b] = ((x @ x.T >= threshold) | np.eye(b - a, dtype=bool)) @ mult[a:b]
        yield pa.RecordBatch.from_arrays([t.column("uid").combine_chunks(), pa.array(out)], ["uid", "linked"])


def _pair_counts(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for pairs of chunks; ``side`` is 0 or 1, or 2 in a chunk's pair with itself."""
    for t, at in whole_groups(batches, ["component", "a", "b"]):
        mult, side, out = t.column("mult").to_numpy(), t.column("side").to_numpy(), np.zeros(t.num_rows, np.int64)
        vec = t.column("vec").combine_chunks()
        for a, b in zip(at, at[1:]):
            x, m, s = matrix(vec.slice(a, b - a)), mult[a:b], side[a:b]
            left, right = np.flatnonzero(s != 1), np.flatnonzero(s != 0)
            itself = bool((s == 2).any())
            for i in range(0, len(left), TILE):
                for k in range(0, len(right), TILE):
                    p, q = left[i : i + TILE], right[k : k + TILE]
                    near = x[p] @ x[q].T >= threshold
                    if itself:
                        near |= p[:, None] == q[None, :]
                        out[a + p] += near @ m[q]
                    else:
                        out[a + p] += near @ m[q]
                        out[a + q] += near.T @ m[p]
        yield pa.RecordBatch.from_arrays([t.column("uid").combine_chunks(), pa.array(out)], ["uid", "linked"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, c = matrix(batch.column("vec")), batch.column("component").to_numpy()
        for k in np.unique(c):
            total = x[c == k].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), k)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["component", "i", "v"])


def large_counts(members: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """(uid, linked) of (component, uid, mult, vec) in components too large for one task.

    Shells around a component's centre: by the triangle inequality all vectors of two shells are linked if the shells'
    outer angles add up to the threshold's angle at most, and none are if the shells lie further apart than that. What
    remains is compared chunk by chunk.
    """
    limit = float(np.degrees(np.arccos(threshold)))
    centre = members.select("component", "vec").mapInArrow(_sums, "component long, i int, v double").groupBy("component", "i").agg(F.sum("v").alias("v")).groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(F.try_divide(dot("vec", "centre"), F.sqrt(dot("vec", "vec")) * F.sqrt(dot("centre", "centre"))), F.lit(0.0))))
    shelled = members.join(centre, "component").select("component", "uid", "mult", "vec", F.floor(F.degrees(F.acos(cosine)) / SHELL).cast("int").alias("shell"))
    shells = shelled.groupBy("component", "shell").agg(F.sum("mult").alias("mult"), F.count("*").alias("n"))
    total = shells.groupBy("component").agg(F.sum("n").alias("total"))
    size = F.greatest(F.lit(chunk), F.col("total") / MAX_CHUNKS)
    shells = shells.join(total, "component").select("component", "shell", "mult", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    other = shells.select("component", F.col("shell").alias("shell2"), F.col("mult").alias("mult2"), F.col("parts").alias("parts2"))
    both = shells.join(other, "component")
    sure = (F.col("shell") + F.col("shell2") + 2) * SHELL <= limit - 1e-6
    open_ = ~sure & ((F.abs(F.col("shell") - F.col("shell2")) - 1) * SHELL <= limit + 1e-6)
    settled = both.where(sure).groupBy("component", "shell").agg(F.sum("mult2").alias("linked"))
    number = lambda shell, part: shell.cast("long") * 1_000_000 + part
    cells = both.where(open_).select("component", "shell", "shell2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "parts2").select("component", number(F.col("shell"), F.col("p")).alias("a"), "shell2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)).alias("p2")).select("component", "a", number(F.col("shell2"), F.col("p2")).alias("b")).where("a <= b")
    placed = shelled.join(shells.select("component", "shell", "parts"), ["component", "shell"]).withColumn("me", number(F.col("shell"), F.pmod(F.xxhash64("uid"), F.col("parts"))))
    sides = cells.withColumn("me", F.col("a")).withColumn("side", F.when(F.col("a") == F.col("b"), 2).otherwise(0)).unionByName(cells.where("a <> b").withColumn("me", F.col("b")).withColumn("side", F.lit(1)))
    shown = placed.join(sides, ["component", "me"]).select("component", "a", "b", "side", "uid", "mult", "vec").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "side", "uid")
    compared = shown.mapInArrow(partial(_pair_counts, threshold), "uid long, linked long")
    return shelled.join(settled, ["component", "shell"]).select("uid", "linked").unionByName(compared).groupBy("uid").agg(F.sum("linked").alias("linked"))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, passes: int | None = None, window: int = WINDOW, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Links join vectors of one length whose cosine, in double precision, is ``threshold`` at least. A vector that is
    null, empty, zero or has null or non-finite components links with nothing, nor does a row whose key is null.
    Repeated rows are vectors of their own that link with each other; equal vectors are compared once, whatever their
    number. An empty table gives no rows; other columns are not read.
    """
    element = rows.schema[vector].dataType.elementType
    vec = F.col(vector) if element.typeName() in ("float", "double") else F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", bad), F.lit(False))
    all_rows = rows.select(F.col(key).cast("long").alias("vec_id"), vec.alias("vec")).withColumn("vec", F.when(usable, F.col("vec"))).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit("second"), "vec")})
    own = written(all_rows.where("vec is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"), F.first("vec").alias("vec")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    found = connected_components(links(own, threshold, passes, window, block))
    members = written(own.select("uid", "mult", "first_id", "vec").join(found.withColumnRenamed("node", "uid"), "uid"), "members")
    groups = members.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size"))
    sized = members.join(groups, "component")
    small = sized.where(F.col("size") <= chunk).select("component", "uid", "mult", "vec").repartition("component").sortWithinPartitions("component", "uid").mapInArrow(partial(_group_counts, threshold), "uid long, linked long")
    large = large_counts(sized.where(F.col("size") > chunk).select("component", "uid", "mult", "vec"), threshold, chunk)
    counted = small.unionByName(large)
    named = own.select("k1", "k2", "uid", "mult", "first_id").join(counted, "uid", "left").join(sized.select("uid", "component_id"), "uid", "left")
    per_vector = named.select("k1", "k2", (F.coalesce("linked", "mult") - 1).alias("n"), F.coalesce("component_id", "first_id").alias("c"))
    alone = F.col("vec").isNull()
    # rows without a vector match nothing, and lie in all partitions
    out = all_rows.select("vec_id", alone.alias("alone"), F.when(alone, F.xxhash64("vec_id")).otherwise(F.col("k1")).alias("k1"), F.when(~alone, F.col("k2")).alias("k2")).join(per_vector, ["k1", "k2"], "left")
    component = F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.when(F.col("alone"), F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, CASE WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 THEN v END AS v FROM t),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM u UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
