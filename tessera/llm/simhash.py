"""SimHash near-duplicates: 64-bit fingerprints, sharded by a vantage-point tree, linked exactly up to a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, hash_strings, local_forest, mix, pieces_of_bands, slices, small_batches, string_bytes, words, written

#: Distinct fingerprints a leaf of the shipped tree is meant to hold; a task splits its leaves on by further vantage points,
#: so a leaf of many more takes memory in proportion (16 bytes a fingerprint) and not their square.
LEAF = 4000
#: The tree's top is fitted on so many fingerprints at most; every fingerprint is indexed and queried. It has SAMPLE / 8
#: leaves at most, which hold LEAF fingerprints up to 32 million of them, and a million each at 8 billion.
SAMPLE = 100_000
#: Spreads the bits of a byte over the bytes of a 64-bit word, so that eight counters add at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 SimHash of each text: XXH64 of its word shingles, bit by bit a majority; 0 without words."""
    from xxhash import xxh64_intdigest

    flat, at = words(texts, lower=True)
    n_words = np.diff(at)
    out = np.zeros(len(texts), np.uint64)
    if not len(flat):
        return out
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat), " ")
    data, text_at = string_bytes(joined)
    buffer = data.tobytes()
    length = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length + 1) - 1
    doc = np.repeat(np.arange(len(texts)), n_words)
    # a joined text has one space less than it has words
    ends = ends - doc + np.cumsum(n_words == 0)[doc] + text_at[0]
    starts = ends - length
    first = np.flatnonzero(np.arange(len(flat)) - at[:-1][doc] <= np.maximum(n_words - shingle, 0)[doc])
    last = np.minimum(first + shingle - 1, at[1:][doc[first]] - 1)
    h = np.fromiter((xxh64_intdigest(buffer[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    full = np.flatnonzero(n_words)
    per_doc = np.maximum(n_words[full] - shingle + 1, 1)
    begin = np.cumsum(per_doc) - per_doc
    # counters of one byte: stretches of 255 shingles at most, then a sum of the stretches of each text
    pieces = -(-per_doc // 255)
    piece_at = np.cumsum(pieces) - pieces
    inside = np.arange(int(pieces.sum())) - np.repeat(piece_at, pieces)
    counts = np.add.reduceat(_LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)], np.repeat(begin, pieces) + inside * 255, axis=0)
    counts = np.add.reduceat(counts.view(np.uint8).reshape(-1, 64), piece_at, axis=0, dtype=np.int64)
    out[full] = np.packbits(counts * 2 > per_doc[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint: the 64 bits as a signed long) of every row; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1), shingle).view(np.int64))], ["key", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, fingerprint long")


def fit_tree(sample: np.ndarray, depth: int, radius: int, seed: int | None = None) -> list[tuple[int, int]]:
    """A full binary vantage-point tree in heap order: (vantage point, boundary) of each inner node. Each seed gives other
    vantage points, which need not be fingerprints of the sample.

    The boundary is near the median distance, where the fewest of the sample lie just outside of it, as those are
    what both sides have to hold.
    """
    tree: list[tuple[int, int]] = []
    r = np.random.default_rng(seed)
    groups = [np.sort(sample)]
    for _ in range(depth):
        below = []
        for g in groups:
            if not len(g):
                tree.append((0, 32))
                below += [g, g]
                continue
            point = int(g[len(g) // 2]) if seed is None else int(r.integers(0, 1 << 64, dtype=np.uint64))
            d = np.bitwise_count(g ^ np.uint64(point)).astype(int)
            by = np.bincount(d, minlength=66 + radius)
            mid = int(np.median(d))
            edge = min(range(max(0, mid - 1), mid + 1), key=lambda r: by[r + 1 : r + radius + 1].sum())
            tree.append((point, edge))
            below += [g[d <= edge], g[d > edge]]
        groups = below
    return tree


def route(fp: np.ndarray, tree: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs. A row outside a boundary by ``radius`` bits at most goes to both sides; by the triangle
    inequality any two rows that close to each other then share a leaf."""
    rows, leaves = [], []
    stack = [(0, np.arange(len(fp)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node >= len(tree):
            rows.append(at)
            leaves.append(np.full(len(at), node - len(tree)))
            continue
        point, edge = tree[node]
        d = np.bitwise_count(fp[at] ^ np.uint64(point)).astype(int)
        stack += [(2 * node + 1, at[d <= edge + radius]), (2 * node + 2, at[d > edge])]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def leaf_links(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the rows of one leaf that connects all pairs within ``radius`` bits; large leaves are split on."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stack = [np.arange(len(fp))]
    while stack:
        at = stack.pop()
        if len(at) > 1024:
            d = np.bitwise_count(fp[at] ^ fp[at[len(at) // 2]]).astype(int)
            edge = int(np.median(d))
            inner, outer = at[d <= edge + radius], at[d > edge]
            if len(inner) < len(at):
                stack += [inner, outer]
                continue
        for i in range(0, len(at), 512):
            x, y = np.nonzero(np.bitwise_count(fp[at[i : i + 512], None] ^ fp[None, at[i:]]) <= radius)
            real = y > x
            if real.any():
                p, q = local_forest(node[at[i + x[real]]], node[at[i + y[real]]])
                a.append(p)
                b.append(q)
    return local_forest(np.concatenate(a), np.concatenate(b))


def components(rows: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(fingerprint, component: the smallest key reachable by links of ``radius`` bits at most) per distinct fingerprint.

    ``rows``: (key, fingerprint). Equal fingerprints are one row from the start, so groups of copies of any size cost
    one comparison; links inside a leaf are thinned to a forest before they leave it. Null keys take no part.
    """
    spark = rows.sparkSession
    own = cut(rows.where("key is not null").groupBy("fingerprint").agg(F.min("key").alias("key")))
    total = own.count()
    depth = max(0, int(np.ceil(np.log2(max(total, 1) / leaf))))
    depth = min(depth, int(np.log2(max(sample // 8, 1))))
    drawn = own.select("fingerprint").orderBy(F.xxhash64("fingerprint")).limit(min(sample, 64 << depth)).toPandas() if depth else None
    tree = fit_tree(drawn["fingerprint"].to_numpy(np.int64).view(np.uint64), depth, radius) if depth else []
    shipped = spark.sparkContext.broadcast(tree)

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = route(b.column("fingerprint").to_numpy().view(np.uint64), shipped.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), b.column("fingerprint").take(pa.array(at)), b.column("key").take(pa.array(at))], ["leaf", "fingerprint", "key"])

    def link(t: pa.Table) -> pa.Table:
        a, b = leaf_links(t.column("fingerprint").to_numpy().view(np.uint64), t.column("key").to_numpy(), radius)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    edges = own.select("fingerprint", "key").mapInArrow(to_leaves, "leaf int, fingerprint long, key long").groupBy("leaf").applyInArrow(link, "src long, dst long")
    groups = connected_components(edges).withColumnRenamed("node", "key")
    return own.join(groups, "key", "left").select("fingerprint", F.coalesce("component", "key").alias("component"))


def hexadecimal(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    A null or wordless text has fingerprint zero and is linked like any other; repeated rows share a component and
    each gives a row; a row whose key is null has a null component; an empty table gives no rows; other columns
    of ``docs`` are not read.
    """
    rows = cut(fingerprint_rows(docs, key, text, shingle))
    found = components(rows, radius)
    return rows.join(found, "fingerprint", "left").select(F.col("key").alias("doc_id"), hexadecimal(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("key").isNotNull(), F.col("component")).alias("component_id"))


# Near copies beyond the exact radius: candidates share a band of minimal hashes, and are verified by sketches

#: Bins of shingle hashes. A sketch has two bits for each: whether it has a shingle, and a bit of the smallest hash in it.
BINS = 4096
#: Bins that the bands are picked from, each the union of neighbouring ones.
BAND_BINS = 512
SKETCH_BYTES = BINS // 4
#: A band is SLOTS minimal hashes. Texts of Jaccard index j share one of the BANDS bands with a chance of
#: 1 - (1 - j ** SLOTS) ** BANDS, .998 at .8, however many other texts there are.
BANDS, SLOTS = 16, 5
#: Rows that are compared with each other in one piece; a band of more rows is compared in pairs of blocks.
BAND_ROWS = 4000
#: Bits at which two fingerprints of 3-word shingles are candidates for a Jaccard index of .8 of 5-word shingles.
CANDIDATE_BITS = 20
#: For each slot, the order in which bins are looked at until one is not empty.
_ORDER = np.random.default_rng(23).permuted(np.tile(np.arange(BAND_BINS, dtype=np.int32), (BANDS * SLOTS, 1)), axis=1)
#: The value of a bin without shingles.
_EMPTY = 0xFFFFFFFF


def lowest(texts: pa.Array, shingle: int = 5) -> np.ndarray:
    """texts x BINS of uint32: the smallest hash of a text's word shingles in each bin, _EMPTY without one. A text of fewer
    words is one shingle."""
    flat, at = words(texts, lower=True)
    low = np.full(len(texts) * BINS, _EMPTY, np.uint32)
    if not len(flat):
        return low.reshape(-1, BINS)
    enc = pc.dictionary_encode(flat)
    h = hash_strings(enc.dictionary, 5)[enc.indices.to_numpy(zero_copy_only=False)]
    n = np.diff(at)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(shingle):
        ahead = np.zeros(len(h), np.uint64)
        ahead[: len(h) - k] = mix(h[k:] + np.uint64(k))
        inside = np.arange(len(h)) + k < np.repeat(at[1:], n)
        rolled += np.where(inside, ahead, np.uint64(0))
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    use = place <= np.repeat(np.maximum(n - shingle, 0), n)
    g = mix(rolled[use])
    slot = np.repeat(np.arange(len(texts)), n)[use] * BINS + (g % np.uint64(BINS)).astype(np.int64)
    value = (g >> np.uint64(32)).astype(np.uint32)
    np.minimum.at(low, slot, value)
    return low.reshape(-1, BINS)


def to_sketches(low: np.ndarray) -> np.ndarray:
    """texts x BINS / 32 of uint64: a bit for each bin that is not empty, then a bit of each bin's smallest hash, which its
    size does not tell."""
    full = low != _EMPTY
    value = full & (mix(low.astype(np.uint64)) & np.uint64(1)).astype(bool)
    return np.packbits(np.concatenate((full, value), axis=1), axis=1).view(np.uint64)


def sketches(texts: pa.Array, shingle: int = 5) -> np.ndarray:
    return to_sketches(lowest(texts, shingle))


def band_keys(low: np.ndarray) -> np.ndarray:
    """texts x BANDS of int64: a hash of SLOTS minimal hashes each. A slot takes the first bin in its order that is not empty,
    so two texts agree in it with the chance of their Jaccard index, also where most bins are empty."""
    low = low.reshape(len(low), BAND_BINS, -1).min(2)
    pick = np.tile(_ORDER[:, 0], (len(low), 1))
    row, slot = np.nonzero((low[np.arange(len(low))[:, None], pick] == _EMPTY) & (low != _EMPTY).any(1)[:, None])
    for k in range(1, BAND_BINS):
        if not len(row):
            break
        pick[row, slot] = _ORDER[slot, k]
        still = low[row, _ORDER[slot, k]] == _EMPTY
        row, slot = row[still], slot[still]
    value = mix(low[np.arange(len(low))[:, None], pick].astype(np.uint64) << np.uint64(9) | pick.astype(np.uint64)).reshape(-1, BANDS, SLOTS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(low), 1))
    for k in range(SLOTS):
        out = mix(out * np.uint64(31) + value[:, :, k])
    return out.view(np.int64)


def estimated_jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the bins that either text fills, the share whose smallest hash is that of both. Two different ones have equal
    bits half the time, so those that differ count twice."""
    half = a.shape[1] // 2
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    both, either = a[:, :half] & b[:, :half], count(a[:, :half] | b[:, :half])
    return np.maximum(count(both) - 2 * count(both & (a[:, half:] ^ b[:, half:])), 0) / np.maximum(either, 1)


def candidates(fp: np.ndarray, band: np.ndarray, half: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by band, that share it and are within so many bits; of a pair of two blocks (halves 0 and 1)
    those across, while a half of 2 is compared with itself."""
    at, ahead = np.arange(len(fp)), 1
    p, q, size = [], [], 0
    while True:
        at = at[at + ahead < len(fp)]
        at = at[band[at] == band[at + ahead]]
        if not len(at):
            break
        to = at + ahead
        near = (np.bitwise_count(fp[at] ^ fp[to]) <= bits) & ((half[at] == 2) | (half[at] != half[to]))
        p.append(at[near])
        q.append(to[near])
        size += len(p[-1])
        if size > 20_000:
            yield np.concatenate(p), np.concatenate(q)
            p, q, size = [], [], 0
        ahead += 1
    if size:
        yield np.concatenate(p), np.concatenate(q)


def sketch_links(fp: np.ndarray, sketch: np.ndarray, node: np.ndarray, band: np.ndarray, half: np.ndarray, bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the nodes of rows, sorted by band, that connects all candidates of enough similarity. Pairs that are
    connected already are not compared, so a large group of near copies costs about one comparison a row once it has
    come together."""
    nodes, label = np.unique(node, return_inverse=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in candidates(fp, band, half, bits):
        for k in range(0, len(x), 20_000):
            p, q = x[k : k + 20_000], y[k : k + 20_000]
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            near = estimated_jaccard(sketch[p], sketch[q]) >= similarity
            if near.any():
                p, q = p[near], q[near]
                a.append(node[p])
                b.append(node[q])
                low, high = local_forest(label[p], label[q])
                to = np.arange(len(nodes))
                to[low] = high
                label = to[label]
    return local_forest(np.concatenate(a), np.concatenate(b))


def _groups(docs: DataFrame, key: str, text: str, order: str, radius: int, shingle: int, similarity: float, sketch_shingle: int, leaf: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups). rows: (key, order, fingerprint, sketch, bands) of every row; groups: (fingerprint, sketch, bands,
    component, least: the smallest (order, key) of the group's rows) of every group of rows with one text.

    Only groups are linked, so a group of copies of any size is one node with its own links.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            low = lowest(part.column(2), sketch_shingle)
            at = pa.py_buffer((np.arange(len(low) + 1) * SKETCH_BYTES).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(low), [None, at, pa.py_buffer(to_sketches(low))])
            banded = pa.ListArray.from_arrays(pa.array((np.arange(len(low) + 1) * BANDS).astype(np.int32)), pa.array(band_keys(low).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprints(part.column(2), shingle).view(np.int64)), packed, banded], ["key", "order", "fingerprint", "sketch", "bands"])

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("order"), F.col(text).cast("string").alias("text"))
    rows = written(chosen.mapInArrow(run, "key long, order long, fingerprint long, sketch binary, bands array<long>"), "sketches")
    exact = components(rows, radius, sample=sample)
    own = cut(rows.where("key is not null").groupBy("fingerprint", "sketch", "bands").agg(F.min("key").alias("key"), F.min(F.struct("order", "key")).alias("least")))
    dealt = pieces_of_bands(own.select("key", F.explode("bands").alias("band")), leaf)

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("band")
        fp = t.column("fingerprint").to_numpy().view(np.uint64)
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(fp), -1)
        a, b = sketch_links(fp, s, t.column("key").to_numpy(), t.column("band").to_numpy(), t.column("half").to_numpy(), CANDIDATE_BITS, similarity)
        return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})

    similar = dealt.join(own.select("fingerprint", "sketch", "key"), "key").groupBy("piece").applyInArrow(link, "src long, dst long")
    # a group's key and the smallest key within the radius, which is a group's key too
    close = own.join(exact, "fingerprint").select(F.col("key").alias("src"), F.col("component").alias("dst"))
    found = connected_components(similar.unionByName(close)).withColumnRenamed("node", "key")
    return rows, own.join(found, "key", "left").select("fingerprint", "sketch", "bands", F.coalesce("component", "key").alias("component"), "least")


def near_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, similarity: float = 0.8, sketch_shingle: int = 5, leaf: int = BAND_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(key, component) of every row: links of near_duplicates(), and of texts whose 5-word shingles have an estimated
    Jaccard index of ``similarity`` at least.

    The first kind is exact. For the second, texts that share a band are candidates, whose number of rows does not
    change the chance to share one; only bands of two rows or more are dealt with sketches, in pieces of about ``leaf``
    rows. A band of more rows is compared whole, in pairs of blocks. Candidates are up to CANDIDATE_BITS apart.
    Estimates from BINS bins have a standard error of about .009 near .8 for long texts, and less for texts of fewer shingles
    than bins. Rows with a null key have a null component; a null text is empty, and empty texts are copies of each other;
    repeated rows give a row each; an empty table gives no rows; other columns are not read. Equal texts are one node
    from the start, and get its component by a join whose large keys AQE can split.
    """
    rows, groups = _groups(docs, key, text, key, radius, shingle, similarity, sketch_shingle, leaf, sample)
    found = cut(groups.select("fingerprint", "sketch", "bands", "component"))
    named = rows.select("key", "fingerprint", "sketch", "bands").join(found, ["fingerprint", "sketch", "bands"], "left")
    return named.select("key", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their component by near_documents(); rows with a null key stay.

    A row is known by its key and a hash of its text: of rows equal in both one stays, while rows that only share a key
    are documents of their own. Of a component's rows with the smallest key (a tie) the one of the smallest hash stays.
    A null text is empty, and empty texts are copies of each other; an empty table stays empty; the other columns of
    ``docs`` pass through whatever their names, and of rows equal in key and text any one's values are kept.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, content = (names[docs.columns.index(c)] for c in (key, text))
    rows = docs.toDF(*names).withColumns({"id": F.col(own).cast("long"), "row": F.when(F.col(own).cast("long").isNotNull(), F.xxhash64(F.col(own).cast("long"), F.col(content).cast("string")))})
    _, groups = _groups(rows, "row", content, "id", radius, shingle, similarity, 5, BAND_ROWS, SAMPLE)
    first = groups.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.order").alias("id"), F.col("least.key").alias("row"))
    kept = rows.join(first, ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    return kept.unionByName(rows.where("row is null")).select(*names).toDF(*docs.columns)
