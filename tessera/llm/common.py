"""What the corpus operators share: reading, text slices, shared intermediates and connected components."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: Bytes of text that one numpy pass takes at once; a longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        got = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(got)
    return got


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read files in the shared folder and nothing is computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like cut() as compressed Parquet, for wide intermediates."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Removes shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows from now on in this session, unless it has set a number itself: a batch of
    the default 10,000 long texts takes hundreds of MB in the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column`` at most, or a single row.

    At the end the process gives free memory back, as executors keep their Python workers for other tasks.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(at, at[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release_memory()


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts and, per text, where its words begin (one more entry at the end)."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[ends]


def string_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its offsets into them."""
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over uint64."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A uint64 hash of each string, from XXH64 over its bytes."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x, seed) for x in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def spread(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``starts`` (one more entry at the end); empty stretches give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 1_000_000:
            a, b = local_forest(*(np.concatenate(x) for x in zip((a, b), *kept)))
            kept, size = [], 0
            if len(a) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])
                a, b = a[:0], b[:0]
    a, b = local_forest(*(np.concatenate(x) for x in zip((a, b), *kept))) if kept else (a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node that links reach) for every node of ``edges`` (src, dst: long).

    Large-star and small-star rounds over the links, which are first thinned to a forest inside each partition;
    every round is written to the shared folder. Nothing but two totals a round reaches the driver.
    """
    now = cut(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(_forest_batches, "src long, dst long").where("src <> dst").distinct())
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("low"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.select("src", "dst", "low").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("low").alias("b")), F.struct(F.col("dst").alias("a"), F.col("low").alias("b")))).alias("e")).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst")).where("src <> dst").distinct()
        now = cut(small)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.groupBy("src").agg(F.min("dst").alias("dst")).select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def pieces_of_bands(banded: DataFrame, limit: int) -> DataFrame:
    """(key, band, piece, half) of (key, band): rows whose bands have two rows or more, dealt so that all pairs of a band meet.

    Bands of at most ``limit`` rows share pieces of about so many rows, with a half of 2: a band is compared with itself. A
    larger one is split into blocks, and each pair of its blocks is a piece: its rows have the halves 0 and 1, or 2 in
    a block's pair with itself.
    """
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    pieces = max(1, -(-int(shared.where(F.col("n") <= limit).agg(F.sum("n")).first()[0] or 0) // limit))
    met = banded.join(shared, "band")
    small = met.where(F.col("n") <= limit).select("key", "band", F.pmod(F.xxhash64("band"), F.lit(pieces)).alias("piece"), F.lit(2).alias("half"))
    parts = F.ceil(F.col("n") / limit)
    block = met.where(F.col("n") > limit).withColumn("me", F.pmod(F.xxhash64("key"), parts)).select("key", "band", "me", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    large = block.select("key", "band", F.xxhash64("band", F.least("me", "other"), F.greatest("me", "other")).alias("piece"), F.when(F.col("me") == F.col("other"), 2).otherwise((F.col("me") > F.col("other")).cast("int")).alias("half"))
    return small.unionByName(large)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model by Newton steps, with a small ridge on standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, weight = np.zeros(a.shape[1]), weight / weight.sum()
    ridge = np.diag([penalty] * x.shape[1] + [1e-9])
    for _ in range(60):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale * mean).sum())


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out, key: str, text: str, label: str, max_rows: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, labels (0 or 1) and weights of at most ``max_rows`` labelled rows of each class that are not held out.

    Rows are taken in the order of a hash of their id. A repeated label row counts once and the larger label holds.
    Texts are whole. A weight is how many labelled rows a row stands for.
    """
    marked = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    marked = marked.where(~F.crc32(F.col("key").cast("string").cast("binary")).isNull()).withColumnRenamed("key", key).where(~held_out)
    total = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [marked.where(F.col("label") == c).orderBy(F.xxhash64(key), key).limit(max_rows) for c in sorted(total)]
    if not picks:
        return pa.array([], pa.string()), np.zeros(0, int), np.zeros(0)
    chosen = picks[0] if len(picks) == 1 else picks[0].unionAll(picks[1])
    chosen = chosen.withColumnRenamed(key, "key")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most 2 * max_rows ids of eight bytes are sent to the executors
    got = texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("key").toArrow().combine_chunks()
    y = got.column("label").to_numpy().astype(int)
    column = got.column("text").combine_chunks() if isinstance(got.column("text"), pa.ChunkedArray) else got.column("text")
    weight = np.array([total[c] / max(1, int((y == c).sum())) for c in y])
    return column, y, weight


def with_scores(docs: DataFrame, model, scores, text: str) -> DataFrame:
    """The columns of ``docs``, then score (double) and predicted (int: 1 from 0.5 on)."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    names = [f"c{i}" for i in range(len(kept.columns))]
    at = kept.columns.index(text)
    schema = kept.toDF(*names).schema.add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names[at]):
            got = scores(model.value, part.column(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return kept.toDF(*names).mapInArrow(run, schema).toDF(*kept.columns, "score", "predicted")
