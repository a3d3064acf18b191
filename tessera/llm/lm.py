"""Language-model scoring: a log-bilinear model over word classes, trained by noise-contrastive estimation.

The most frequent training tokens are classes of their own; all other tokens fall into classes by their last bytes.
A token's probability is the model's probability of its class after the class of the token before, times the
token's smoothed share of its class, so the probabilities of all tokens, with one symbol for what is unknown in a
class, sum to one. All counts are of all training rows: token counts stay a distributed table, and the neural model
is trained on the counts of all neighbouring classes. There are as many classes as leave PAIR_TOKENS training tokens to
each pair of them, so what is gathered of contexts grows with the corpus, from CLASSES ** 2 numbers up to
MOST_CLASSES ** 2: that bound is the fitted model's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_strings, mix, slices, small_batches, string_bytes, words, written

#: The least and the largest number of classes, and the training tokens that each pair of classes has at least.
CLASSES, MOST_CLASSES, PAIR_TOKENS = 512, 4096, 256
#: Of the least number of classes, those that are one token's own: half, as of any number. Class 0 is the end of a text,
#: whose token is the empty string.
SINGLE = CLASSES // 2
#: Tokens of at least 1 / FREQUENT of the training tokens and of at most SHORT bytes are sent to all executors: there
#: are at most FREQUENT of them, so at most FREQUENT * (SHORT + 8) bytes. All other tokens are joined.
FREQUENT, SHORT = 1_000_000, 32
DIM, NOISE, STEPS = 48, 10, 400
#: Contexts that training works on at a time.
ROWS = 512


def class_count(tokens: int) -> int:
    """How many classes a corpus of so many training tokens gets: a power of two."""
    n = CLASSES
    while n < MOST_CLASSES and (2 * n) ** 2 * PAIR_TOKENS <= tokens:
        n *= 2
    return n


def spelled_class(tokens: pa.Array, size: int = CLASSES) -> np.ndarray:
    """The class, of ``size``, of each token that has none of its own, from its last three bytes."""
    data, at = string_bytes(tokens)
    code = np.zeros(len(tokens), np.uint64)
    for k in range(1, 4):
        where = at[1:] - k
        inside = where >= at[:-1]
        code[inside] |= data[where[inside]].astype(np.uint64) << np.uint64(8 * k)
    return (size // 2 + (mix(code) % np.uint64(size - size // 2))).astype(np.int64)


@dataclass
class Vocabulary:
    """The frequent tokens with their counts and classes, in the order of their hashes. The end token is always one."""

    tokens: pa.Array
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    size: int = CLASSES

    @property
    def single(self) -> int:
        return self.size // 2

    @classmethod
    def of(cls, tokens: pa.Array, counts: np.ndarray, size: int = CLASSES) -> Vocabulary:
        if not pc.any(pc.equal(tokens, "")).as_py():
            tokens, counts = pa.concat_arrays([tokens, pa.array([""], pa.string())]), np.append(counts, 0)
        order = pc.sort_indices(pa.table({"c": counts, "t": tokens}), [("c", "descending"), ("t", "ascending")])
        tokens, counts = tokens.take(order), counts[order.to_numpy()]
        end = pc.equal(tokens, "").to_numpy(zero_copy_only=False)
        classes = spelled_class(tokens, size)
        own = np.flatnonzero(~end)[: size // 2 - 1]
        classes[own] = np.arange(1, len(own) + 1)
        classes[end] = 0
        hashes = hash_strings(tokens)
        order = np.argsort(hashes, kind="stable")
        return cls(tokens.take(pa.array(order)), hashes[order], counts[order], classes[order], size)

    def look_up(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it is here, count, class) of each token; counts of tokens that are not here are 0."""
        classes, counts = spelled_class(tokens, self.size), np.zeros(len(tokens), np.int64)
        if not len(tokens):
            return np.zeros(0, bool), counts, classes
        at = np.minimum(np.searchsorted(self.hashes, hash_strings(tokens)), len(self.hashes) - 1)
        here = pc.equal(self.tokens.take(pa.array(at)), tokens).to_numpy(zero_copy_only=False)
        counts[here], classes[here] = self.counts[at[here]], self.classes[at[here]]
        return here, counts, classes


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, the code of every token, where each text's tokens begin); an end token closes each text."""
    flat, at = words(texts, lower=True)
    enc = pc.dictionary_encode(flat)
    distinct = pa.concat_arrays([enc.dictionary.cast(pa.string()), pa.array([""], pa.string())])
    codes = np.insert(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), at[1:], len(distinct) - 1)
    return distinct, codes, at + np.arange(len(at))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            distinct, codes, _ = coded(part.column(0))
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)))], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def class_totals(counts: DataFrame, vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct tokens in each class."""
    size = vocabulary.value.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            _, _, classes = vocabulary.value.look_up(b.column(0))
            n += np.bincount(classes, b.column(1).to_numpy(), size).astype(np.int64)
            v += np.bincount(classes, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    got = counts.select("token", "c").mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(size), np.zeros(size)
    for r in got:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def neighbour_counts(docs: DataFrame, vocabulary) -> np.ndarray:
    """A number for each two classes: how often a token of the second follows one of the first, in all texts of ``docs``
    (text)."""
    size = vocabulary.value.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for part in slices(batches):
            found = pairs(part.column(0), vocabulary.value)[0]
            if len(found) * 4 < len(cells):
                some, n = np.unique(found, return_counts=True)
                cells[some] += n
            else:
                cells += np.bincount(found, minlength=len(cells))
        full = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def pairs(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """(class before * the number of classes + class of every token, distinct tokens, codes, begins; whether each distinct token is in the
    vocabulary, its count and its class)."""
    distinct, codes, at = coded(texts)
    here, counts, classes = vocabulary.look_up(distinct)
    now = classes[codes]
    before = np.concatenate(([0], now[:-1]))  # a text begins after the end of another, of class 0
    return before * vocabulary.size + now, distinct, codes, at, here, counts, classes


def train(counts: np.ndarray, used: np.ndarray | None = None, seed: int = 3) -> np.ndarray:
    """Normalised log10 probabilities of a class (column) after a class (row), 0 for classes that are not ``used``.

    Scores are bilinear: the context's vector is mapped to a predicted vector, whose product with a class's vector and
    that class's bias is the score. Noise-contrastive estimation tells each observed class from NOISE drawn by class
    frequency; as both are known for every pair of classes, each step takes the whole expected objective.
    """
    n = len(counts)
    total = max(counts.sum(), 1.0)
    q = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)
    r = np.random.default_rng(seed)
    p = {"context": r.standard_normal((n, DIM)) * 0.1, "map": np.eye(DIM) + r.standard_normal((DIM, DIM)) * 0.01, "word": r.standard_normal((n, DIM)) * 0.1, "bias": np.log(q)}
    follows = counts.sum(1, keepdims=True)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, STEPS + 1):
        g = {k: np.zeros_like(x) for k, x in p.items()}
        for some in (slice(a, a + ROWS) for a in range(0, n, ROWS)):
            predicted = p["context"][some] @ p["map"]
            score = predicted @ p["word"].T + p["bias"]
            real = 1 / (1 + np.exp(np.clip(np.log(NOISE * q) - score, -30, 30)))
            d = (counts[some] * (1 - real) - NOISE * follows[some] * q * real) / total
            to_map = d @ p["word"]
            g["context"][some] = to_map @ p["map"].T
            g["map"] += p["context"][some].T @ to_map
            g["word"] += d.T @ predicted
            g["bias"] += d.sum(0)
        rate = 0.03 * (1 - 0.95 * t / STEPS)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-12)
    out = np.empty((n, n))
    for some in (slice(a, a + ROWS) for a in range(0, n, ROWS)):
        score = p["context"][some] @ p["map"] @ p["word"].T + p["bias"]
        if used is not None:
            score[:, ~used] = -np.inf
        score -= score.max(1, keepdims=True)
        out[some] = (score - np.log(np.exp(score).sum(1, keepdims=True))) / np.log(10)
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    log_after: np.ndarray
    log_class_size: np.ndarray
    tokens: int
    distinct: int


def rare_rows(docs: DataFrame, model) -> DataFrame:
    """Per text what needs no join, and its rare tokens with their numbers, for the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        after = m.log_after.ravel()
        for part in slices(batches):
            cells, distinct, codes, at, here, counts, classes = pairs(part.column("text"), m.vocabulary)
            n = np.diff(at)
            total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[at])
            log_count = np.where(here, np.log10(counts + 0.5), 0.0)
            in_class = np.where(classes >= m.vocabulary.single, log_count - m.log_class_size[classes], 0.0)
            neural = total(after[cells])
            rare = np.flatnonzero(~here[codes])
            doc = np.repeat(np.arange(len(n)), n)[rare]
            key, times = np.unique(doc * len(distinct) + codes[rare], return_counts=True)
            begins = np.searchsorted(key, np.arange(len(n) + 1) * len(distinct)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(n),
                    pa.array(total((counts > 0)[codes]).astype(np.int64)),
                    pa.array(total(log_count[codes])),
                    pa.array(neural + total(in_class[codes])),
                    pa.ListArray.from_arrays(pa.array(begins), distinct.take(pa.array(key % len(distinct)))),
                    pa.ListArray.from_arrays(pa.array(begins), pa.array(times.astype(np.int32))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<string>, times array<int>")


def held_out_column(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def fit(learned: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts of ``learned`` (text), and the table of all their token counts."""
    spark = learned.sparkSession
    counts = written(token_counts(learned), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where((F.col("c") * FREQUENT >= n) & (F.octet_length("token") <= SHORT) & ((F.col("c") > 1) | (F.col("token") == ""))).toArrow().combine_chunks()
    tokens = pa.concat_arrays([pa.array([], pa.string()), *frequent.column("token").cast(pa.string()).chunks])
    vocabulary = Vocabulary.of(tokens, frequent.column("c").to_numpy(), class_count(n))
    shipped = spark.sparkContext.broadcast(vocabulary)
    class_n, class_v = class_totals(counts, shipped)
    # a class of its own without a token gets no probability
    used = np.arange(vocabulary.size) >= vocabulary.single
    used[vocabulary.classes] = True
    after = train(neighbour_counts(learned, shipped), used)
    return Model(vocabulary, after, np.log10(class_n + 0.5 * (class_v + 1)), n, v), counts


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), whole texts.

    A null or empty text is its end token alone; rows with a null key are learned from; repeated rows are learned
    from and scored each; without training rows every token is unknown; an empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out_column(key).alias("held_out"), F.col(text).cast("string").alias("text"))
    model, counts = fit(rows.where("not held_out").select("text"))
    parts = written(rare_rows(rows, spark.sparkContext.broadcast(model)).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    found = rare.join(counts, "token", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"))
    size = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    log = F.coalesce("rare_log", F.lit(0.0))
    return parts.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + log - F.col("n_tokens") * size).alias("base_score"), (F.col("score") + log).alias("score")
    )
