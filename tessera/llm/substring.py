"""Substring dedup by seed and extend.

Seeds: of all grams of GRAM words in a window, the one with the smallest hash is the window's anchor, so two equal
windows have the same anchor. Anchors that occur once in the corpus rule their windows out. Extension: windows around
the anchors that repeat are joined by a 96-bit hash of all their words; a run of neighbouring
windows that repeat is a maximal repeat, and its words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, free_shuffles, hash_strings, mix, slices, small_batches, words, written

WINDOW = 35
GRAM = 6
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Windows with at least 1 / MOST_FREQUENT of all rows are joined by a broadcast of 12 bytes each.
MOST_FREQUENT = 50_000
#: Bytes of text that one pass over words takes at once.
PART_BYTES = SLICE_BYTES


def run_hashes(h: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of every ``size`` successive entries of ``h`` (uint64), equal for equal stretches wherever they are.

    A polynomial in ``base`` modulo 2**64, put together from stretches whose lengths are powers of two.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    have, span = h.astype(np.uint64), 1
    while True:
        if size & span:
            out = out * np.uint64(pow(base, span, 1 << 64)) + have[done : done + n]
            done += span
        if span * 2 > size:
            return mix(out)
        have = have[:-span] * np.uint64(pow(base, span, 1 << 64)) + have[span:]
        span *= 2


def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``size`` successive entries."""
    have, span = x, 1
    while span * 2 <= size:
        have = pick(have[:-span], have[span:])
        span *= 2
    return pick(have[: len(have) - (size - span)], have[size - span :]) if size > span else have


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A hash of every word, where each text's words begin, and the words."""
    flat, at = words(texts)
    enc = pc.dictionary_encode(flat)
    return hash_strings(enc.dictionary)[enc.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64), at, flat


def anchors(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the anchor hash of the window at each place, 0 where none fits into its text; all places of anchors; the gram
    hashes at all places)."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = run_hashes(h, gram)
    span = window - gram + 1
    low = sliding(g, span, np.minimum)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    low[doc[: len(low)] != doc[window - 1 :]] = 0
    edge = np.zeros(span - 1, np.uint64)
    return low, np.flatnonzero(sliding(np.concatenate((edge, low, edge)), span, np.maximum) == g), g


def _seed_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART_BYTES):
            h, at, _ = word_hashes(part.column("text"))
            _, place, g = anchors(h, at, window, gram)
            found = np.empty(len(place), [("doc", np.int64), ("anchor", np.uint64)])
            found["doc"], found["anchor"] = np.searchsorted(at, place, "right") - 1, g[place]
            found, times = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found["anchor"].view(np.int64)), part.column("k1").take(pa.array(found["doc"])), pa.array(times.astype(np.int32))], ["anchor", "k1", "times"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    c = zstandard.ZstdCompressor(level=1)
    for part in slices(batches):
        texts = pa.array([c.compress(x) for x in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), texts], ["doc_id", "k1", "k2", "packed"])


def _unpack(column: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


def _joined(flat: pa.Array, at: np.ndarray) -> pa.Array:
    """The words of each text joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat), " ")


def _digests(texts: pa.Array, wanted: np.ndarray) -> list[str | None]:
    return [hashlib.sha256(x).hexdigest() if w else None for x, w in zip(texts.cast(pa.binary()).to_pylist(), wanted.tolist())]


_WINDOWS = "k1 long, k2 long, copies long, n_words long, n_removed long, kept_sha256 string, packed binary, starts array<int>, w1 array<long>, w2 array<int>"


def _window_rows(window: int, gram: int, digests: bool):
    """Each distinct text with the hashes of its windows at anchors that repeat. A text without such windows is done,
    as nothing of it goes; so is one that occurs twice, all of which goes if a window fits into it. The n_removed of the
    others is null. Texts that are done get a digest and the others their packed text where ``digests`` are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "packed", PART_BYTES // 4):
            h, at, flat = word_hashes(_unpack(part.column("packed")))
            n = np.diff(at)
            low, _, _ = anchors(h, at, window, gram)
            seeds = np.unique(part.column("anchors").flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
            place = np.flatnonzero(np.isin(low, seeds) & (low != 0))
            begins = np.searchsorted(place, at).astype(np.int32)
            w1, w2 = (run_hashes(h, window, base)[place] if len(place) else np.zeros(0, np.uint64) for base in _BASES)
            copies = part.column("copies").to_numpy()
            candidate = np.diff(begins) > 0
            gone = (copies > 1) & (n >= window)
            open_ = candidate & ~gone
            del h, low
            sha, texts = [None] * len(n), [None] * len(n)
            if digests:
                whole = flat.filter(pa.array(np.repeat(~open_ & ~gone, n)))
                kept_at = np.concatenate(([0], np.cumsum(np.where(open_ | gone, 0, n))))
                sha = _digests(_joined(whole, kept_at), ~open_)
                texts = [x if o else None for x, o in zip(part.column("packed").to_pylist(), open_.tolist())]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(begins), x)
            start = place - np.repeat(at[:-1], np.diff(begins))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("k1"),
                    part.column("k2"),
                    part.column("copies"),
                    pa.array(n),
                    pa.array(np.where(gone, n, 0), mask=open_),
                    pa.array(sha, pa.string()),
                    pa.array(texts, pa.binary()),
                    lists(pa.array(start.astype(np.int32))),
                    lists(pa.array(w1.view(np.int64))),
                    lists(pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                ],
                [c.split()[0] for c in _WINDOWS.split(", ")],
            )

    return run


def _left(texts: pa.Array, hits: pa.Array, window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What is left of each text once the words of its windows that start at ``hits`` are gone, the number of its words
    and how many of them are left."""
    flat, at = words(texts)
    start = hits.flatten().to_numpy(zero_copy_only=False) + np.repeat(at[:-1], np.diff(hits.offsets.to_numpy()))
    change = np.bincount(start, minlength=len(flat) + 1) - np.bincount(start + window, minlength=len(flat) + 1)
    stay = np.cumsum(change[:-1]) == 0
    kept_at = np.concatenate(([0], np.cumsum(stay)))[at]
    return _joined(flat.filter(pa.array(stay)), kept_at), np.diff(at), np.diff(kept_at)


def _cut_rows(window: int):
    """The digest of what is left of each packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "packed", PART_BYTES // 4):
            left, n, kept = _left(_unpack(part.column("packed")), part.column("hits").fill_null([]), window)
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(n), pa.array(n - kept), pa.array(_digests(left, np.ones(len(left), bool)))], ["k1", "k2", "n_words", "n_removed", "kept_sha256"])

    return run


def _cut_texts(window: int, names: list[str], text: str):
    """The columns ``names``, with the text cut: all of it is gone, or what its hits cover, or nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, PART_BYTES):
            new, some = pc.if_else(pc.fill_null(part.column("gone"), False), "", part.column(text)), pc.is_valid(part.column("hits"))
            if some.true_count:
                new = pc.replace_with_mask(new, some, _left(new.filter(some), part.column("hits").filter(some), window)[0])
            yield pa.RecordBatch.from_arrays([new if c == text else part.column(c) for c in names], names)

    return run


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with 128 bits of hash of its texts: k1, k2."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(whole), "k2": F.xxhash64(F.lit("second"), whole)})


def _windows(docs: DataFrame, window: int, gram: int, digests: bool) -> DataFrame:
    """_WINDOWS and a number, row, of each distinct text of ``docs`` (doc_id, text, k1, k2); repeated rows of one id and
    text give one each, without windows to look at or wholly gone."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "k1", "k2")
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    # seeds: anchors that are at two places at least, in one text or more
    seeds = written(rows.mapInArrow(_seed_rows(window, gram), "anchor long, k1 long, times int"), "anchors")
    # written, so that the join may split the rows of an anchor that a large group of copies has
    repeated = written(seeds.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    found = seeds.select("anchor", "k1").join(repeated, "anchor").groupBy("k1").agg(F.collect_set("anchor").alias("anchors"))
    # one row of each distinct text; k1 may stand for two texts by chance, which only adds anchors to look at
    chosen = copies.join(found, "k1", "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<long>")))
    texts = rows.mapInArrow(_packed, "doc_id long, k1 long, k2 long, packed binary").alias("r")
    one = texts.join(chosen.alias("c"), (F.col("r.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("r.k1") == F.col("c.k1")) & (F.col("r.k2") == F.col("c.k2")))
    return written(one.select("r.k1", "r.k2", "copies", "packed", "anchors").mapInArrow(_window_rows(window, gram, digests), _WINDOWS).withColumn("row", F.monotonically_increasing_id()), "windows")


def _hits(held: DataFrame) -> DataFrame:
    """(row, hits: where its windows start that do so at two places at least) of the texts that have such windows and are
    not done."""
    at = held.where(F.size("starts") > 0).select("row", "copies", F.col("n_removed").isNull().alias("open"), F.explode(F.arrays_zip("starts", "w1", "w2")).alias("x")).select("row", "copies", "open", "x.starts", "x.w1", "x.w2")
    total = held.agg(F.sum(F.size("starts"))).first()[0] or 0
    twice = at.groupBy("w1", "w2").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 1")
    # windows of so many rows that one task should not have them all: there are at most MOST_FREQUENT, and they are sent
    # to all executors; their rows get keys of their own in the join, so no key of it is large
    many = F.col("rows") * MOST_FREQUENT >= max(total, MOST_FREQUENT * 100)
    frequent = twice.where(many).select("w1", "w2", F.lit(True).alias("frequent"))
    rare = twice.where(~many).select("w1", "w2", F.lit(True).alias("rare"))
    known = at.where("open").join(F.broadcast(frequent), ["w1", "w2"], "left").withColumn("w1", F.when(F.col("frequent"), F.xxhash64("row", "starts")).otherwise(F.col("w1")))
    return known.join(rare, ["w1", "w2"], "left").where("frequent or rare").groupBy("row").agg(F.collect_list("starts").alias("hits"))


def judged(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, n_words, n_removed, kept_sha256) per distinct text of ``docs`` (doc_id, text, k1, k2)."""
    held = _windows(docs, window, gram, digests=True)
    free_shuffles(docs.sparkSession)
    cut = held.where("n_removed is null").select("row", "k1", "k2", "packed").join(_hits(held), "row", "left").select("k1", "k2", "packed", "hits").mapInArrow(_cut_rows(window), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string")
    done = held.where("n_removed is not null").select("k1", "k2", "n_words", "n_removed", "kept_sha256")
    # repeated rows of one id and text give one result each; they are equal
    return cut.unionByName(done).dropDuplicates(["k1", "k2"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it starts anywhere else with the same words, in the same
    or any other row. Windows are judged on the input. A null text has no words; repeated rows are copies of each
    other; rows with a null key take part like any other; an empty table gives no rows; other columns are not read.

    Equal texts are judged once, keyed by 128 bits of hash: all windows of a text that occurs twice repeat. Every copy
    gives its anchors, which are joined with the repeated ones and then meet by text before any window is made.
    """
    rows = with_keys(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    # written first, so that the join may split the rows of a large group of copies
    found = cut(judged(rows, window, gram))
    return rows.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of its texts; a text that loses nothing stays as it is, one that loses
    words has the others joined by one space.

    A null text stays null; a text that loses all words is empty; repeated rows are copies of each other and rows with a
    null key take part like any other; an empty table stays empty; the other columns pass through whatever their names.

    Only places of windows are joined; texts are not held with them but cut in the rows they came in, which meet the
    places once those are written and the shuffles behind them are free.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, content = (names[docs.columns.index(c)] for c in (key, text))
    rows = with_keys(docs.toDF(*names).withColumn(content, F.col(content).cast("string")), content)
    held = _windows(rows.select(F.col(own).cast("long").alias("doc_id"), F.col(content).alias("text"), "k1", "k2"), window, gram, digests=False)
    free_shuffles(spark)
    part = held.where("n_removed is null").select("row", "k1", "k2").join(_hits(held), "row").select("k1", "k2", "hits", F.lit(False).alias("gone"))
    whole = held.where("n_removed > 0").select("k1", "k2").distinct().select("k1", "k2", F.lit(None).cast("array<int>").alias("hits"), F.lit(True).alias("gone"))
    # written, so that the join may split the rows of a large group of copies
    found = written(part.unionByName(whole), "cuts")
    del part, whole
    free_shuffles(spark)
    met = rows.join(found, ["k1", "k2"], "left").select(*names, "hits", "gone")
    return met.mapInArrow(_cut_texts(window, names, content), rows.select(*names).schema).toDF(*docs.columns)


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(0, len(w) - 34) + 1)) AS i, w FROM t),
k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM k JOIN r USING (h)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
s AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (g.i IS NULL), '') AS kept FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (doc_id)
"""
