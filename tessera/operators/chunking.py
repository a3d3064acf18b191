"""Text splitters: rows of pieces from rows of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# What a recursive splitter cuts at, from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")


def token_windows(docs: DataFrame, size: int = 200, overlap: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, tokens, text): windows of ``size`` words, each sharing ``overlap`` with the one before. The last
    window ends the text; a text of no words gives none."""
    assert 0 <= overlap < size
    words = F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), 1)
    step = size - overlap
    w = docs.select(key, words.alias("w"), F.size(words).alias("n")).where("n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    p = w.select(key, "w", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    part = F.slice("w", F.col("piece") * step + 1, F.lit(size))
    return p.select(key, "piece", (F.col("piece") * step).alias("start"), F.size(part).alias("tokens"), F.array_join(part, " ").alias("text"))


def with_whole_texts(docs: DataFrame, pieces: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, text): the pieces, and as piece 0 the whole text of each document that a splitter gave nothing for."""
    left = docs.join(pieces.select(key).distinct(), key, "left_anti")
    return pieces.select(key, "piece", text).unionByName(left.select(key, F.lit(0).alias("piece"), text))


def packed_units(units: Column, limit: int) -> Column:
    """Units (an array of texts) packed greedily into texts of at most ``limit`` letters, joined by a line break; a longer
    unit stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, u: Column) -> Column:
        fits = (s["now"] == "") | (F.length(s["now"]) + 1 + F.length(u) <= limit)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(s["now"] == "", u).when(fits, F.concat(s["now"], F.lit("\n"), u)).otherwise(u).alias("now"))

    return F.aggregate(units, start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def paragraphs(text: Column) -> Column:
    # a lambda of one argument: transform would give trim the piece's index as the letters to cut
    return F.filter(F.transform(F.split(text, rf"\n{T.BLANK}*\n|\n"), lambda x: T.trimmed(x)), lambda x: x != "")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` letters, cut at the coarsest separator that occurs; successive pieces share up to
    ``overlap`` letters of whole parts."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(mark) + 1 :] or ("",)
    parts = list(text) if mark == "" else [p + mark for p in text.split(mark)[:-1]] + [text.split(mark)[-1]]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if len(part) > size:
            if held:
                out.append("".join(held))
                held, length = [], 0
            out += recursive_pieces(part, size, overlap, finer)
            continue
        if length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        out.append("".join(held))
    return [x for x in out if x.strip()]


#: Letters of pieces that a splitter holds before it hands them on; one document's pieces stay together.
HELD = 4_000_000


def _split(docs: DataFrame, pieces: Callable[[str], list[str]], key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, number, found, letters = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(found, pa.string())], ["key", "piece", "text"])

            for i in range(b.num_rows):
                some = pieces(b.column(1)[i].as_py() or "")
                at += [i] * len(some)
                number += range(len(some))
                found += some
                letters += sum(map(len, some))
                if letters > HELD:
                    yield out()
                    at, number, found, letters = [], [], [], 0
            if found:
                yield out()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, text string").withColumnRenamed("key", key)


def recursive_split(docs: DataFrame, size: int = 1000, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, text) by recursive_pieces(), over whole texts in Arrow batches."""
    return _split(docs, lambda t: recursive_pieces(t, size, overlap), key, text)


def segment_join(segments: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, text): a transcript's segments in order, joined by spaces."""
    return segments.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.trim(x[text])), " ").alias("text"))


def semantic_pieces(text: str, share: float = 0.95, dim: int = 64) -> list[str]:
    """Runs of sentences, cut where a sentence is least like the one before: at distances of the ``share`` percentile and
    more. Likeness is the cosine of hashed word counts; a text whose sentences cannot be compared stays whole."""
    import re
    import zlib

    import numpy as np

    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(parts) < 3:
        return [text] if text.strip() else []
    x = np.zeros((len(parts), dim))
    for i, s in enumerate(parts):
        for w in re.findall(r"\w+", s.lower()):
            x[i, zlib.crc32(w.encode()) % dim] += 1
    norm = np.linalg.norm(x, axis=1)
    x /= np.where(norm == 0, 1, norm)[:, None]
    far = 1 - (x[1:] * x[:-1]).sum(1)
    cuts = np.flatnonzero(far >= np.quantile(far, share)) + 1
    return [" ".join(parts[a:b]) for a, b in zip([0, *cuts], [*cuts, len(parts)])]


def semantic_split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, text) by semantic_pieces(), over whole texts in Arrow batches."""
    return _split(docs, semantic_pieces, key, text)


class TokenPieces:
    """A table function over one text: token_pieces(text, size, overlap) gives (piece, tokens, text) as token_windows() does."""

    def eval(self, text: str, size: int, overlap: int):
        import re

        words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
        last = max(0, -(-(len(words) - size) // (size - overlap)))
        for i in range(last + 1 if words else 0):
            part = words[i * (size - overlap) : i * (size - overlap) + size]
            yield i, len(part), " ".join(part)


def register_splitters(spark: SparkSession) -> None:
    """Makes token_pieces a table function of SQL."""
    spark.udtf.register("token_pieces", F.udtf(TokenPieces, returnType="piece int, tokens int, text string"))
