"""Byte-level BPE from a rank file: encoding by rounds over length-bucketed numpy matrices, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .pretoken import WordCache, gather, stretches

NONE = np.int32(2**31 - 1)
#: Words of more bytes have a matrix of their own, in which a round merges all places of the lowest rank at once, as one
#: merge a round would take their length squared.
LONG = 1024


class PairTable:
    """Open addressing: (left id, right id) -> id of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.place(keys)
        while len(keys):
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + (self.keys[at[rest]] != -1)) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        at, out = self.place(keys), np.full(len(keys), NONE, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out.reshape(left.shape)


class Bpe:
    """Encodes words by repeatedly merging the leftmost adjacent pair of the lowest rank; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes_table = stretches(tokens)
        self.decimal_table = stretches([b"%d " % i for i in range(len(tokens))])
        self.cache = WordCache(pattern, self.encode_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of each word's ids."""
        raw = [w.encode() for w in words]
        length = np.array([len(b) for b in raw], np.int64)
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int64)
        out: list[np.ndarray | None] = [None] * len(raw)
        for i in np.flatnonzero(whole >= 0).tolist():
            out[i] = whole[i : i + 1]
        todo = np.flatnonzero(whole < 0)
        # buckets: lengths that share a multiple of four up to 32, then a power of two
        width = np.where(length <= 32, -(-length // 4) * 4, 2 ** np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for w in np.unique(width[todo[length[todo] <= LONG]]).tolist():
            rows = todo[(width[todo] == w) & (length[todo] <= LONG)]
            step = max(1, (1 << 20) // w)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part.tolist(), self.merge([raw[i] for i in part.tolist()], w)):
                    out[i] = ids
        for i in todo[length[todo] > LONG].tolist():
            out[i] = self.merge_long(raw[i])
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array([len(x) for x in out], np.int64)

    def merge(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        """One merge a row and round; rows without a pair left leave the matrix, and merged columns close up."""
        n = len(raw)
        size = np.array([len(b) for b in raw])
        ids = self.byte_id[np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), np.uint8)].reshape(n, width)
        columns = np.arange(width)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        rank[columns[None, :] >= (size - 1)[:, None]] = NONE
        out: list[np.ndarray] = [np.zeros(0)] * n
        row = np.arange(n)
        while len(row):
            j = rank.argmin(1)
            best = rank[np.arange(len(row)), j]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = ids[i, : size[i]].copy()
                keep = ~done
                row, ids, rank, size, j, best = row[keep], ids[keep], rank[keep], size[keep], j[keep], best[keep]
                if not len(row):
                    break
            width = int(size.max())
            ids, rank, columns = ids[:, :width], rank[:, :width], columns[:width]
            every = np.arange(len(row))
            source = columns[None, :] + (columns[None, :] > j[:, None])
            np.minimum(source, width - 1, out=source)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[every, j] = best
            size = size - 1
            has = j + 1 < size
            right = np.where(has, self.pairs(ids[every, j], ids[every, np.minimum(j + 1, width - 1)]), NONE)
            rank[every, j] = right
            left = np.flatnonzero(j > 0)
            rank[left, j[left] - 1] = self.pairs(ids[left, j[left] - 1], ids[left, j[left]])
            rank[every, size - 1] = NONE
        return out

    def merge_long(self, raw: bytes) -> np.ndarray:
        """The same rounds for one long word, a matrix of one row: a round merges all places of the lowest rank, from the left.

        One merge a round would do the same, unless a merge makes a pair of a lower rank still; the round ends with the
        first that does.
        """
        ids = self.byte_id[np.frombuffer(raw, np.uint8)]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # of places that overlap one after the other every second one
            nth = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, nth, 0))
            at = at[(nth - first) % 2 == 0]
            right = np.minimum(at + 2, len(ids) - 1)
            left = np.maximum(at - 1, 0)
            joined = np.concatenate(([False], at[1:] == at[:-1] + 2))  # the place to the left has just been merged
            token = np.full(len(at), best, np.int32)
            lower = (self.pairs(token, ids[right]) < best) & (at + 2 < len(ids))
            lower |= (self.pairs(np.where(joined, best, ids[left]).astype(np.int32), token) < best) & (at > 0)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            for pair in (at[at > 0] - 1, at[at < len(ids) - 1]):
                rank[pair] = self.pairs(ids[pair], ids[pair + 1])
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts and the number of each text's ids; null texts have none."""
        return self.cache.ids(texts)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and the number of bytes of each id."""
        return gather(*self.bytes_table, ids)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> Bpe:
    """The encoder of a rank file and a splitting pattern, once per process; both default to the public 50k vocabulary."""
    import public_tokenizers

    return Bpe(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def per_text(values: np.ndarray, length: np.ndarray, count: np.ndarray) -> tuple[memoryview, list[int]]:
    """Bytes of successive ids as one buffer, and where each text of ``count`` ids begins in it."""
    ends = np.concatenate(([0], np.cumsum(length)))
    return memoryview(values), ends[np.concatenate(([0], np.cumsum(count)))].tolist()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids: array<int>) of every whole text. A null or empty text has no ids; every row, also a repeated one
    or one with a null key, gives a row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches):
            ids, count = bpe.encode(part.column(1))
            at = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes: binary) from (doc_id, ids); null or empty ids decode to nothing, and an id without a token is an error.
    Every row gives a row, also a repeated one or one with a null doc_id; an empty table gives no rows; other columns
    are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in batches:
            lists = part.column(1).fill_null([])
            flat, count = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            data, at = per_text(*bpe.decode(flat), count)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes(data[a:b]) for a, b in zip(at, at[1:])], pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every whole text and decodes its ids again.

    The digests are of the decimal ids joined by one space and of the decoded bytes. Nulls, empty texts and repeated
    rows are as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches):
            ids, count = bpe.encode(part.column(1))
            digits, at = per_text(*gather(*bpe.decimal_table, ids), count)
            data, to = per_text(*bpe.decode(ids), count)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(count),
                    pa.array([hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(to, to[1:])]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
