"""Packing by power-of-two decomposition: each document is split into pieces of binary lengths, so that every sequence
holds tokens of one document only, needs no padding, and can be batched with sequences of its own length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .pretoken import WordCache


#: The public splitting pattern with its alternatives in another order: words come first, as most matches are words. Only
#: `'s` and its like share a first character with an alternative that they have to come before, as they do, and so do
#: the last two; all others begin differently, so the matches are the same.
SPLIT = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> WordCache:
    """ids by the tokenizers library, which gets each distinct word once; special strings in a text are ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True

    return WordCache(pattern or SPLIT, WordEncoder(t))


class WordEncoder:
    """ids of distinct words. Words of a space and letters are encoded as one running text, which the tokenizer splits
    at those spaces again: only their first id stands for a string with a space. All others are encoded one by one."""

    def __init__(self, tokenizer):
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w[0] == " " and w[1:].isalpha() for w in words]
        running = [w for w, p in zip(words, plain) if p]
        texts = ["".join(running[a : a + 2000]) for a in range(0, len(running), 2000)]
        ids = [np.array(x.ids, np.int32) for x in self.encode(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != len(running):  # a tokenizer that splits letters in another way
            plain, running, flat, starts = [False] * len(words), [], flat[:0], starts[:0]
        others = [np.array(x.ids, np.int32) for x in self.encode([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
        length = np.zeros(len(words), np.int64)
        at = np.array(plain, bool)
        length[at] = np.diff(np.append(starts, len(flat)))
        length[~at] = [len(x) for x in others]
        out = np.zeros(int(length.sum()), np.int32)
        mine = np.repeat(at, length)
        out[mine], out[~mine] = flat, np.concatenate([np.zeros(0, np.int32), *others])
        return out, length


def pieces(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents with so many tokens each: as many of ``longest`` as fit,
    then the powers of two of what is left, from large to small."""
    whole = tokens // longest
    bits = np.arange(int(longest).bit_length() - 2, -1, -1)
    binary = (tokens[:, None] >> bits) & 1 == 1
    count = whole + binary.sum(1)
    doc = np.repeat(np.arange(len(tokens)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(doc), longest, np.int64)
    length[nth >= whole[doc]] = np.broadcast_to(1 << bits, binary.shape)[binary]
    ends = np.cumsum(length)
    begin = np.concatenate(([0], np.cumsum(tokens)))[:-1]
    return doc, ends - length - begin[doc], length


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 2048, end: int = 1, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, bucket.

    Every piece is a sequence of its own of 2**bucket ids, with offset 0. A null or empty text is its end token alone.
    Every row is packed, also repeated ones and those with a null key; other columns are not read.
    """
    assert longest & (longest - 1) == 0, "the longest sequence has a power of two of tokens"

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = load(path, pattern)
        for part in slices(batches):
            ids, count = cache.ids(part.column(1))
            tokens = count + 1
            ids = np.insert(ids, np.cumsum(count), end).astype("<u4")
            doc, start, length = pieces(tokens, longest)
            at = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])
            bucket = np.log2(length).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(tokens[doc]), pa.array(bucket)], ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return rows.select("doc_id", "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket")


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
