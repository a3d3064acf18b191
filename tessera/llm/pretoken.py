"""Encoding by distinct words: texts are split by a pattern, and each distinct match is encoded once and remembered."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[offsets[i]:offsets[i + 1]]`` for i in ``at``, one after the other, and their lengths."""
    length = (offsets[1:] - offsets[:-1])[at]
    ends = np.cumsum(length)
    index = np.repeat(offsets[:-1][at] - (ends - length), length)
    index += np.arange(len(index))
    return flat[index], length


def stretches(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A table for gather() from byte strings."""
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


class _Index(dict):
    """Numbers its keys in the order of their first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordCache:
    """ids of texts. ``encode`` gives the ids of distinct words; about ``limit`` words are remembered at a time."""

    def __init__(self, pattern: str, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        import regex

        self.find, self.encode, self.limit = regex.compile(pattern).findall, encode, limit
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        if len(self.index) > self.limit:
            self.clear()
        known, look_up = len(self.index), self.index.__getitem__
        found: list[int] = []
        count = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            if text:
                before = len(found)
                found.extend(map(look_up, self.find(text)))
                count[i] = len(found) - before
        new = list(islice(self.index, known, None))
        if new:
            flat, length = self.encode(new)
            self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
            self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(length, dtype=np.int64)))
        ids, length = gather(self.flat, self.offsets, np.array(found, np.int64))
        ends = np.concatenate(([0], np.cumsum(length)))
        word_at = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[word_at])
