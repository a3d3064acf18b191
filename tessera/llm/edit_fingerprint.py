"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text: at step j it looks at the character where it stands and moves on by one or stays,
as a random bit of j and the character says. Two texts that differ by few edits soon walk in step again, so the
sequences of what the walks look at differ in few places. A fingerprint has DIGITS hexadecimal digits, each a hash of
what the walk looks at in one step; the steps are sampled alike for all texts, so digits of a fingerprint differ as
steps of the walks do. Bands of digits give candidates, which are verified by the share of equal digits and united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, local_forest, mix, pieces_of_bands, slices, small_batches, written

DIGITS = 128
#: Steps of a walk for each character. A walk moves on at every other step, so about half of all walks end before the last
#: character, by about the square root of the length; steps beyond the end would make unrelated texts look alike.
STEPS = 2
#: Digits of a band, and bands: fingerprints of likeness .9 share one with a chance of .99.
BAND, BANDS = 8, 8
#: Fingerprints that are compared with each other in one piece.
BAND_ROWS = 4000
#: Steps whose hashes are looked at together.
RUN = 1 << 16
#: Characters fall into 63 classes; class 63 is the end of a text, where a walk stays.
END = 63
#: Rows between two bounds of the order by id, as long as MAX_RANGES bounds suffice.
RANGE, MAX_RANGES = 2048, 5000
TEXT_BYTES = 8 << 20


@lru_cache(maxsize=4)
def _records(bits: int) -> list[np.ndarray]:
    """For each digit, the steps below 2**bits whose hash is smaller than those of all steps before."""
    out: list[list[np.ndarray]] = [[] for _ in range(DIGITS)]
    least = [np.uint64(0xFFFFFFFFFFFFFFFF)] * DIGITS
    for first in range(0, 1 << bits, RUN):
        steps = np.arange(first, first + min(RUN, 1 << bits), dtype=np.uint64)
        for d in range(DIGITS):
            h = mix(steps + np.uint64((d + 1) << 40))
            low = np.minimum.accumulate(np.concatenate((least[d : d + 1], h)))
            out[d].append(first + np.flatnonzero(low[1:] < low[:-1]))
            least[d] = low[-1]
    return [np.concatenate(x) for x in out]


def sampled_steps(steps: np.ndarray) -> np.ndarray:
    """texts x DIGITS: of the steps a text's walk takes, each digit has the one of the smallest hash, so texts of about
    one length mostly sample the same steps."""
    records = _records(max(16, int(steps.max(initial=1)).bit_length()))
    return np.stack([r[np.searchsorted(r, steps) - 1] for r in records], axis=1)


def _bits(first: int, n: int) -> np.ndarray:
    """n x 64 random bits: whether a walk moves on, at steps from ``first`` on, for each class of characters."""
    h = mix(np.arange(first, first + n, dtype=np.uint64) + np.uint64(1 << 52))
    out = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    out[:, END] = 0
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """texts x DIGITS of values from 0 to 15. An empty text has a walk of one step, at its end."""
    if not texts:
        return np.zeros((0, DIGITS), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    points = np.frombuffer("\0\0\0".join([texts[i] for i in order.tolist()] + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
    length = n[order]
    begin = np.cumsum(length + 3) - length - 3
    # three ends behind each text, as a digit is a hash of three characters
    classes = np.empty(len(points), np.uint8)
    for a in range(0, len(points), RUN):
        classes[a : a + RUN] = mix(points[a : a + RUN].astype(np.uint64)) % np.uint64(END)
    for k in range(3):
        classes[begin + length + k] = END
    del points
    steps = np.maximum(STEPS * length, 1)
    sampled = sampled_steps(steps)
    event = np.argsort(sampled, axis=None, kind="stable")
    event_step, event_doc = sampled.ravel()[event], event // DIGITS
    place = np.empty(len(event), np.int64)
    at = begin.astype(np.int32 if len(classes) < 1 << 31 else np.int64)
    done = 0
    block = 256
    path = np.empty((block, len(at)), at.dtype)
    for first in range(0, int(steps[0]), block):
        active = int(np.searchsorted(-steps, -first))  # walks of more than ``first`` steps
        move = _bits(first, block)
        now, rows = at[:active], path[:, :active]
        for j in range(block):
            rows[j] = now
            now += move[j].take(classes.take(now))
        end = int(np.searchsorted(event_step, first + block))
        place[done:end] = path[event_step[done:end] - first, event_doc[done:end]]
        done = end
    slot = (event % DIGITS).astype(np.uint64)
    seen = classes[place].astype(np.uint64) | classes[place + 1].astype(np.uint64) << np.uint64(6) | classes[place + 2].astype(np.uint64) << np.uint64(12) | slot << np.uint64(18)
    out = np.empty(len(texts) * DIGITS, np.uint8)
    out[order[event_doc] * DIGITS + event % DIGITS] = (mix(seen + np.uint64(1)) >> np.uint64(60)).astype(np.uint8)
    return out.reshape(len(texts), DIGITS)


def hexadecimal(digits: np.ndarray) -> list[str]:
    raw = (digits[:, ::2] << 4 | digits[:, 1::2]).tobytes().hex()
    return [raw[i : i + DIGITS] for i in range(0, len(raw), DIGITS)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal digits, less what chance gives: 1 for equal fingerprints, about 0 for unrelated ones."""
    return np.maximum(0.0, ((a == b).mean(1) - 1 / 16) / (15 / 16))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; equal texts have equal fingerprints, and a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hexadecimal(fingerprints([t or "" for t in part.column(1).to_pylist()])))], ["doc_id", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _digits(column) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(len(column), -1)
    return np.stack((raw >> 4, raw & 15), axis=2).reshape(len(column), -1)


def _band_links(threshold: float, t: pa.Table) -> pa.Table:
    """A forest over the fingerprints of one piece, by band, that connects all pairs of a band that are alike enough."""
    t = t.sort_by("band")
    digits, node, half, band = _digits(t.column("fingerprint")), t.column("key").to_numpy(), t.column("half").to_numpy(), t.column("band").to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begins = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True])))
    for begin, end in zip(begins, begins[1:]):
        for i in range(begin, end, 256):
            for k in range(i, end, 1024):
                left, right = np.arange(i, min(i + 256, end)), np.arange(k, min(k + 1024, end))
                equal = np.zeros((len(left), len(right)), np.int16)
                for d in range(digits.shape[1]):
                    equal += digits[left, d, None] == digits[None, right, d]
                x, y = np.nonzero((equal / digits.shape[1] - 1 / 16) / (15 / 16) >= threshold)
                x, y = left[x], right[y]
                across = (x < y) & ((half[x] == 2) | (half[x] != half[y]))
                p, q = local_forest(node[x[across]], node[y[across]])
                a.append(p)
                b.append(q)
    p, q = local_forest(np.concatenate(a), np.concatenate(b))
    return pa.table({"src": pa.array(p, pa.int64()), "dst": pa.array(q, pa.int64())})


def near_classes(prints: DataFrame, threshold: float = 0.9, band: int = BAND, bands: int = BANDS, limit: int = BAND_ROWS) -> DataFrame:
    """(fingerprint, class_id: the smallest doc_id reachable by links) per distinct fingerprint of (doc_id, fingerprint).

    Fingerprints that share a band of sampled digits are candidates; candidates are verified by their likeness, all
    pairs of a band value against each other, those of more than ``limit`` rows in pairs of blocks. Equal fingerprints
    are one row from the start. Rows with a null id take no part; an empty table gives no rows.
    """
    own = written(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("key")), "fingerprints")
    banded = own.select("key", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("fingerprint", k * band + 1, band)) for k in range(bands)])).alias("band"))

    def link(t: pa.Table) -> pa.Table:
        return _band_links(threshold, t)

    edges = pieces_of_bands(banded, limit).join(own, "key").groupBy("piece").applyInArrow(link, "src long, dst long")
    found = connected_components(edges).withColumnRenamed("node", "key")
    return own.join(found, "key", "left").select("fingerprint", F.coalesce("component", "key").alias("class_id"))


_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (range, ahead, id, text): each row with the one behind it. Every range ends with rows that
    are ahead, which show the next range's first text and give no output."""
    held: list[tuple] = []
    for part in slices(batches, "text", TEXT_BYTES):
        rows = held + list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("ahead").to_pylist()))
        held = rows[-1:]
        texts = [r[1] for r in rows]
        mine = [i for i in range(len(rows) - 1) if not rows[i][2]]
        if not mine:
            continue
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in mine]
        plain, changed = fingerprints(texts), fingerprints(edited)
        here, behind = plain[mine], plain[[i + 1 for i in mine]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in mine], pa.int64()),
                pa.array([len(texts[i]) for i in mine], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(hexadecimal(here)),
                pa.array(hexadecimal(changed)),
                pa.array(likeness(here, changed)),
                pa.array(likeness(here, behind)),
            ],
            [c.split()[0] for c in _COMPARED.split(", ")],
        )


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of a text replaced by as much of the beginning of the next document's text, in
    the order of doc_id, then text; null keys come first, and the last row's next one is the first. A null text is
    empty; repeated rows give a row each; an empty table gives no rows; other columns are not read.

    Rows are dealt by ranges of the id, and the first id of each range is also shown to the range before it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("rank"))
    total = rows.count()
    ranges = int(min(max(1, -(-total // RANGE)), MAX_RANGES))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("rank", shares, 20 * MAX_RANGES)).first()[0] if shares and total else [], np.int64))

    def numbered(at: np.ndarray, name: str):
        @F.pandas_udf("long")
        def find(rank):
            import pandas as pd

            return pd.Series(np.searchsorted(at, rank.to_numpy(), "right"))

        return find(name)

    # the first id that each range really has; the bounds are approximate
    firsts = np.array(sorted(r["rank"] for r in rows.select("rank").withColumn("n", numbered(bounds, "rank")).groupBy("n").agg(F.min("rank").alias("rank")).collect()), np.int64)
    count = max(len(firsts), 1)
    starts = F.array(*[F.lit(int(x)) for x in firsts]) if len(firsts) else F.array().cast("array<long>")
    placed = rows.withColumn("n", (numbered(firsts[1:], "rank")).cast("int"))
    is_first = F.get(starts, F.col("n")) == F.col("rank")
    before = F.pmod(F.col("n") - 1, F.lit(count)).cast("int")
    own = F.struct(F.col("n").alias("range"), F.lit(False).alias("ahead"))
    targets = F.when(is_first, F.array(own, F.struct(before.alias("range"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "rank", F.explode(targets).alias("to")).select("doc_id", "text", "rank", "to.range", "to.ahead")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "rank", "text").select("doc_id", "text", "ahead").mapInArrow(_compare, _COMPARED)


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """The rows of compared() with class_id: the smallest id that links between fingerprints of a likeness of ``threshold``
    at least reach, as near_classes() finds them; null for rows with a null key."""
    rows = written(compared(docs, key, text), "edit-fingerprints")
    found = cut(near_classes(rows.select("doc_id", "fingerprint"), threshold))
    return rows.join(found, "fingerprint", "left").select(*rows.columns, F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
