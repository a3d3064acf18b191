import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from helpers import awkward, documents

from tessera.llm import bpe, packing


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def strange(n=400, seed=5):
    r = random.Random(seed)
    letters = "aabbcdeé ü  日本語한🙂🧑‍🚀\n\t'sreve0123\\<|endoftext|>́\x00\x7f"
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 300]))) for _ in range(n)]
    return texts + ["a" * 5000, "ab" * 900, "é" * 1500, "<|endoftext|>", " " * 3000, "the" * 700]


def test_words_equal_the_library(reference):
    import pyarrow as pa

    texts = strange()
    ids, count = bpe.load().encode(pa.array(texts))
    want = [reference.encode_ordinary(t) for t in texts]
    assert count.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    data, _ = bpe.load().decode(ids)
    assert data.tobytes() == "".join(texts).encode()


def test_long_words_by_both_ways(reference):
    encoder = bpe.load()
    for text in ["a" * 900, "abcab" * 150, "ungheitkeit" * 80, "éèê" * 100]:
        raw = text.encode()
        want = reference._core_bpe.encode_ordinary(text)
        assert encoder.merge([raw], 1024)[0].tolist() == want
        assert encoder.merge_long(raw).tolist() == want


def test_long_words_of_any_ranks():
    """Ranks in an order in which a merge often makes a pair of a lower rank."""
    for seed in range(40):
        r = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)} | {"".join(r.choice("abc") for _ in range(r.randint(2, 5))).encode() for _ in range(60)}
        longer = sorted(t for t in tokens if len(t) > 1)
        r.shuffle(longer)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(longer)}
        encoder = bpe.Bpe(ranks, r"\w+")
        library = tiktoken.Encoding("any", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(5):
            text = "".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 40, 90])))
            one = encoder.merge([text.encode()], 128)[0].tolist()
            assert encoder.merge_long(text.encode()).tolist() == one
            if len(text) < 100 and text.encode() not in ranks:
                assert one == library.encode_ordinary(text)


def test_very_long_words(reference):
    r = random.Random(9)
    for text in ("a" * 200_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "the" * 30_000):
        assert bpe.load().merge_long(text.encode()).tolist() == reference.encode_ordinary(text)


def test_round_trip(spark, reference):
    rows = awkward() + [(1000 + i, t, "", "", 0) for i, t in enumerate(strange(60))]
    got = sorted(map(tuple, bpe.round_trip(documents(spark, rows)).collect()), key=str)
    want = []
    for d, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode(spark):
    rows = awkward()
    got = sorted((str(r.doc_id), r.bytes.decode()) for r in bpe.decode(bpe.encode(documents(spark, rows))).collect())
    assert got == sorted((str(r[0]), r[1] or "") for r in rows)


def test_cache_stays_bounded(reference):
    import pyarrow as pa

    encoder = bpe.Bpe(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    encoder.cache.limit = 50
    for texts in (strange(40, 1), strange(40, 2), strange(40, 1)):
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]


def test_packing(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, r[1], None, None, None) for i, r in enumerate(awkward())] + [(1000 + i, x, "", "", 0) for i, x in enumerate(strange(60))]
    out = packing.pack(documents(spark, rows)).collect()
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.piece_digests(packing.pack(documents(spark, rows))).collect()}
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(rows)
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted(by[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        at = 0
        for r in mine:
            assert (r.start, r.doc_tokens, len(r.ids)) == (at, len(ids), 4 * r.length)
            assert r.length == 1 << r.bucket <= 2048
            assert digests[d, at] == zlib.crc32(bytes(r.ids))
            at += r.length
        assert len(mine) == len(ids) // 2048 + (len(ids) % 2048).bit_count()


def test_empty_tables(spark):
    assert bpe.round_trip(documents(spark, [])).count() == 0
    assert packing.pack(documents(spark, [])).count() == 0
