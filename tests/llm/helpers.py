"""Small documents with the awkward cases that every operator has to bear."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def awkward(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, odd spaces, copies and near copies."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "日本", "x", "réeux", "don't", "🙂", "A1", "thing|", "end."] + [f"w{i}" for i in range(80)]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\n", "\t", " ", "  "]) for _ in range(k))
    rows = [(i, text(r.choice([1, 2, 3, 5, 40, 90])), "en", f"s{i % 3}", 1) for i in range(n)]
    rows += [(n + i, rows[i][1], None, None, None) for i in range(8)]
    rows += [(n + 10 + i, rows[i][1] + " extra" if rows[i][1] else "q", "en", "s", 1) for i in range(8)]
    rows += [(n + 20, None, "en", "s", 1), (n + 21, "", "en", "s", 1), (n + 22, " \n\t ", "en", "s", 1), (n + 23, text(6000), "en", "s", 1), (None, text(5), "en", "s", 1)]
    rows += [rows[3], rows[3], (n + 30, "w1 " * 300, "en", "s", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, partitions=3):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(partitions)
