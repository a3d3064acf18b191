"""From raw documents to packed training sequences: STAGES in order, each written as Parquet and read by the next one.

All stages but the last return the columns of ``docs``, extra ones with any names included, as they came; only
``substring_dedup`` changes the text, and n_chars where there is such a column. A null or empty text is scored as empty,
is equal to other empty texts and packs to its end token. Rows with a null doc_id pass through the near-copy stage and are
otherwise treated like any other. Texts are read whole, whatever their length. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality, simhash, substring, toxicity
from tessera.llm.common import table, written


def _predicted(docs: DataFrame, score: Callable[..., DataFrame], model, wanted: int) -> DataFrame:
    """The rows of ``docs`` that a model predicts as ``wanted``; the scores bear names that no column of ``docs`` has."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), model, names[docs.columns.index("text")])
    return scored.where(F.col("predicted") == wanted).select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text the toxicity models, fitted on labelled rows of ``docs``, do not reject.

    Repeated rows and equal texts get one verdict. Without labelled rows, or with labels of one class only, the share of
    toxic labels decides for all.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.held_out())
    return _predicted(docs, toxicity.score, model, 0)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on labelled rows of ``docs``, holds for good.

    Repeated rows and equal texts get one verdict. Without labelled rows all documents stay.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"), quality.held_out())
    return _predicted(docs, quality.score, model, 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Of rows equal in id and text one stays; rows that share an id but not the text are documents of their own. Ties on the
    smallest id go to the smallest hash of id and text. Empty texts are copies of each other.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur anywhere else; n_chars, where there is one, follows the text.

    A text that loses nothing stays as it is, null included. Repeated rows are copies of each other and lose all that a
    window covers. A document with no words left stays as a row.
    """
    clean = substring.cleaned(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids: a row for each piece of every row, also of repeated ones and of those
    with a null id; extra columns are not read."""
    pieces = packing.pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: Neural scores and fingerprints of hashes are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
