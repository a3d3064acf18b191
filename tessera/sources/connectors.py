"""Where rows come from and go to: namespaces, paged services, object stores, queues, catalogs, samples, ontologies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tables that all pipelines share; all others are a pipeline's own.
SYSTEM_TABLES = frozenset({"runs", "pipeline_input_filters", "quality_metrics", "transformation_logs", "prompts"})


def resolve(name: str, system: str, own: str) -> str:
    """The path of a table in the system's or the pipeline's folder."""
    return f"{(system if name in SYSTEM_TABLES else own).rstrip('/')}/{name}"


def read_collection(spark: SparkSession, name: str, system: str, own: str, fields: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(resolve(name, system, own))
    return df.select(*fields) if fields else df


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    """Reads each page of a listing in a task of its own."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.fetch, self.size, self.total = _SERVICES[options["service"]], int(options.get("page_size", 50)), int(options["total"])
        self.names = schema.names

    def partitions(self) -> list[_Page]:
        return [_Page(k) for k in range(-(-self.total // self.size))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for row in self.fetch(partition.number * self.size, min(self.size, self.total - partition.number * self.size)):
            yield tuple(row.get(n) for n in self.names)


class PagedSource(DataSource):
    """A paged listing as a table: spark.read.format("paged").schema(...).options(service=..., total=..., page_size=...)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def _numbered(offset: int, count: int) -> list[dict[str, Any]]:
    """A deterministic service for tests and examples."""
    return [{"id": f"v{i}", "title": f"Video {i}", "views": i * 7 % 1000} for i in range(offset, offset + count)]


_SERVICES: dict[str, Callable[[int, int], list[dict[str, Any]]]] = {"numbered": _numbered}


def fetch_details(ids: DataFrame, fetch: Callable[[list[str]], dict[str, dict[str, Any]]], schema: str, key: str = "id", batch: int = 50) -> DataFrame:
    """Details of ids, ``batch`` a call; ids that a call leaves out are asked for once more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            wanted = part[key].tolist()
            for a in range(0, len(wanted), batch):
                some = wanted[a : a + batch]
                got = fetch(some)
                if missing := [i for i in some if i not in got]:
                    got = {**got, **fetch(missing)}
                if got:
                    yield pd.DataFrame([{key: i, **got[i]} for i in some if i in got])

    return ids.select(key).mapInPandas(run, schema)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the objects under a path."""
    return spark.read.format("binaryFile").load(path)


def files(spark: SparkSession, path: str):
    """The Hadoop file system of a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def put_object(spark: SparkSession, path: str, content: bytes) -> None:
    out = files(spark, path).create(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def delete_object(spark: SparkSession, path: str) -> bool:
    return files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def clustered(rows: DataFrame, path: str, by: list[str]) -> DataFrame:
    """The rows, written in order of ``by`` and read again: what an index on these columns is to Spark. Files hold ranges of
    the first column and their statistics say which, so a filter on it skips files and row groups."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def message_stream(spark: SparkSession, folder: str | None = None, servers: str | None = None, topic: str | None = None, at_once: int = 100) -> DataFrame:
    """(value) messages: files of a folder in tests, a Kafka topic in production, ``at_once`` files or so many thousand
    messages a batch."""
    if folder is not None:
        return spark.readStream.option("maxFilesPerTrigger", at_once).text(folder)
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", at_once * 1000).load().select(F.col("value").cast("string").alias("value"))


def generated_messages(spark: SparkSession, a_second: int = 10) -> DataFrame:
    """A stream of numbered envelopes at a fixed rate."""
    return envelopes(spark.readStream.format("rate").option("rowsPerSecond", a_second).load())


def generated_batch(spark: SparkSession, count: int, a_second: int = 10, start: int = 0) -> DataFrame:
    """The first ``count`` messages of that stream as a table, from ``start`` in seconds since 1970 on."""
    return envelopes(spark.range(count).select(F.col("id").alias("value"), F.timestamp_micros(F.lit(start * 1_000_000) + F.floor(F.col("id") * 1_000_000 / a_second)).alias("timestamp")))


def envelopes(ticks: DataFrame) -> DataFrame:
    """(value, ts): an envelope for every (value, timestamp)."""
    return ticks.select(F.to_json(F.struct(F.col("value").cast("string").alias("id"), F.lit("profile.task").alias("type"), F.lit('{"profile_id": "p", "task_type": "sync"}').alias("payload"))).alias("value"), F.col("timestamp").alias("ts"))


def sample(rows: DataFrame, size: int, key: str, seed: int = 42) -> DataFrame:
    """``size`` rows in the order of a seeded hash of their key, so the same rows at every run and partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(size)


def catalog_listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of tables; one count each, the number of tables being the catalog's."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionAll(one)
    return out


def load_ontology(text: str | None) -> dict[str, Any]:
    """canonical predicates, predicate_map, symmetric predicates and type constraints of a JSON text, or a YAML one where
    a YAML reader is installed; empty where there is none or it cannot be read."""
    empty = {"canonical": set(), "predicate_map": {}, "symmetric": set(), "constraints": {}}
    try:
        raw = json.loads(text) if text else {}
    except ValueError:
        try:
            import yaml
        except ImportError:
            return empty
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError:
            return empty
    if not isinstance(raw, dict):
        return empty
    return {"canonical": set(raw.get("canonical", [])), "predicate_map": dict(raw.get("predicate_map", {})), "symmetric": set(raw.get("symmetric", [])), "constraints": {k: [tuple(p) for p in v] for k, v in raw.get("constraints", {}).items()}}


def ontology_tables(spark: SparkSession, ontology: dict[str, Any]) -> dict[str, DataFrame]:
    """The ontology as small tables for joins."""
    pairs = [(p, a, b) for p, v in sorted(ontology["constraints"].items()) for a, b in v]
    return {
        "predicate_map": spark.createDataFrame(sorted(ontology["predicate_map"].items()), "predicate string, canonical string"),
        "canonical": spark.createDataFrame([(p,) for p in sorted(ontology["canonical"])], "predicate string"),
        "constraints": spark.createDataFrame(pairs, "predicate string, subject_type string, object_type string"),
    }
