"""Streams run to their end over files, against the batch form of the same operator."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import providers as P
from tessera.streaming import queues as K


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def drained(stream, folder, mode, name):
    rows = []

    def keep(batch, number):
        rows.extend((number, *r) for r in batch.collect())

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return rows


def test_status_stream_ends_like_the_batch(rocks, tmp_path):
    spark = rocks
    schema = "document_id string, status string, ts int, event_id int"
    parts = [[("d", "processing", 1, 1), ("e", "processing", 1, 2)], [("d", "completed", 2, 3), ("e", "odd", 2, 4)], [("d", "failed", 3, 5), ("f", "failed", 1, 6), ("f", "completed", 2, 7)]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.json(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    last = {}
    for number, d, status in drained(K.status_stream(stream), tmp_path, "update", "s"):
        last[d] = status
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert last == {r.document_id: r.status for r in K.final_status(whole).collect()}


def test_deduplicated_stream(spark, tmp_path):
    rows = [("q", "1", 0, "2024-01-01 00:00:00"), ("q", "1", 0, "2024-01-01 05:00:00"), ("q", "1", 1, "2024-01-01 06:00:00"), ("r", "1", 0, "2024-01-01 00:00:00")]
    schema = "queue string, id string, attempt int, ts timestamp"
    df = spark.createDataFrame(rows, "queue string, id string, attempt int, t string").select("queue", "id", "attempt", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = K.deduplicated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    got = {r[1:4] for r in drained(stream, tmp_path, "append", "d")}
    assert got == {("q", "1", 0), ("q", "1", 1), ("r", "1", 0)} == {tuple(r)[:3] for r in K.deduplicated(df).collect()}


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    df = spark.createDataFrame([("accept", 1), ("dead_letter", 2), ("accept", 3)], "outcome string, id int")
    write = K.sink_by_outcome(str(tmp_path), ("accept", "dead_letter"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "accept")).count() == 2


def test_delayed_retry_holds_and_gives_back():
    """The processor on its own, with a clock and timers made by hand."""

    class Lists:
        def __init__(self):
            self.rows = []

        def appendValue(self, v):
            self.rows.append(v)

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, *a):
            return Lists()

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    class Expiry:
        def __init__(self, t):
            self.t = t

        def getExpiryTimeInMs(self):
            return self.t

    p, h = K.DelayedRetry(), Handle()
    p.init(h)
    assert list(p.handleInputRows(("q",), iter([pd.DataFrame({"id": ["a", "b", "c"], "attempt": [0, 2, 0]})]), Now())) == []
    assert h.timers == [6000, 121000, 6000]
    first = pd.concat(list(p.handleExpiredTimer(("q",), Now(), Expiry(6000))))
    assert first.values.tolist() == [["q", "a", 1], ["q", "c", 1]]
    assert list(p.handleExpiredTimer(("q",), Now(), Expiry(6000))) == []
    assert pd.concat(list(p.handleExpiredTimer(("q",), Now(), Expiry(121000)))).values.tolist() == [["q", "b", 3]]


def test_rate_limiter_and_cache():
    now = [0.0]
    limiter = P.RateLimiter(10, 60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert limiter.acquire(6) == 0 and limiter.acquire(4) == 0
    assert limiter.acquire(1) == pytest.approx(60) and limiter.acquire(100) > 0
    cache = P.TtlCache(2, 5, lambda: now[0])
    assert [cache.get(k, lambda k=k: k) for k in "aba"] == ["a", "b", "a"] and cache.hits == 1
    cache.get("c", lambda: "c")
    assert "b" not in cache.values
    now[0] += 6
    assert cache.get("a", lambda: "new") == "new"


def test_retry_and_prompts():
    calls = []

    @P.retry(3, first_wait=0)
    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert shaky() == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        P.retry(2, first_wait=0)(lambda: (_ for _ in ()).throw(ValueError()))()
    p = P.Prompts()
    p.register("q", "1 {x}")
    p.register("q", "2 {x}")
    assert p.render("q", x="y") == "2 y" and p.render("q", version=1, x="y") == "1 y"


def test_completions(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, None)], "id int, text string")
    got = {r.id: r.answer for r in P.complete(df, F.col("text")).collect()}
    assert got == {1: "One. Two", 2: ""}
    parsed = P.structured(df, F.col("text"), "a int", lambda prompts: ['{"a": 3}' if p else "no" for p in prompts]).collect()
    assert {r.id: r.parsed and r.parsed.a for r in parsed} == {1: 3, 2: None}
