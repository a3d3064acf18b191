"""Message streams: decoding, routing, deduplication, retries and results, for batch and streaming DataFrames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENVELOPE = "id string, type string, timestamp timestamp, payload string, metadata map<string,string>"
# Waits between deliveries, what each type of task needs, where it goes, and how long its messages live.
TIERS = ("5s", "30s", "2m")
TIER_SECONDS = {"5s": 5, "30s": 30, "2m": 120}
REQUIRED = {"document.process": ("document_id",), "email.send": ("to", "subject"), "image.process": ("image_url",), "profile.task": ("profile_id", "task_type")}
QUEUES = {"document.process": "document-processing", "email.send": "email-processing", "image.process": "image-processing", "profile.task": "profile-tasks"}
DEAD_LETTER_HOURS = {"profile-tasks": 24, "email-processing": 24, "image-processing": 72, "document-processing": 168}
EMAIL_EXPIRES_SECONDS = 3600


def _map(pairs: dict[str, Any]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def decode(messages: DataFrame, body: str = "value") -> DataFrame:
    """Messages with "envelope", null where the body is no JSON object of that shape; extra fields are tolerated."""
    return messages.withColumn("envelope", F.from_json(F.col(body).cast("string"), ENVELOPE, {"mode": "PERMISSIVE"}))


def missing_field(kind: Column, payload: Column) -> Column:
    """The first required field of the type that the payload lacks, else null."""
    out = F.lit(None).cast("string")
    for name, fields in REQUIRED.items():
        for f in reversed(fields):
            out = F.when((kind == name) & (F.coalesce(F.get_json_object(payload, f"$.{f}"), F.lit("")) == ""), f).otherwise(out)
    return out


def routed(messages: DataFrame) -> DataFrame:
    """Decoded messages with "queue" and "outcome": dead_letter for what cannot be read or lacks a field or a known type,
    expired for old e-mail, else accept; and "reason"."""
    e = F.col("envelope")
    lacks = missing_field(e["type"], e["payload"])
    queue = F.try_element_at(_map(QUEUES), e["type"])
    reason = F.when(e.isNull() | e["id"].isNull(), "unreadable").when(queue.isNull(), "unknown_type").when(lacks.isNotNull(), F.concat(F.lit("missing "), lacks))
    return messages.withColumns({"queue": queue, "reason": reason, "outcome": F.when(reason.isNotNull(), "dead_letter").otherwise("accept")})


def expired(messages: DataFrame, now: Column, at: str = "ts") -> DataFrame:
    """E-mail that is older than an hour becomes expired, which is kept apart from what is poison."""
    old = (F.col("queue") == "email-processing") & (F.col(at).cast("timestamp") < now - F.expr(f"INTERVAL {EMAIL_EXPIRES_SECONDS} SECONDS"))
    return messages.withColumn("outcome", F.when((F.col("outcome") == "accept") & old, "expired").otherwise(F.col("outcome")))


def deduplicated(messages: DataFrame, at: str = "ts", keys: tuple[str, ...] = ("queue", "id", "attempt"), within: str = "24 hours") -> DataFrame:
    """One message of each queue, id and attempt within a day; a higher attempt is another message."""
    if messages.isStreaming:
        return messages.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))
    return messages.dropDuplicates(list(keys))


def death_count(headers: Column, queue: Column) -> Column:
    """Deliveries counted by the wait queues of a queue (array of queue, count); malformed entries count nothing."""
    mine = F.filter(F.coalesce(headers, F.array().cast("array<struct<queue:string,count:bigint>>")), lambda x: x["queue"].startswith(F.concat(queue, F.lit(".retry."))))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["count"], F.lit(0)))


def retry_tier(deaths: Column) -> Column:
    """The wait before the next delivery; null once all are used up, which means the dead-letter queue."""
    return F.get(F.array(*[F.lit(t) for t in TIERS]), F.greatest(F.lit(0), deaths).cast("int"))


def follow_up(messages: DataFrame, failed: Column, retryable: Column) -> DataFrame:
    """Messages with "next": result on success, a wait queue while a retry is left, else the dead-letter queue."""
    tier = retry_tier(F.col("deaths"))
    return messages.withColumn("next", F.when(~failed, "result").when(retryable & tier.isNotNull(), F.concat(F.col("queue"), F.lit(".retry."), tier)).otherwise(F.concat(F.col("queue"), F.lit(".dlq"))))


def result_envelope(results: DataFrame) -> DataFrame:
    """(value) of task results as JSON envelopes."""
    body = F.struct("task_id", "task_type", "status", "error", "envelope_id", "document_id")
    return results.select(F.to_json(F.struct(F.col("task_id").alias("id"), F.lit("task.result").alias("type"), F.to_json(body).alias("payload"))).alias("value"))


def profile_status(task: Column) -> Column:
    # What a profile is after each task.
    return F.when(task == "sync", "synced").when(task == "validate", "validated").when(task == "enrich", "enriched").otherwise("processed")


#: A document's status moves up these ranks only, and the last two are final.
RANKS = {"pending": 0, "processing": 1, "completed": 2, "failed": 2}


def final_status(results: DataFrame, key: str = "document_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(key, status): the first final status holds for ever; before one, the highest rank, then the latest."""
    ranked = results.where(F.col(key).isNotNull()).withColumn("rank", F.try_element_at(_map(RANKS), F.col("status"))).where("rank is not null")
    at = F.struct(*order)
    by = ranked.groupBy(key).agg(F.min_by("status", F.when(F.col("rank") == 2, at)).alias("done"), F.max_by("status", F.struct("rank", at)).alias("open"), F.max("rank").alias("top"))
    return by.select(key, F.when(F.col("top") == 2, F.col("done")).otherwise(F.col("open")).alias("status"))


class StatusFold(StatefulProcessor):
    """Applies results to documents one after the other: a final status stays, and a repeated one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else "pending"
        before = now
        for batch in rows:
            for r in batch.sort_values(["ts", "event_id"]).itertuples():
                if RANKS[now] < 2 and RANKS.get(r.status, -1) >= RANKS[now]:
                    now = r.status
        if now != before or not self.state.exists():
            self.state.update((now,))
            yield pd.DataFrame({"document_id": [key[0]], "status": [now]})

    def close(self) -> None:
        pass


def status_stream(results: DataFrame) -> DataFrame:
    """(document_id, status) updates of a stream of (document_id, status, ts, event_id)."""
    return results.groupBy("document_id").transformWithStateInPandas(StatusFold(), outputStructType="document_id string, status string", outputMode="Update", timeMode="None")


#: States that the waiting messages of one queue are dealt to.
SHARDS = 256


class DelayedRetry(StatefulProcessor):
    """Holds failed messages for the wait of their tier by a timer, then gives them back to the work queue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id string, attempt int, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for r in batch.itertuples():
                due = now + 1000 * TIER_SECONDS[TIERS[min(int(r.attempt), len(TIERS) - 1)]]
                self.held.appendValue((r.id, int(r.attempt), due))
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        every = list(self.held.get())
        ready = [x for x in every if x[2] <= due]
        self.held.clear()
        for x in every:
            if x[2] > due:
                self.held.appendValue(x)
        if ready:
            yield pd.DataFrame({"queue": [key[0]] * len(ready), "id": [x[0] for x in ready], "attempt": [x[1] + 1 for x in ready]})

    def close(self) -> None:
        pass


def delayed_retries(failed: DataFrame) -> DataFrame:
    """(queue, id, attempt) given back after their waits, of a stream of failed (queue, id, attempt). A queue's messages are
    dealt to SHARDS states by a hash of their id, so no state holds all that one queue has waiting."""
    return failed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int")).groupBy("queue", "shard").transformWithStateInPandas(DelayedRetry(), outputStructType="queue string, id string, attempt int", outputMode="Append", timeMode="ProcessingTime")


def retry_schedule(failed: DataFrame, at: str = "ts") -> DataFrame:
    """(queue, id, attempt, due): when each failed (queue, id, attempt) goes back to the work queue, and as which attempt."""
    tier = F.least(F.col("attempt"), F.lit(len(TIERS) - 1))
    waits = F.array(*[F.lit(TIER_SECONDS[t]) for t in TIERS])
    return failed.select("queue", "id", (F.col("attempt") + 1).alias("attempt"), F.timestamp_micros(F.unix_micros(at) + F.get(waits, tier) * F.lit(1_000_000).cast("long")).alias("due"))


def published(messages: DataFrame, send: Callable[[list[str], int], list[bool]], key: str = "id", body: str = "value", tries: int = 3, batch: int = 100) -> DataFrame:
    """(key, confirmed, tries): messages sent ``batch`` at a time, where ``send`` (bodies, try) says which are confirmed;
    the others are sent again. What is not confirmed after all tries stays pending for the relay.

    A lost task sends its messages again, so consumers drop repeated ids.
    """
    kind = messages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch].reset_index(drop=True)
                used, open_ = [0] * len(some), list(range(len(some)))
                for t in range(1, tries + 1):
                    for i in open_:
                        used[i] = t
                    ok = send(some[body].iloc[open_].tolist(), t)
                    open_ = [i for i, x in zip(open_, ok) if not x]
                    if not open_:
                        break
                lost = set(open_)
                yield pd.DataFrame({key: some[key], "confirmed": [i not in lost for i in range(len(some))], "tries": used})

    return messages.select(key, body).mapInPandas(run, f"{key} {kind}, confirmed boolean, tries int")


def sink_by_outcome(folder: str, outcomes: tuple[str, ...] = ("accept", "expired", "dead_letter")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each outcome under the batch's number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for o in outcomes:
                batch.where(F.col("outcome") == o).write.mode("overwrite").parquet(f"{folder}/{o}/batch={number}")
        finally:
            batch.unpersist()

    return write


def pending_outbox(outbox: DataFrame, sent: DataFrame, limit: int = 100) -> DataFrame:
    """The next outbox rows to send, by id, without those sent; the batch size is the relay's."""
    return outbox.join(sent.select("id"), "id", "left_anti").orderBy("id").limit(limit)
