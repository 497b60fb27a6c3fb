"""Ingest tasks as streams: payload parsing, priorities, retries with delays and a dead-letter queue, outbox, recovery."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

MOST_ATTEMPTS, DELAY_SECONDS = 8, 60
OUTBOX_RETRIES = 3
HIGH_PRIORITY_BYTES = 5 * 1024 * 1024

PAYLOAD = "taskId string, task_id string, fileName string, file_name string, fileSize long, file_size long, deptCode string, dept_code string, visibility string, aclTokens array<string>, acl_tokens string, uploaderId string, uploader_id string, docVersion int, doc_version int"


def parse_payload(raw: Column) -> Column:
    """A queue record's JSON, camelCase or snake_case, as one struct with defaults."""
    p = F.from_json(raw, PAYLOAD)
    split = F.filter(F.transform(F.split(F.replace(p["acl_tokens"], F.lit("，"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    size = F.coalesce(p["fileSize"], p["file_size"], F.lit(0))
    return F.struct(
        F.coalesce(p["taskId"], p["task_id"]).alias("task_id"), F.coalesce(p["fileName"], p["file_name"]).alias("file_name"), size.alias("file_size"),
        F.coalesce(p["deptCode"], p["dept_code"]).alias("dept_code"), F.upper(F.coalesce(p["visibility"], F.lit("PRIVATE"))).alias("visibility"),
        F.coalesce(p["aclTokens"], split, F.array().cast("array<string>")).alias("acl_tokens"), F.coalesce(p["uploaderId"], p["uploader_id"]).alias("uploader_id"),
        F.coalesce(p["docVersion"], p["doc_version"], F.lit(1)).alias("doc_version"), F.when(size <= HIGH_PRIORITY_BYTES, "HIGH").otherwise("LOW").alias("priority"),
    )


def recovery_action(minutes: Column, requeue: int = 15, timeout: int = 60) -> Column:
    return F.when(minutes >= timeout, "ERROR").when(minutes >= requeue, "REQUEUE").otherwise("WAIT")


def outbox_step(status: Column, ok: Column, retries: Column) -> Column:
    """Next (status, retries) of an outbox row: READY goes to DONE, or fails and is retried up to a limit."""
    failed = F.struct(F.when(retries + 1 >= OUTBOX_RETRIES, "FAILED").otherwise("READY").alias("status"), (retries + 1).alias("retries"))
    return F.when(status != "READY", F.struct(status.alias("status"), retries.alias("retries"))).when(ok, F.struct(F.lit("DONE").alias("status"), retries.alias("retries"))).otherwise(failed)


def _retry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One task's failures: each asks for a retry after a growing delay, until it goes to the dead letters."""
    attempts, = state.get if state.exists else (0,)
    out = []
    # a task's results of one micro-batch in time order, however many Arrow batches they come in
    for at, ok in sorted(x for pdf in batches for x in zip(pdf["ts"], pdf["ok"], strict=True)):
        if ok:
            attempts = 0
            continue
        attempts += 1
        dead = attempts >= MOST_ATTEMPTS
        out.append((key[0], at, attempts, "DEAD" if dead else "RETRY", at + pd.Timedelta(seconds=0 if dead else DELAY_SECONDS * attempts)))
        attempts = 0 if dead else attempts
    state.update((attempts,))
    yield pd.DataFrame(out, columns=["task_id", "ts", "attempt", "action", "due"])


def retry_queue(results: DataFrame) -> DataFrame:
    """Stream of task results (task_id, ts, ok) -> retries with their due time, and dead letters; state is one count a task."""
    return results.groupBy("task_id").applyInPandasWithState(_retry, "task_id long, ts timestamp, attempt int, action string, due timestamp", "attempts int", "append", GroupStateTimeout.NoTimeout)


#: Entries of the state lists, each of many results or retries: every entry is packed and sent by itself.
WAITING, PENDING = "at array<long>, ok array<boolean>", "due array<long>, attempt array<int>"
DELAYED = "task_id long, attempt int, action string, released timestamp"


def _packed(rows: list[tuple]) -> tuple[list, list]:
    first, second = zip(*rows, strict=True)
    return list(first), list(second)


class DelayQueue(StatefulProcessor):
    """Failures leave as retries when they are due, by timers in event time.

    Results wait until the watermark has passed them, so they are taken in time order whatever micro-batches bring them.  A
    failure counts an attempt and is due ``delay`` seconds later for each attempt so far; at ``most`` attempts it is a dead
    letter at once and the count starts anew.  A success forgets attempts and retries that aren't due yet; what is due at
    that very time leaves first.  A task that has nothing waiting, pending or counted has no state.
    """

    def __init__(self, most: int, delay: int):
        self.most, self.delay = most, delay * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n int")
        self.waiting = handle.getListState("waiting", WAITING)
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        new = [(int(r["at"]), bool(r["ok"])) for r in rows]
        self.waiting.appendValue(_packed(new))
        self.handle.registerTimer(min(at for at, _ in new))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waited, pended = (sorted(x for packed in state.get() for x in zip(*packed, strict=True)) for state in (self.waiting, self.pending))
        counted, = self.attempts.get() or (0,)
        n, due, out, taken = counted, deque(pended), [], 0
        while True:
            at = waited[taken][0] if taken < len(waited) else None
            if due and due[0][0] <= now and (at is None or due[0][0] <= at):
                when, attempt = due.popleft()
                out.append((key[0], attempt, "RETRY", when))
            elif at is not None and at <= now:
                ok = waited[taken][1]
                taken += 1
                if ok:
                    n, due = 0, deque()
                elif n + 1 >= self.most:
                    out.append((key[0], n + 1, "DEAD", at))
                    n = 0
                else:
                    n += 1
                    due = deque(sorted([*due, (at + self.delay * n, n)]))
            else:
                break
        left, due = waited[taken:], list(due)
        # every call is a message to the JVM, so what stays as it was is left alone
        for state, before, kept in ((self.waiting, waited, left), (self.pending, pended, due)):
            if kept != before:
                state.put([_packed(kept)]) if kept else state.clear()
        if n != counted:
            self.attempts.update((n,)) if n else self.attempts.clear()
        if left or due:
            self.handle.registerTimer(min(x[0][0] for x in (left, due) if x))
        for task, attempt, action, when in out:
            yield Row(task_id=task, attempt=attempt, action=action, released=datetime.fromtimestamp(when // 1000, timezone.utc).replace(microsecond=when % 1000 * 1000))

    def close(self) -> None:
        pass


def delayed_retries(results: DataFrame, most: int = 3, delay: int = 60, late: str = "0 seconds") -> DataFrame:
    """Stream of task results (task_id, ts, ok) -> retries at the time they are due, and dead letters: (task_id, attempt, action, released).

    Times are whole milliseconds; of results at one time failures come first.  Results more than ``late`` behind are dropped.
    The session needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = results.withWatermark("ts", late).select("task_id", "ts", F.unix_millis("ts").alias("at"), "ok")
    return rows.groupBy("task_id").transformWithState(DelayQueue(most, delay), DELAYED, "append", "EventTime")


def due(retries: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Retries whose time has come, the earliest first, at most ``most``: the batch drain of the delay queue."""
    return retries.where((F.col("action") == "RETRY") & (F.col("due") <= now)).orderBy("due", "task_id").limit(most)


def once(stream: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries of a record within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]) if stream.isStreaming else stream.dropDuplicates([key])


def kafka_source(spark, servers: str, topic: str) -> DataFrame:
    """Payload stream from a broker (needs the connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(parse_payload(F.col("value").cast("string")).alias("p"), F.col("timestamp").alias("ts")).select("p.*", "ts")
