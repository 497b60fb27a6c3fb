"""Streaming queries over ``events``, run to completion over the files at hand (``AvailableNow``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import read_table as read
from foliant.streaming import tasks, windows

from .registry import query


def _stream(spark: SparkSession, d: str, files: int | None = None) -> DataFrame:
    """``events`` as a stream of files; a single file is read through its folder."""
    schema = read(spark, d, "events").schema
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    s = reader.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that holds timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drained(spark: SparkSession, stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Runs a stream until its input is used up, and its result as a table in the shared folder; ``at`` goes on with an earlier run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # read when a stream starts
    try:
        return _run(spark, stream, mode, at)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _run(spark: SparkSession, stream: DataFrame, mode: str, at: str | None) -> DataFrame:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="foliant-stream-")
    at = at or f"{base.rstrip('/')}/foliant/stream-{uuid.uuid4().hex[:12]}"

    epochs: list[int] = []

    def write(df: DataFrame, epoch: int) -> None:
        epochs.append(epoch)
        df.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(write).start()
    q.awaitTermination()
    last = f"epoch={max(epochs)}" if mode == "complete" and epochs else "epoch=*"  # a complete result replaces earlier ones
    return spark.read.schema(stream.schema).parquet(f"{at}/out/{last}")


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by all")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Complete-mode tumbling counts; the last epoch holds every window."""
    counted = windows.tumbling(_stream(spark, d), "1 day", None).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
    out = _drained(spark, counted, "complete")
    return out


@query("select event_id, user_id from events")
def stream_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    """Records delivered twice come out once."""
    s = _stream(spark, d)
    twice = s.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return _drained(spark, tasks.once(twice, "event_id", "3650 days").select("event_id", "user_id"), "append")


@query("""
    with f as (select user_id as task_id, ts, event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) as run, event_type from events where event_type in ('error', 'purchase')),
    n as (select task_id, ts, row_number() over (partition by task_id, run order by ts, event_id) - max(case when event_type = 'purchase' then 1 else 0 end) over (partition by task_id, run) as k, event_type from f)
    select task_id, ts, cast((k - 1) % 8 + 1 as int) as attempt, case when k % 8 = 0 then 'DEAD' else 'RETRY' end as action from n where event_type = 'error'
""")
def stream_retry_queue(spark: SparkSession, d: str) -> DataFrame:
    """Errors ask for retries, purchases clear the count, the eighth failure in a row is a dead letter."""
    s = _stream(spark, d).where("event_type in ('error', 'purchase')").select(F.col("user_id").alias("task_id"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    return _drained(spark, tasks.retry_queue(s).select("task_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "attempt", "action"), "append")


@query("""
    with f as (select user_id as task_id, epoch_us(ts) // 1000 as t, event_type = 'purchase' as ok, event_id from events where event_type in ('error', 'purchase')),
    r as (select *, sum(case when ok then 1 else 0 end) over (partition by task_id order by t, ok, event_id) as run from f),
    n as (select task_id, t, run, row_number() over (partition by task_id, run order by t, event_id) as k from r where not ok),
    s as (select task_id, run, min(t) as done from r where ok group by task_id, run),
    e as (select n.task_id, cast((k - 1) % 3 + 1 as int) as attempt, case when k % 3 = 0 then 'DEAD' else 'RETRY' end as action, t + case when k % 3 = 0 then 0 else 86400000 * ((k - 1) % 3 + 1) end as t, done
      from n left join s on s.task_id = n.task_id and s.run = n.run + 1)
    select task_id, attempt, action, make_timestamp_ms(t) as released from e where t <= (select max(t) from f) and (action = 'DEAD' or done is null or t <= done)
""")
def stream_delayed_retries(spark: SparkSession, d: str) -> DataFrame:
    """Errors come back one, two days later unless a purchase comes first; the third in a row is a dead letter."""
    s = _stream(spark, d).where("event_type in ('error', 'purchase')").select(F.col("user_id").alias("task_id"), "ts", (F.col("event_type") == "purchase").alias("ok"))
    out = tasks.delayed_retries(s, most=3, delay=86_400)
    return _drained(spark, out.withColumn("released", F.col("released").cast("timestamp_ntz")), "append")


@query("""
    select event_id, case when value <= 20 then 'HIGH' else 'LOW' end as priority, 'PRIVATE' as visibility, 1 as doc_version from events
""")
def queue_payloads(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("value") * F.lit(tasks.HIGH_PRIORITY_BYTES / 20)).cast("double")
    raw = F.to_json(F.struct(F.col("event_id").cast("string").alias("taskId"), F.ceil(size).cast("long").alias("file_size")))
    return read(spark, d, "events").select("event_id", tasks.parse_payload(raw).alias("p")).select("event_id", "p.priority", "p.visibility", "p.doc_version")


@query("""
    select event_id, case when event_type = 'view' then 'WAITING' when event_type in ('click', 'purchase') then 'DONE' when event_id % 3 = 2 then 'FAILED' else 'READY' end as status,
      cast(event_id % 3 + case when event_type in ('error', 'signup') then 1 else 0 end as bigint) as retries from events
""")
def outbox_states(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "WAITING").otherwise("READY")
    step = tasks.outbox_step(status, F.col("event_type").isin("click", "purchase"), F.col("event_id") % 3)
    return read(spark, d, "events").select("event_id", step.alias("s")).select("event_id", "s.status", "s.retries")
