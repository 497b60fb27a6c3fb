import datetime

from pyspark.sql import functions as F

from foliant.streaming import tasks


def test_payloads(spark):
    raw = ['{"taskId":"t1","fileName":"a.pdf","fileSize":10,"visibility":"dept","aclTokens":["x"]}', '{"task_id":"t2","file_size":99999999,"acl_tokens":"a，b, "}', "not json"]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(tasks.parse_payload(F.col("raw")).alias("p")).select("p.*").collect()
    assert [(r.task_id, r.visibility, r.acl_tokens, r.priority, r.doc_version) for r in rows] == [("t1", "DEPT", ["x"], "HIGH", 1), ("t2", "PRIVATE", ["a", "b"], "LOW", 1), (None, "PRIVATE", [], "HIGH", 1)]


def test_due_retries(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    r = spark.createDataFrame([(1, "RETRY", t(5)), (2, "RETRY", t(1)), (3, "DEAD", t(0)), (4, "RETRY", t(30))], "task_id long, action string, due timestamp")
    assert [x.task_id for x in tasks.due(r, F.lit(t(10))).collect()] == [2, 1]


def test_outbox_and_recovery(spark):
    df = spark.createDataFrame([("READY", True, 0), ("READY", False, 0), ("READY", False, 2), ("DONE", False, 1)], "s string, ok boolean, n int")
    assert [tuple(r[0]) for r in df.select(tasks.outbox_step(F.col("s"), F.col("ok"), F.col("n"))).collect()] == [("DONE", 0), ("READY", 1), ("FAILED", 3), ("DONE", 1)]
    m = spark.createDataFrame([(1,), (15,), (60,)], "m int").select(tasks.recovery_action(F.col("m"))).collect()
    assert [r[0] for r in m] == ["WAIT", "REQUEUE", "ERROR"]


def test_several_micro_batches(spark, tmp_path):
    """Complete results replace each other; attempts go on over micro-batches and follow time within one."""
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1 + i // 40, 0, i % 40), i % 3, "error" if i % 2 else "view", 1.0, "{}") for i in range(120)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40][::-1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    from foliant.plans import streams
    from foliant.streaming import tasks, windows

    s = streams._stream(spark, str(tmp_path), files=1)
    counted = streams._drained(spark, windows.tumbling(s, "1 day", None).select("window", "event_type", "n"), "complete")
    assert sum(r.n for r in counted.collect()) == 120 and counted.count() == 6
    s = streams._stream(spark, str(tmp_path), files=1).select(F.lit(5).cast("long").alias("task_id"), "ts", F.lit(False).alias("ok"))
    out = streams._drained(spark, tasks.retry_queue(s), "append").orderBy("ts").collect()
    assert [r.attempt for r in out] == [i % 8 + 1 for i in range(120)]


def brute_delayed(rows, most, delay, now):
    """(task, attempt, action, minute) of results (task, minute, ok) up to ``now``; failures before successes of one minute."""
    out = []
    for task in {r[0] for r in rows}:
        n, pending = 0, []
        for at, ok in [*sorted((r[1], r[2]) for r in rows if r[0] == task and r[1] <= now), (now, None)]:
            out += [(task, a, "RETRY", d) for d, a in pending if d <= at]
            pending = [p for p in pending if p[0] > at]
            if ok is True:
                n, pending = 0, []
            elif ok is False and n + 1 >= most:
                out.append((task, n + 1, "DEAD", at))
                n = 0
            elif ok is False:
                n += 1
                pending.append((at + delay * n, n))
    return sorted(out)


def test_delayed_retries_leave_when_due(spark, tmp_path):
    """Over several micro-batches and a restart, in any order within the lateness, the same rows as in one run."""
    import random

    from foliant.plans import streams

    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(4), m, rng.random() < 0.3) for m in range(0, 300) if rng.random() < 0.7]
    rows.append((99, 300, True))  # brings the watermark to the end
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(5))
    schema = "task_id long, ts timestamp, ok boolean"

    def add(part):
        spark.createDataFrame([(t, start + datetime.timedelta(minutes=m), ok) for t, m, ok in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go(at):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return streams._drained(spark, tasks.delayed_retries(s, most=3, delay=7 * 60, late="10 minutes"), "append", at)

    add([(1, -50, False)])
    for k in range(0, len(late) // 2, 40):
        add(late[k : min(k + 40, len(late) // 2)])
    at = f"{tmp_path}/run"
    go(at)
    half = spark.read.parquet(f"{at}/out").count()
    for k in range(len(late) // 2, len(late), 40):
        add(late[k : k + 40])
    out = go(at)
    got = sorted((r.task_id, r.attempt, r.action, int((r.released - start).total_seconds() // 60)) for r in out.collect())
    rows.append((1, -50, False))
    assert got == brute_delayed(rows, 3, 7, 290) and 0 < half < len(got)
    again = sorted((r.task_id, r.attempt, r.action, int((r.released - start).total_seconds() // 60)) for r in go(f"{tmp_path}/other").collect())
    assert again == got


def test_state_is_freed_after_success(spark, tmp_path):
    from foliant.plans import streams

    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, t(1), False), (1, t(2), True), (2, t(1), False), (3, t(50), True)], "task_id long, ts timestamp, ok boolean").write.parquet(f"{tmp_path}/in")
    at = f"{tmp_path}/run"
    s = spark.readStream.schema("task_id long, ts timestamp, ok boolean").parquet(f"{tmp_path}/in")
    got = streams._drained(spark, tasks.delayed_retries(s, most=3, delay=300), "append", at).collect()
    assert [(r.task_id, r.attempt, r.action, r.released) for r in got] == [(2, 1, "RETRY", t(6))]
    held = {name: sorted({r.key.task_id for r in spark.read.format("statestore").option("path", f"{at}/state").option("stateVarName", name).load().collect()}) for name in ("attempts", "waiting", "pending")}
    assert held == {"attempts": [2], "waiting": [], "pending": []}


def test_waiting_results_are_one_entry_a_micro_batch(spark, tmp_path):
    """However many results of a task one micro-batch brings; entry by entry, each was packed, sent and read by itself."""
    from foliant.plans import streams

    start = datetime.datetime(2024, 1, 1)
    rows = [(t, start + datetime.timedelta(minutes=m), m % 5 == 0) for t in (1, 2) for m in range(40)]
    spark.createDataFrame(rows, "task_id long, ts timestamp, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    at = f"{tmp_path}/run"
    s = spark.readStream.schema("task_id long, ts timestamp, ok boolean").parquet(f"{tmp_path}/in")
    got = streams._drained(spark, tasks.delayed_retries(s, most=3, delay=120), "append", at).collect()
    want = brute_delayed([(t, m, m % 5 == 0) for t in (1, 2) for m in range(40)], 3, 2, 39)
    assert sorted((r.task_id, r.attempt, r.action, int((r.released - start).total_seconds() // 60)) for r in got) == want
    entries = lambda name, batch: spark.read.format("statestore").option("path", f"{at}/state").option("batchId", batch).option("stateVarName", name).load().collect()
    assert sorted(r.key.task_id for r in entries("waiting", 0)) == [1, 2] and entries("waiting", 1) == []
    assert sorted(r.key.task_id for r in entries("pending", 1)) == [1, 2]
