"""Job queues in batch and as a stream, log lines, progress."""

import random

from foliant.streaming import jobs


def plain(events):
    """The rules of a queue said once more, over one dictionary of jobs."""
    order, status, started, stopping, out = [], {}, False, None, []
    for seq, action, job, code in events:
        was = dict(status)
        running = next((j for j in order if status[j] == "running"), None)
        if action == "enqueue" and job not in status:
            order.append(job)
            status[job] = "queued"
        if action == "start":
            started = True
        if action == "remove" and job in status and job != running:
            order.remove(job)
            del status[job]
        if action == "requeue" and status.get(job) in ("stopped", "error"):
            status[job] = "queued"
        if action == "stop" and running:
            stopping = running
        if action in ("exit", "fail") and running:
            status[running] = "error" if action == "fail" else "completed" if code == 0 else "stopped" if stopping == running else "error"
            stopping = None if action == "exit" else stopping
        if action.startswith("clear"):
            keep = ("queued", "running") if action == "clear_completed" else ("running",)
            order = [j for j in order if status[j] in keep]
            status = {j: status[j] for j in order}
        if started and "running" not in status.values() and action in jobs_that_advance:
            waiting = next((j for j in order if status[j] == "queued"), None)
            if waiting is not None:
                status[waiting] = "running"
        out += [(seq, j, status.get(j, "removed")) for j in {**was, **status} if was.get(j) != status.get(j, "removed")]
    return out


jobs_that_advance = {"enqueue", "start", "requeue", "exit", "fail"}
ACTIONS = ["enqueue", "enqueue", "start", "remove", "requeue", "stop", "exit", "exit", "fail", "clear_completed", "clear_all"]


def test_queue_rules():
    q = jobs.Queue()
    assert q.take("enqueue", "a") == [("a", "queued")]
    assert q.take("exit", None, 0) == []  # nothing runs before the start
    assert q.take("start") == [("a", "running")]
    assert q.take("enqueue", "b") == [("b", "queued")]  # one at a time
    assert q.take("remove", "a") == []  # a running job stays
    assert q.take("stop") == []
    assert q.take("exit", None, 143) == [("a", "stopped"), ("b", "running")]
    assert q.take("exit", None, 0) == [("b", "completed")]
    assert q.take("requeue", "b") == []  # only stopped ones and errors
    assert q.take("requeue", "a") == [("a", "running")]
    assert q.take("exit", None, 1) == [("a", "error")]
    assert q.take("clear_completed") == [("a", "removed"), ("b", "removed")]


def test_queue_by_another_way():
    rng = random.Random(5)
    for _ in range(200):
        events = [(i, rng.choice(ACTIONS), rng.choice("abcd"), rng.randint(0, 1)) for i in range(40)]
        queue = jobs.Queue()
        got = [(i, j, s) for i, a, job, code in events for j, s in queue.take(a, job, code)]
        assert sorted(got) == sorted(plain(events))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i % 3, i, rng.choice(ACTIONS), rng.choice("abcd"), rng.randint(0, 1)) for i in range(120)]
    schema = "queue_id long, seq long, action string, job_id string, code int"
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in/{k}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = jobs.streamed_queue(events).writeStream.format("memory").queryName("queue_changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, jobs.queue_changes(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(tuple, spark.table("queue_changes").collect())) == want


def test_lines_of_a_stream(spark, tmp_path):
    rows = [(1, 0, "ab"), (1, 1, "c\nd"), (2, 0, "x\n\ny\n"), (1, 2, "\ne")]
    schema = "job_id long, seq long, data string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = jobs.streamed_lines(chunks).writeStream.format("memory").queryName("chunk_lines").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {(1, 0, "abc"), (1, 1, "d"), (2, 0, "x"), (2, 1, ""), (2, 2, "y")}
    assert set(map(tuple, spark.table("chunk_lines").collect())) == closed
    assert set(map(tuple, jobs.lines_of(spark.createDataFrame(rows, schema)).collect())) == closed | {(1, 2, "e")}


def test_progress(spark):
    lines = ["Stage 2: Two ", "[3/9] A title (cached)", "x [1/2] B → c", "[1/2] C... ", "  4/5:  D", "4/5: no", "Output:  /o "]
    df = spark.createDataFrame(list(enumerate(lines)), "job_id long, line string")
    got = df.select(*[c.alias(k) for k, c in jobs.progress(df["line"]).items()]).collect()
    assert [(r.event_type, r.number, r.total, r.title) for r in got] == [("stage", 2, None, "Two"), ("section", 3, 9, "A title"), ("section", 1, 2, "B"), ("section", 1, 2, "C"), ("section", 4, 5, "D"), (None,) * 4, (None,) * 4]
    assert got[-1].output_dir == "/o"


def test_malformed_progress(spark):
    df = spark.createDataFrame([('{"status":"a","total":8,"completed":1}',), ("",), ("{x",), ('{"total":0,"completed":1}',), ('{"error":"e"}',)], "line string")
    assert [tuple(r) for r in jobs.pull_progress(df).collect()] == [("a", 13, None), ("", None, None), ("", None, "e")]
