"""Streams with state by key against what the batch operators give."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import rounds
from foliant.streaming import jobs, keyed


@pytest.fixture(autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, batches, schema, f, name):
    """f over a stream in which each batch is one trigger."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = f(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q


SEGMENTS = "doc_id string, section_idx long, title string, content string"


def test_dialogue(spark, tmp_path):
    rows = [("a", i, f"Title {i % 3} of it" if i != 2 else None, "words " * i) for i in range(5)] + [("b", i, f"Part {i}", None) for i in range(3)] + [(None, 0, "No id", "x")]
    order = [[3, 1, 6], [0, 7, 8], [0, 4, 3], [2, 5]]  # out of order, and some come again
    got, _ = streamed(spark, tmp_path, [[rows[i] for i in x] for x in order], SEGMENTS, lambda s: keyed.streamed_dialogue(s, rounds.stub_speaker), "dialogue")
    batch = rounds.dialogue_rounds(spark.createDataFrame(rows, SEGMENTS), f"file://{tmp_path}/rounds", rounds.stub_speaker)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_waiting_segments(spark, tmp_path):
    got, _ = streamed(spark, tmp_path, [[("a", 1, "Two", "x")], [("a", 2, "Three", "x")]], SEGMENTS, lambda s: keyed.streamed_dialogue(s, rounds.stub_speaker), "waiting")
    assert got == []  # the first hasn't come


def test_translated_prompts_are_alike(spark, tmp_path):
    def make():
        return lambda system, text: f"{len(system)} {system[-40:]}|{text[:60]}\nTOPICS COVERED:\n- t{len(text)}"

    rows = [("a", i, f"T{i}", "c") for i in range(3)]
    got, _ = streamed(spark, tmp_path, [rows], SEGMENTS, lambda s: keyed.streamed_dialogue(s, make, "host_guest", ("A", "B"), 900, 130, "de", "fr"), "translated")
    batch = rounds.dialogue_rounds(spark.createDataFrame(rows, SEGMENTS), f"file://{tmp_path}/rounds", make, None, "host_guest", ("A", "B"), 900, 130, "de", "fr")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))


EVENTS = "job_id string, seq long, event_type string, number int, total int, title string"


def test_runtime(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(120):
        kind = r.choice(["log", "log", "stage", "section", "requeue"] if r.random() < 0.3 else ["log", "stage", "section"])
        rows.append((r.choice(["a", "b", "c"]), i, kind, r.randrange(5) if kind != "log" else None, 9 if kind == "section" else None, f"t{i}" if kind == "section" else None))
    batches = [rows[i : i + 30] for i in range(0, 120, 30)]
    for b in batches:
        r.shuffle(b)
    got, _ = streamed(spark, tmp_path, [b + b[:3] for b in batches] + [rows[:2]], EVENTS, keyed.streamed_runtime, "runtime")
    last = {}
    for x in got:
        last[x.job_id] = max(last.get(x.job_id, x), x, key=lambda x: x.seq)
    want = {x.job_id: x for x in jobs.runtime_state(spark.createDataFrame(rows, EVENTS)).collect()}
    for k in set(last) - set(want):  # the batch has no row of a job whose last event is a requeue
        x = last.pop(k)
        assert (x.n_logs, x.stages, x.current_stage, x.section) == (0, "", None, None)
    assert {k: tuple(v[c] for c in keyed.SHOWN if c != "seq") for k, v in last.items()} == {k: tuple(v[c] for c in keyed.SHOWN if c != "seq") for k, v in want.items()}


def test_idle_jobs_are_forgotten(spark, tmp_path):
    spark.createDataFrame([("a", 0, "stage", 1, None, None)], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = keyed.streamed_runtime(source, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    held = lambda: [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    end = time.time() + 60
    while time.time() < end and not (held() and max(held()) > 0 and held()[-1] == 0):
        time.sleep(0.5)
    q.stop()
    assert max(held()) > 0 and held()[-1] == 0
    assert [(x.job_id, x.stages) for x in spark.table("idle").collect()] == [("a", "1")]


CHUNKS = "job_id string, seq long, data string, at timestamp"


def test_progress(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=m)
    log = "Stage 1: One\n[1/2] A title (cached)\nother\nStage 1: One\n  2/2: B\nStage 2: Two\nlast [2/2] C"
    cuts = [0, 5, 20, 21, 48, 60, len(log)]
    rows = [("a", i, log[x:y], t(i)) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows += [("b", 0, "Stage 1: Of b\n\nno end", t(2)), ("b", 1, None, t(3))]
    batches = [[rows[0], rows[1]], [rows[3], rows[2], rows[6]], [rows[4], rows[1], rows[5], rows[7]], [("z", 0, "x\n", t(500))], [("z", 1, "y\n", t(1000))]]
    got, q = streamed(spark, tmp_path, batches, CHUNKS, lambda s: keyed.streamed_progress(s, "10 minutes", 600_000), "progress")
    lines = jobs.lines_of(spark.createDataFrame([x for x in rows if x[2]], CHUNKS))
    p = lines.select("job_id", "line_idx", *[c.alias(k) for k, c in jobs.progress(F.col("line")).items() if k != "output_dir"]).where("event_type is not null")
    first = jobs.first_stages(p.orderBy("line_idx").coalesce(1)).unionByName(p.where("event_type <> 'stage'"))
    strip = lambda x: (x.job_id, x.event_type, x.number, x.total, x.title)
    assert sorted(map(strip, got), key=str) == sorted(map(strip, first.collect()), key=str)
    rows_held = [op.numRowsTotal for op in q.lastProgress.stateOperators]
    assert len(rows_held) == 2 and sum(rows_held) <= 6  # the jobs before are gone
