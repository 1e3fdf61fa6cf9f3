"""Job queues, progress lines and the state that a job shows: as batch folds over event logs, and as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an action does to a job that stands alone (without a queue).
NEXT = {"enqueue": "queued", "start": "running", "exit_ok": "completed", "exit_error": "error", "stop": "stopped"}
# Stages of each pipeline, 5 for any other.
STAGE_TOTALS = {"audiobook": 5, "podcast": 7}


class Queue:
    """One first-in, first-out queue. At most one job runs; the next one starts by itself once the queue has been started. Actions that a
    state doesn't allow change nothing."""

    def __init__(self, state: dict | None = None):
        s = state or {"jobs": [], "started": False, "stopping": None}
        self.jobs: list[list[str]] = s["jobs"]  # [job, status], in order
        self.started: bool = s["started"]
        self.stopping: str | None = s["stopping"]

    def state(self) -> dict:
        return {"jobs": self.jobs, "started": self.started, "stopping": self.stopping}

    def first(self, status: str) -> list[str] | None:
        return next((j for j in self.jobs if j[1] == status), None)

    def find(self, job: str) -> list[str] | None:
        return next((j for j in self.jobs if j[0] == job), None)

    def advance(self) -> None:
        if self.started and self.first("running") is None and (job := self.first("queued")):
            job[1] = "running"

    def take(self, action: str, job: str | None = None, code: int | None = None) -> list[tuple[str, str]]:
        """Does one action; (job, status) of every job whose status it changes ("removed" for one that leaves), in the order of the queue."""
        before = {j: s for j, s in self.jobs}
        mine, running = self.find(job) if job is not None else None, self.first("running")
        if action == "enqueue" and mine is None and job is not None:
            self.jobs.append([job, "queued"])
        elif action == "start":
            self.started = True
        elif action == "remove" and mine and mine[1] != "running":
            self.jobs.remove(mine)
        elif action == "requeue" and mine and mine[1] in ("stopped", "error"):
            mine[1] = "queued"
        elif action == "stop" and running:
            self.stopping = running[0]
        elif action == "exit" and running:
            running[1] = "completed" if code == 0 else "stopped" if self.stopping == running[0] else "error"
            self.stopping = None
        elif action == "fail" and running:
            running[1] = "error"
        elif action == "clear_completed":
            self.jobs = [j for j in self.jobs if j[1] in ("queued", "running")]
        elif action == "clear_all":
            self.jobs = [j for j in self.jobs if j[1] == "running"]
        else:
            return []
        self.advance()
        now = {j: s for j, s in self.jobs}
        return [(j, now.get(j, "removed")) for j in [*before, *(k for k in now if k not in before)] if before.get(j) != now.get(j, "removed")]


CHANGES = "queue_id {key}, seq long, job_id string, status string"


def _changes(queue: Queue, events: pd.DataFrame) -> list[tuple]:
    out = []
    for e in events.sort_values("seq", kind="stable").itertuples():
        code = None if pd.isna(e.code) else int(e.code)
        out += [(e.queue_id, int(e.seq), j, s) for j, s in queue.take(e.action, e.job_id, code)]
    return out


def queue_changes(events: DataFrame) -> DataFrame:
    """queue_id, seq, job_id, status: each change of a job's status by events (queue_id, seq, action, job_id, code), in the order of seq.
    A queue is a sequence, so its events meet in one task; queues are independent."""

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_changes(Queue(), b), columns=["queue_id", "seq", "job_id", "status"])

    kinds = CHANGES.format(key=events.schema["queue_id"].dataType.simpleString())
    return events.select("queue_id", "seq", "action", F.col("job_id").cast("string").alias("job_id"), F.col("code").cast("double").alias("code")).groupBy("queue_id").applyInPandas(fold, kinds)


def queue_statuses(changes: DataFrame) -> DataFrame:
    """queue_id, job_id, status: what each job that is still in its queue has come to."""
    last = changes.groupBy("queue_id", "job_id").agg(F.max_by("status", "seq").alias("status"))
    return last.where("status <> 'removed'")


def streamed_queue(events: DataFrame) -> DataFrame:
    """queue_changes() of a stream of events; each queue is kept as state. Events of a trigger are taken by seq, and one that comes after
    later ones (or again) is passed over."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        seq, kept = state.get if state.exists else (-1, None)
        queue = Queue(json.loads(kept) if kept else None)
        b = pd.concat(list(batches))
        b = b[b["seq"] > seq].drop_duplicates("seq")
        out = _changes(queue, b)
        state.update((int(max(seq, b["seq"].max())) if len(b) else seq, json.dumps(queue.state())))
        yield pd.DataFrame(out, columns=["queue_id", "seq", "job_id", "status"])

    kinds = CHANGES.format(key=events.schema["queue_id"].dataType.simpleString())
    e = events.select("queue_id", "seq", "action", F.col("job_id").cast("string").alias("job_id"), F.col("code").cast("double").alias("code"))
    return e.groupBy("queue_id").applyInPandasWithState(step, kinds, "seq long, kept string", "append", GroupStateTimeout.NoTimeout)


def queue_label(pipeline: Column, source: Column) -> Column:
    """Kind of the job and the last part of its input."""
    last = F.substring_index(F.substring_index(source, "/", -1), "\\", -1)
    return F.concat(F.when(pipeline == "audiobook", "Audiobook").otherwise("Podcast"), F.lit(" — "), F.when(last == "", source).otherwise(last))


def job_form(pipeline: Column, source: Column, output: Column, source_lang: Column, target_lang: Column, at: Column, local: Column) -> dict[str, Column]:
    """What a filled form asks for: the input without outer space, no language where it is English, and for a local file without an output
    folder one beside it, named by kind and time. An empty input gives null."""
    folder = F.regexp_extract(source, r"(?s)^(.*)[/\\][^/\\]*$", 1)
    beside = F.when(local & source.rlike(r"[/\\]"), F.concat(folder, F.lit("/"), pipeline, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss")))
    return {"input": F.nullif(F.regexp_replace(source, r"(?U)^\s+|\s+\z", ""), F.lit("")), "output": F.coalesce(F.nullif(output, F.lit("")), beside), "source_lang": F.nullif(source_lang, F.lit("en")), "target_lang": F.nullif(target_lang, F.lit("en"))}


def job_status(events: DataFrame) -> DataFrame:
    """job_id, status, n_events from events (job_id, seq, action) of jobs without a queue: the last action decides. queue_changes() has the
    rules of a queue."""
    last = events.groupBy("job_id").agg(F.max_by("action", "seq").alias("action"), F.count("*").alias("n_events"))
    return last.select("job_id", F.element_at(F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv]), F.col("action")).alias("status"), "n_events")


def running_status(events: DataFrame) -> DataFrame:
    """The status after each event of a job without a queue, in order."""
    w = Window.partitionBy("job_id").orderBy("seq")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv]), F.col("action"))
    return events.select("job_id", "seq", "action", status.alias("status"), F.coalesce(F.lag(status).over(w), F.lit("new")).alias("was"))


# Forms of the lines that report progress.
OUTPUT, STAGE = r"^Output:\s+(.+)", r"^Stage (\d+):\s+(.+)"
BRACKETED, NUMBERED = r"\[(\d+)/(\d+)\]\s+(.+?)(?:\s*[→(]|\.{3}|$)", r"^\s+(\d+)/(\d+):\s+(.+)"


def progress(line: Column, pipeline: Column | None = None) -> dict[str, Column]:
    """What a line reports: a stage with number, total and name, or a section with number, total and title; the first form that matches
    wins. output_dir: the folder that an Output line names."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    forms = {"stage": STAGE, "section": BRACKETED, "numbered": NUMBERED}
    which = F.coalesce(*[F.when(line.rlike(p), k) for k, p in forms.items()], F.lit(None))
    of = lambda k, i: F.when(which == k, F.regexp_extract(line, forms[k], i))
    stages = F.lit(5) if pipeline is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_TOTALS.items() for x in kv]), pipeline), F.lit(5))
    return {
        "event_type": F.when(which == "numbered", "section").otherwise(which),
        "number": F.coalesce(*[of(k, 1) for k in forms]).cast("int"),
        "total": F.coalesce(of("section", 2), of("numbered", 2)).cast("int") if pipeline is None else F.coalesce(of("section", 2).cast("int"), of("numbered", 2).cast("int"), F.when(which == "stage", stages)),
        "title": trim(F.coalesce(of("stage", 2), of("section", 3), of("numbered", 3))),
        "output_dir": F.when(line.rlike(OUTPUT), trim(F.regexp_extract(line, OUTPUT, 1))),
    }


def progress_events(lines: DataFrame) -> DataFrame:
    """job_id and progress columns of lines (job_id, line) that report progress. Works on streams as well."""
    return lines.select("job_id", *[c.alias(k) for k, c in progress(F.col("line")).items() if k != "output_dir"]).where("event_type is not null")


def first_stages(p: DataFrame) -> DataFrame:
    """Stages once per job and number (streams: with state by key)."""
    return p.where("event_type = 'stage'").dropDuplicates(["job_id", "number"])


def runtime_state(events: DataFrame) -> DataFrame:
    """What each job shows after events (job_id, seq, event_type, number, total, title): how many lines it has logged, its stages in the
    order of their first report, the current stage, and the section it is at. A requeue forgets all before it, a stage the section."""
    w = Window.partitionBy("job_id")
    e = events.withColumn("__from", F.max(F.when(F.col("event_type") == "requeue", F.col("seq"))).over(w)).where("__from is null or seq > __from")
    e = e.withColumn("__stage", F.max(F.when(F.col("event_type") == "stage", F.col("seq"))).over(w))
    stage, section = F.col("event_type") == "stage", F.col("event_type") == "section"
    first = e.withColumn("__nth", F.row_number().over(Window.partitionBy("job_id", "event_type", "number").orderBy("seq")))
    stages = F.sort_array(F.collect_list(F.when(stage & (F.col("__nth") == 1), F.struct("seq", "number"))))
    at = F.when(section & (F.col("__stage").isNull() | (F.col("seq") > F.col("__stage"))), F.struct("seq", "number", "total", "title"))
    g = first.groupBy("job_id").agg(F.count(F.when(F.col("event_type") == "log", 1)).alias("n_logs"), stages.alias("s"), F.max_by("number", F.when(stage, F.col("seq"))).alias("current_stage"), F.max(at).alias("at"))
    return g.select("job_id", "n_logs", F.array_join(F.transform("s", lambda x: x["number"].cast("string")), ",").alias("stages"), "current_stage", F.col("at.number").alias("section"), F.col("at.total").alias("of_sections"), F.col("at.title").alias("section_title"))


def lines_of(chunks: DataFrame) -> DataFrame:
    """job_id, line_idx, line of chunks (job_id, seq, data): the text of a job's chunks divided into lines; a last line without an end
    counts unless it is blank. Lines are numbered by the ends of lines before them, so only the pieces of one line ever come together."""
    c = chunks.select("job_id", "seq", F.coalesce("data", F.lit("")).alias("data"))
    w = Window.partitionBy("job_id").orderBy("seq", "data").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.regexp_count("data", F.lit("\n"))
    before, place = F.coalesce(F.sum(ends).over(w), F.lit(0)), F.count("*").over(w)
    c = c.withColumns({"__before": before, "__place": place, "__all": F.sum(ends).over(Window.partitionBy("job_id"))})
    pieces = c.select("job_id", "__before", "__place", "__all", F.posexplode(F.split("data", "\n", -1)).alias("__i", "piece")).withColumn("line_idx", (F.col("__before") + F.col("__i")).cast("long"))
    lines = pieces.groupBy("job_id", "line_idx", "__all").agg(F.array_join(F.sort_array(F.collect_list(F.struct("__place", "piece")))["piece"], "").alias("line"))
    return lines.where((F.col("line_idx") < F.col("__all")) | F.col("line").rlike(r"(?U)\S")).select("job_id", "line_idx", "line")


def streamed_lines(chunks: DataFrame) -> DataFrame:
    """lines_of() of a stream: whole lines as they are complete, the open end of each job kept as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        at, tail = state.get if state.exists else (0, "")
        b = pd.concat(list(batches)).sort_values("seq", kind="stable")
        *lines, tail = (tail + "".join(b["data"])).split("\n")
        state.update((at + len(lines), tail))
        yield pd.DataFrame([(key[0], at + i, x) for i, x in enumerate(lines)], columns=["job_id", "line_idx", "line"])

    kind = chunks.schema["job_id"].dataType.simpleString()
    return chunks.groupBy("job_id").applyInPandasWithState(step, f"job_id {kind}, line_idx long, line string", "at long, tail string", "append", GroupStateTimeout.NoTimeout)


def shown(line: Column) -> Column:
    """Whether a log line is shown: separators, stage lines, the head with the configuration and blank lines aren't."""
    return ~(line.startswith("====") | line.startswith("Stage ") | line.rlike(r"^(Output|Format|Target duration|Language|LLM|TTS|  Ollama|  Lang):?\s") | ~line.rlike(r"(?U)\S"))


def severity(line: Column) -> Column:
    return F.when(line.contains("ERROR") | line.contains("Error") | line.contains("Traceback"), "error").when(line.contains("cached"), "muted").otherwise("normal")


def pull_progress(lines: DataFrame) -> DataFrame:
    """lines (..., line) of JSON progress as status, percent and error; blank and malformed lines are dropped. Percent only where both
    numbers are there and not 0, half rounded up. Works on streams as well."""
    kinds = "status string, total double, completed double, error string, _bad string"
    p = lines.where(F.col("line").rlike(r"\S")).withColumn("p", F.from_json("line", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("p is not null and p._bad is null")
    percent = F.when((F.col("p.total") != 0) & (F.col("p.completed") != 0), F.floor(F.col("p.completed") / F.col("p.total") * 100 + 0.5))
    return p.select(*[c for c in lines.columns if c != "line"], F.coalesce("p.status", F.lit("")).alias("status"), percent.cast("long").alias("percent"), F.nullif(F.col("p.error"), F.lit("")).alias("error"))


def streamed_status(events: DataFrame) -> DataFrame:
    """A stream of events (job_id, seq, action) of jobs without a queue to the status of each after each trigger, kept as state by key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        seq, status, n = state.get if state.exists else (-1, "new", 0)
        for b in batches:
            n += len(b)
            last = b.loc[b["seq"].idxmax()]
            if last["seq"] > seq:
                seq, status = int(last["seq"]), NEXT[last["action"]]
        state.update((seq, status, n))
        yield pd.DataFrame([(key[0], status, n)], columns=["job_id", "status", "n_events"])

    kind = events.schema["job_id"].dataType.simpleString()
    return events.groupBy("job_id").applyInPandasWithState(step, f"job_id {kind}, status string, n_events long", "seq long, status string, n long", "update", GroupStateTimeout.NoTimeout)
