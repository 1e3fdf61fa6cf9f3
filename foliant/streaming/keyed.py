"""Streams with state by key: rolling dialogue, what a job shows, and lines out of chunks with their progress. All need the RocksDB state
store (rocksdb() sets it). Rows that come again or too late are passed over; state goes when it is no longer needed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.models import Model
from foliant.operators.rounds import dialogue_system, next_segment
from foliant.streaming.jobs import progress

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class RollingDialogue(StatefulProcessor):
    """Asks for the segments of a document in the order of their numbers. One that comes before its turn waits in the state."""

    def __init__(self, key: str, make: Callable[[], Model], system: str, suffix: str, idle_ms: int | None):
        self.key, self.make, self.system, self.suffix, self.idle_ms = key, make, system, suffix, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.model = handle, None
        self.at = handle.getValueState("at", "number long, summary string, topics string")
        self.waiting = handle.getMapState("waiting", "number long", "title string, content string, outline string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        number, summary, topics = self.at.get() if self.at.exists() else (0, "", "[]")
        topics, out = json.loads(topics), []
        come: dict[int, tuple] = {}
        for b in rows:
            for i, *segment in zip(b["section_idx"], *(b[c].where(b[c].notna(), "") for c in ("title", "content", "outline")), strict=True):
                if i >= number:
                    come.setdefault(int(i), tuple(segment))
        while True:
            if self.waiting.containsKey((number,)):
                segment = self.waiting.getValue((number,))
                self.waiting.removeKey((number,))
                come.pop(number, None)
            elif number in come:
                segment = come.pop(number)
            else:
                break
            self.model = self.model or self.make()
            dialogue, summary, topics = next_segment(self.model, self.system, self.suffix, number, *segment, summary, topics)
            out.append((key[0], number, dialogue, summary, topics))
            number += 1
        for i, segment in come.items():
            if not self.waiting.containsKey((i,)):
                self.waiting.updateValue((i,), segment)
        self.at.update((number, summary, json.dumps(topics)))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[self.key, "section_idx", "dialogue", "summary", "covered_topics"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.at.clear()
        self.waiting.clear()
        yield pd.DataFrame([], columns=[self.key, "section_idx", "dialogue", "summary", "covered_topics"])

    def close(self) -> None:
        pass


def streamed_dialogue(segments: DataFrame, make: Callable[[], Model], style: str = "two_hosts", speakers: tuple[str, str] = ("Alex", "Sam"), words: int = 1200, per_minute: int = 150, source: str = "en", target: str = "en", idle_ms: int | None = None, key: str = "doc_id") -> DataFrame:
    """dialogue_rounds() of a stream of segments (key, section_idx from 0 without gaps, title, content, and outline where there is one):
    key, section_idx, dialogue, summary, covered_topics of each segment as soon as all before it have come. The k-th segment that comes
    early waits; one that comes again is passed over. idle_ms: a document without new segments for so long is forgotten (never, if None)."""
    system, suffix = dialogue_system(style, speakers, words, per_minute, source, target)
    s = segments if "outline" in segments.columns else segments.withColumn("outline", F.lit(""))
    s = s.select(key, F.col("section_idx").cast("long").alias("section_idx"), "title", "content", "outline")
    kinds = f"`{key}` {_kind(segments, key)}, section_idx long, dialogue string, summary string, covered_topics array<string>"
    return s.groupBy(key).transformWithStateInPandas(RollingDialogue(key, make, system, suffix, idle_ms), kinds, "append", "none" if idle_ms is None else "processingTime")


SHOWN = ["job_id", "seq", "n_logs", "stages", "current_stage", "section", "of_sections", "section_title"]


class Shown(StatefulProcessor):
    """What a job shows: a value for what is current, a map of its stages by number."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "seq long, n_logs long, current_stage int, section int, of_sections int, title string")
        self.stages = handle.getMapState("stages", "number int", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, logs, stage, *section = self.now.get() if self.now.exists() else (-1, 0, None, None, None, None)
        b = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in b[b["seq"] > last].drop_duplicates("seq").itertuples():
            last, number = int(e.seq), None if pd.isna(e.number) else int(e.number)
            if e.event_type == "requeue":
                logs, stage, section = 0, None, [None] * 3
                self.stages.clear()
            elif e.event_type == "log":
                logs += 1
            elif e.event_type == "stage":
                stage, section = number, [None] * 3
                if number is not None and not self.stages.containsKey((number,)):
                    self.stages.updateValue((number,), (last,))
            elif e.event_type == "section":
                section = [number, None if pd.isna(e.total) else int(e.total), None if pd.isna(e.title) else e.title]
        self.now.update((last, logs, stage, *section))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        stages = ",".join(str(n) for _, n in sorted((seq[0], n[0]) for n, seq in self.stages.iterator()))
        out = pd.DataFrame([(key[0], last, logs, stages, stage, *section)], columns=SHOWN)
        yield out.astype({c: "Int32" for c in ("current_stage", "section", "of_sections")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.now.clear()
        self.stages.clear()
        yield pd.DataFrame([], columns=SHOWN)

    def close(self) -> None:
        pass


def streamed_runtime(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """runtime_state() of a stream of events (job_id, seq, event_type, number, total, title): what each job shows after each trigger that
    has events of it, with the seq it stands at (a job's row of highest seq is its state). Events of a trigger are taken by seq; one that
    comes after later ones, or again, is passed over. A requeue clears all, a stage the section. idle_ms: a job without events for so long
    is forgotten (never, if None)."""
    e = events.select("job_id", F.col("seq").cast("long").alias("seq"), "event_type", F.col("number").cast("int").alias("number"), F.col("total").cast("int").alias("total"), F.col("title").cast("string").alias("title"))
    kinds = f"job_id {_kind(events, 'job_id')}, seq long, n_logs long, stages string, current_stage int, section int, of_sections int, section_title string"
    return e.groupBy("job_id").transformWithStateInPandas(Shown(idle_ms), kinds, "append", "none" if idle_ms is None else "processingTime")


LINE = ["job_id", "line_idx", "line", "at"]


class Lines(StatefulProcessor):
    """Whole lines of a job's chunks as they are complete. The open end is kept, and given out once the watermark has passed the job's last
    chunk by the time it may be idle; then the state goes."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, line_idx long, tail string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        seq, n, tail, last = self.open.get() if self.open.exists() else (-1, 0, "", 0)
        b = pd.concat(list(rows)).sort_values("seq", kind="stable")
        b = b[b["seq"] > seq].drop_duplicates("seq")
        if not len(b):
            yield pd.DataFrame([], columns=LINE)
            return
        *lines, tail = (tail + "".join(b["data"].where(b["data"].notna(), ""))).split("\n")
        at = max(b["at"])
        last = max(last, int(at.timestamp() * 1000))
        self.open.update((int(b["seq"].max()), n + len(lines), tail, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame([(key[0], n + i, x, at) for i, x in enumerate(lines)], columns=LINE)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        _, n, tail, last = self.open.get()
        self.open.clear()
        at = pd.Timestamp(max(last, timerValues.getCurrentWatermarkInMs()), unit="ms")
        yield pd.DataFrame([(key[0], n, tail, at)] if tail.strip() else [], columns=LINE)

    def close(self) -> None:
        pass


def timed_lines(chunks: DataFrame, delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """lines_of() of a stream of chunks (job_id, seq, data, at), with the time of the chunk that ended each line (at is a timestamp, and
    stays the stream's event time). A job's last line without an end comes once the job has been idle for idle_ms of event time."""
    c = chunks.withWatermark("at", delay).select("job_id", F.col("seq").cast("long").alias("seq"), "data", "at")
    return c.groupBy("job_id").transformWithStateInPandas(Lines(idle_ms), f"job_id {_kind(chunks, 'job_id')}, line_idx long, line string, at timestamp", "append", "eventTime", eventTimeColumnName="at")


def streamed_progress(chunks: DataFrame, delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """Chunks to lines to progress in one stream with two stateful steps: job_id, line_idx, at and the progress columns of the lines that
    report any, each stage of a job once. The second step forgets a stage when the watermark has passed it, so state stays bounded."""
    p = timed_lines(chunks, delay, idle_ms).select("job_id", "line_idx", "at", *[c.alias(k) for k, c in progress(F.col("line")).items() if k != "output_dir"]).where("event_type is not null")
    once = p.withColumn("__once", F.when(F.col("event_type") == "stage", F.col("number").cast("long")).otherwise(-1 - F.col("line_idx")))
    return once.dropDuplicatesWithinWatermark(["job_id", "__once"]).drop("__once")
