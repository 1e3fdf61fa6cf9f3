"""Dialogue with a language model, segment after segment, for all documents at once.

A segment's prompt needs the summary and topics of those before it, so the k-th segments of all documents make a round: one job asks for
all of them in batches. Each round's dialogue and state are written to a folder of their own; a run that stops goes on after the last
round that was finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import stripped
from foliant.operators.models import Model, generated
from foliant.operators.podcast import TOPICS, filled, segment_prompt, summary_of, topics_after
from foliant.prompts import DIALOGUES, prompt

# Fixed texts: what stands for a summary before the first segment, and the summariser's instruction.
NO_SUMMARY = "(No previous summary — this is the first segment.)"
SUMMARISER = "You keep the running summary of a podcast, short and exact."


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a job has written the folder to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dialogue_rounds(segments: DataFrame, folder: str, make: Callable[[], Model], outlines: DataFrame | None = None, style: str = "two_hosts", speakers: tuple[str, str] = ("Alex", "Sam"), words: int = 1200, per_minute: int = 150, source: str = "en", target: str = "en", key: str = "doc_id") -> DataFrame:
    """segments (key, section_idx, title, content) with dialogue, summary and covered_topics, the last two after each segment. outlines
    (key, outline, one row a document) is joined into each prompt. A null title, content or outline is empty; ids may be of any type, null
    ones included; sections of equal section_idx go by title and content. folder is shared storage of this one run: rounds that are
    finished there aren't asked for again. There are as many rounds as the longest document has segments, and a round moves only the
    documents that still have one."""
    spark, idx = segments.sparkSession, segments.schema["section_idx"].dataType
    if not finished(spark, f"{folder}/segments"):
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        s = segments.select(key, "section_idx", text("title"), text("content"))
        if outlines is not None:
            of = outlines.select(F.col(key).alias("__key"), text("outline"))
            s = s.join(of, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        else:
            s = s.withColumn("outline", F.lit(None).cast("string"))
        k = F.row_number().over(Window.partitionBy(key).orderBy("section_idx", "title", "content")) - 1
        s.withColumn("outline", F.coalesce("outline", F.lit(""))).withColumn("k", k).write.mode("overwrite").partitionBy("k").parquet(f"{folder}/segments")
    parts = spark.read.schema(f"`{key}` {segments.schema[key].dataType.simpleString()}, section_idx {idx.simpleString()}, title string, content string, outline string, k int").parquet(f"{folder}/segments")
    last = parts.agg(F.max("k")).first()[0]
    system, language = map(F.lit, dialogue_system(style, speakers, words, per_minute, source, target))
    state, done = None, []
    for k in range(0 if last is None else last + 1):
        path = f"{folder}/round={k}"
        if not finished(spark, path):
            now = parts.where(F.col("k") == k)
            if state is None:
                now = now.withColumns({"summary": F.lit(""), "covered_topics": F.array().cast("array<string>")})
            else:
                before = state.select(F.col(key).alias("__key"), "summary", "covered_topics")
                now = now.join(before, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
            now = now.withColumn("system", system).withColumn("prompt", segment_prompt(F.col("outline"), F.col("k"), F.col("title"), F.col("summary"), F.col("covered_topics"), F.col("content")))
            now = generated(now, make).withColumnRenamed("answer", "dialogue")
            so_far = F.when(F.col("summary") == "", NO_SUMMARY).otherwise(F.col("summary"))
            asked = filled(F.lit(prompt("summary")), {"previous_summary": so_far, "new_dialogue": F.col("dialogue")})
            now = generated(now.withColumn("system", F.concat(F.lit(SUMMARISER), language)).withColumn("prompt", asked), make)
            now = now.select(key, "section_idx", "dialogue", summary_of(F.col("answer")).alias("summary"), topics_after(F.col("covered_topics"), F.col("answer")).alias("covered_topics"))
            now.write.mode("overwrite").parquet(path)
        state = spark.read.schema(f"`{key}` {segments.schema[key].dataType.simpleString()}, section_idx {idx.simpleString()}, dialogue string, summary string, covered_topics array<string>").parquet(path)
        done.append(path)
    if state is None:
        return segments.select(key, "section_idx", F.lit("").alias("dialogue"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("covered_topics")).limit(0)
    return spark.read.schema(state.schema).parquet(*done)


def dialogue_system(style: str, speakers: tuple[str, str], words: int, per_minute: int, source: str, target: str) -> tuple[str, str]:
    """The instruction of a dialogue, and what every instruction ends with (the languages, where they aren't both English)."""
    of = f" The source is in {source}. "
    language = "" if source == target == "en" else of + (f"Write in {target}." if source == target else f"Translate and write in {target}.")
    values = {"speaker1": speakers[0], "speaker2": speakers[1], "target_words": words, "target_minutes": words // per_minute}
    text = prompt(DIALOGUES[style])
    for k, v in values.items():
        text = text.replace("{" + k + "}", str(v))
    return text + language, language


def next_segment(model: Model, system: str, language: str, number: int, title: str, content: str, outline: str, summary: str, topics: list[str]) -> tuple[str, str, list[str]]:
    """One segment (number from 0) outside of a round, as a stream asks for it: its dialogue, and the summary and topics after it."""
    heads = [f"PODCAST OUTLINE (for reference):\n{outline}\n", f"CURRENT SEGMENT: {number + 1} — {title}\n"]
    if summary:
        heads.append(f"CONVERSATION SO FAR (summary):\n{summary}\n")
    if topics:
        heads.append("TOPICS ALREADY COVERED (do NOT repeat):\n" + "\n".join(f"- {t}" for t in topics) + "\n")
    dialogue = model(system, "\n".join([*heads, f"SOURCE MATERIAL FOR THIS SEGMENT:\n{content}"]))
    asked = prompt("summary").replace("{previous_summary}", summary or NO_SUMMARY).replace("{new_dialogue}", dialogue)
    before, mark, after = model(SUMMARISER + language, asked).partition(TOPICS)
    named = [line.strip().lstrip("-•*").strip() for line in after.splitlines()] if mark else []
    return dialogue, before.strip(), list(dict.fromkeys([*topics, *filter(None, named)]))


def stub_speaker() -> Model:
    """Stands in for a language model: says what the segment is called, how long it is and how many topics came before; sums up by the
    first words of titles. Deterministic."""

    def answer(system: str, text: str) -> str:
        if system.startswith(SUMMARISER):
            before, _, dialogue = text.partition("New dialogue:\n")
            before = before.rpartition("Summary so far:\n")[2].strip()
            head = dialogue.removeprefix("[S1] About ").partition(". [S2] ")[0].split()
            told = " ".join([*([] if before == NO_SUMMARY else [before]), *head])
            return told + "\nTOPICS COVERED:\n" + "\n".join(f"- {x}" for x in head)
        lead, _, content = text.partition("SOURCE MATERIAL FOR THIS SEGMENT:\n")
        title = lead.partition("CURRENT SEGMENT: ")[2].partition("\n")[0].partition(" — ")[2]
        topics = lead.partition("TOPICS ALREADY COVERED (do NOT repeat):\n")[2].count("\n- ") + ("TOPICS ALREADY COVERED" in lead)
        return f"[S1] About {' '.join(title.split()[:4])}. [S2] {len(content.split())} words, after {topics} topics."

    return answer


def states_by_file(rows: DataFrame) -> DataFrame:
    """rows of dialogue_rounds with the names and bodies of a segment's two files: its dialogue, and its state as JSON."""
    number = F.lpad((F.col("section_idx") + 1).cast("string"), 2, "0")
    return rows.select("*", F.concat(number, F.lit("_state.json")).alias("state_file"), F.to_json(F.struct(F.col("summary").alias("rolling_summary"), "covered_topics")).alias("state"), stripped(F.col("dialogue")).alias("body"))
