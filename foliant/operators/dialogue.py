"""Dialogue: turns, silence timeline, balance, and the rolling summary of segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import stripped, word_count

SAMPLE_RATE = 24_000
# Samples of each pause and of the gap after a spoken turn.
PAUSES = {"[PAUSE_SHORT]": 12_000, "[PAUSE_MEDIUM]": 28_800, "[PAUSE_LONG]": 48_000}
GAP = 7_200
MARKS = r"\[PAUSE_(?:SHORT|MEDIUM|LONG)\]"
TAGS = r"\[S[12]\]|" + MARKS


def pieces(text: Column, marks: str) -> Column:
    """The marks in a text and what stands between them, in order. Divided at the places before and after a mark, so that texts of any
    length are gone through in one loop."""
    return F.split(text, rf"(?={marks})|(?<={marks})", -1)


def turns(scripts: DataFrame, key: str = "doc_id", text: str = "dialogue") -> DataFrame:
    """key, turn_idx, tag (S1, S2, PAUSE), text: speaker tags set the speaker (S1 at first), blank pieces are dropped."""
    t = scripts.select(key, F.posexplode(pieces(F.col(text), TAGS)).alias("i", "t"))
    w = Window.partitionBy(key).orderBy("i")
    speaker = F.when(F.col("t") == "[S1]", "S1").when(F.col("t") == "[S2]", "S2")
    t = t.withColumn("speaker", F.coalesce(F.last(speaker, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("S1")))
    t = t.where(~F.col("t").isin("[S1]", "[S2]")).withColumn("t", stripped(F.col("t"))).where("t <> ''")
    pause = F.col("t").isin(*PAUSES)
    return t.select(key, (F.row_number().over(w) - 1).cast("long").alias("turn_idx"), F.when(pause, "PAUSE").otherwise(F.col("speaker")).alias("tag"), F.col("t").alias("text"))


def narration_parts(narrations: DataFrame, key: str = "doc_id", text: str = "narration") -> DataFrame:
    """key, part_idx, kind (pause or text), text of a narration: pauses and what is read between them, blank pieces dropped."""
    t = narrations.select(key, F.posexplode(pieces(F.col(text), MARKS)).alias("i", "t")).withColumn("t", stripped(F.col("t"))).where("t <> ''")
    idx = F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1
    return t.select(key, idx.cast("long").alias("part_idx"), F.when(F.col("t").isin(*PAUSES), "pause").otherwise("text").alias("kind"), F.col("t").alias("text"))


def timeline(t: DataFrame, key: str = "doc_id", words_per_minute: int = 150) -> DataFrame:
    """t (key, turn_idx, tag, text) with samples and the offset at which each begins; spoken time is estimated from words, and a gap
    follows every spoken turn."""
    n = F.coalesce(*[F.when(F.col("text") == k, v) for k, v in PAUSES.items()], (word_count(F.col("text")) * (SAMPLE_RATE * 60) / words_per_minute).cast("long") + GAP).cast("long")
    w = Window.partitionBy(key).orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("samples", n).withColumn("offset", F.coalesce(F.sum("samples").over(w), F.lit(0)).cast("long"))


def rolled(segments: DataFrame) -> DataFrame:
    """segments (doc_id, section_idx, title, content) with dialogue, summary and covered topics: each document's segments in order, every
    one seeing what the ones before covered. The model is a deterministic stub. Ids of any type; null titles and contents are empty."""
    kind = segments.schema["doc_id"].dataType.simpleString()

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        summary, topics, rows = "", [], []
        for r in b.sort_values("section_idx").itertuples():
            head = [x for x in str(r.title).split() if x][:4]
            dialogue = f"[S1] About {' '.join(head)}. [S2] {len(str(r.content).split())} words, after {len(topics)} topics."
            topics = list(dict.fromkeys([*topics, *head]))
            summary = (summary + " " + " ".join(head)).strip()
            rows.append((r.doc_id, r.section_idx, dialogue, summary, list(topics)))
        return pd.DataFrame(rows, columns=["doc_id", "section_idx", "dialogue", "summary", "covered_topics"])

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return segments.select("doc_id", "section_idx", text("title"), text("content")).groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, section_idx long, dialogue string, summary string, covered_topics array<string>")
