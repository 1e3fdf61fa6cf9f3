"""Narration with a language model in batches: only the blocks that rules can't speak are asked for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import heading_transition, language_instruction, spoken_paragraph, stripped, verdict, without_markdown
from foliant.operators.blocks import blocks
from foliant.operators.models import Model, generated
from foliant.prompts import BLOCKS, prompt

#: Kinds of blocks that a model puts into words.
ASKED = ("table", "code", "list", "metadata")


@F.pandas_udf(T.StringType())
def _by_rule(kind: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([spoken_paragraph(c) if k == "paragraph" else without_markdown(c) if k == "heading" else None for k, c in zip(kind, content, strict=True)], dtype=object)


def instructions(kind: Column, source: str, target: str) -> Column:
    """The system text for each kind of block (and for "translate"), with the languages where they differ."""
    found = F.element_at(F.create_map(*[x for k, name in BLOCKS.items() for x in (F.lit(k), F.lit(prompt(name)))]), kind)
    return F.concat(found, language_instruction(F.lit(source), F.lit(target)))


def spoken_blocks(rows: DataFrame, make: Callable[[], Model], source: str = "en", target: str = "en") -> DataFrame:
    """rows (..., kind, content, level) of blocks with text (null or empty: nothing is read) and calls. Headings and paragraphs go by rule;
    tables, code, lists and metadata are asked for, each with its own instruction. Into another language, headings and paragraphs are
    asked for too, once they are spoken text. The model is made once per task (and once more for translations), and only where a row needs it."""
    kept = rows.columns
    asked = F.col("kind").isin(*ASKED)
    out = generated(rows.withColumn("system", F.when(asked, instructions(F.col("kind"), source, target))).withColumn("prompt", F.when(asked, F.col("content"))), make)
    plain = _by_rule("kind", "content")
    rule = F.when(F.col("kind") == "heading", heading_transition(F.col("__plain"), F.col("level"))).otherwise(F.col("__plain"))
    text = F.when(F.col("kind") == "metadata", F.coalesce(verdict(F.col("answer")), F.lit(""))).when(asked, stripped(F.col("answer"))).otherwise(rule)
    out = out.withColumn("__plain", plain).select(*kept, text.alias("text"), asked.cast("int").alias("calls"))
    if source == target:
        return out
    again = generated(out.withColumn("system", instructions(F.lit("translate"), source, target)).withColumn("prompt", F.when(F.col("calls") == 0, F.col("text"))), make)
    return again.select(*kept, F.coalesce("answer", "text").alias("text"), F.lit(1).alias("calls"))


def joined_parts(parts: Column) -> Column:
    """Parts (array of texts) with a short pause between them, but none after a part that ends in a bracket."""
    n = F.size(parts)
    ended = lambda x, i: F.when(i == n - 1, "").when(stripped(x).endswith("]"), "\n\n").otherwise("\n\n[PAUSE_SHORT]\n\n")
    return F.array_join(F.transform(parts, lambda x, i: F.concat(x, ended(x, i))), "")


def narrated_with(docs: DataFrame, make: Callable[[], Model], source: str = "en", target: str = "en") -> DataFrame:
    """doc_id, narration, llm_calls, n_blocks of every row of docs (doc_id, text), as blocks.narrated gives them: blocks become rows, those
    that need a model are asked for in batches, and each row's parts meet again in order. Null and empty texts have no blocks and an empty
    narration; rows that share an id stay apart. One exchange, of the spoken parts."""
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text")
    rows = blocks(numbered.select(F.struct("__row", "doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    spoken = spoken_blocks(rows, make, source, target).select("doc_id.*", "block_idx", "text", "calls")
    none = numbered.where("coalesce(text, '') = ''").select("__row", "doc_id", F.lit(None).cast("int").alias("block_idx"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("calls"))
    part = F.when(F.col("text") != "", F.struct("block_idx", "text"))
    out = spoken.unionByName(none).groupBy("__row", "doc_id").agg(F.sort_array(F.collect_list(part))["text"].alias("parts"), F.sum("calls").cast("int").alias("llm_calls"), F.count("block_idx").cast("int").alias("n_blocks"))
    return out.select("doc_id", joined_parts(F.col("parts")).alias("narration"), "llm_calls", "n_blocks")
