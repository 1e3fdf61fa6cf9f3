"""Assembly of rendered sections, the choice of a final file, voices, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import word_count
from foliant.operators.dialogue import SAMPLE_RATE

# Silence between sections, in samples, and the names of final files, first choice first.
BETWEEN = {"audiobook": 48_000, "podcast": 36_000}
FINAL = ("audiobook.wav", "podcast.wav", "podcast_partial.wav")
SLOWER = 1.08
# Voices by language.
VOICES = {
    "en": ("af_heart", "am_michael"),
    "fr": ("ff_siwis",),
    "es": ("ef_dora", "em_alex"),
    "hi": ("hf_alpha", "hm_omega"),
    "it": ("if_sara", "im_nicola"),
    "ja": ("jf_alpha", "jm_kumo"),
    "pt": ("pf_dora", "pm_alex"),
    "zh": ("zf_xiaobei", "zm_yunjian"),
}


def assembled(sections: DataFrame, key: str, order: str, kind: str = "audiobook") -> DataFrame:
    """sections (key, order, samples) with `begins`, the sample at which each begins: silence lies between sections, none after the last."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("begins", F.coalesce(F.sum(F.col("samples") + BETWEEN[kind]).over(w), F.lit(0)).cast("long"))


def lengths(sections: DataFrame, key: str, kind: str = "audiobook") -> DataFrame:
    """Per key: n_sections, total samples with the silence between them, and whole seconds."""
    total = F.sum("samples") + (F.count("*") - 1) * BETWEEN[kind]
    t = sections.groupBy(key).agg(F.count("*").alias("n_sections"), total.cast("long").alias("samples"))
    return t.withColumn("seconds", F.floor(F.col("samples") / SAMPLE_RATE).cast("long"))


def final_file(files: DataFrame, key: str, name: str = "name") -> DataFrame:
    """The first of the final names that each key has; null where it has none."""
    rank = F.array_position(F.array(*map(F.lit, FINAL)), F.col(name))
    best = F.min(F.when(rank > 0, rank))
    return files.groupBy(key).agg(F.get(F.array(*map(F.lit, FINAL)), (best - 1).cast("int")).alias("final_name"))


def voices(lang: Column, speed: Column, presets: dict[str, tuple[str, ...]] = VOICES) -> dict[str, Column]:
    """Two voices and speeds of a language (null: English). One voice serves for both, the second time a little faster. A language
    without a preset is an error."""
    known = F.create_map(*[x for k, v in presets.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    lang = F.coalesce(lang, F.lit("en"))
    found = F.element_at(known, lang)
    found = F.coalesce(found, F.raise_error(F.concat(F.lit("no voice preset for "), lang)).cast("array<string>"))
    one = F.size(found) == 1
    return {"voice_1": found[0], "voice_2": F.when(one, found[0]).otherwise(F.get(found, F.lit(1))), "speed_1": speed, "speed_2": F.when(one, speed * SLOWER).otherwise(speed)}


def language_of(voice: Column, presets: dict[str, tuple[str, ...]] = VOICES) -> Column:
    """The first language whose first voice begins with the letter of this one; null if none does."""
    return F.coalesce(*[F.when(F.substring(voice, 1, 1) == v[0][0], k) for k, v in presets.items()], F.lit(None))


def compared(runs: DataFrame, key: str, run: str, text: str, seconds: str) -> DataFrame:
    """Per key, side by side for runs A and B: words, pauses, words a second (null for no time), speaker balance (null if nobody
    speaks)."""
    said = lambda s: F.aggregate(F.regexp_extract_all(text, F.lit(rf"(?s)\[{s}\](.*?)(?=\[S[12]\]|\z)"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + word_count(x))
    t = runs.select(key, run, word_count(F.col(text)).alias("words"), F.regexp_count(text, F.lit(r"\[PAUSE")).cast("long").alias("pauses"), F.col(seconds).cast("double").alias("time"), said("S1").alias("s1"), said("S2").alias("s2"))
    t = t.withColumn("rate", F.try_divide("words", "time")).withColumn("balance", F.try_divide(F.least("s1", "s2").cast("double"), F.greatest("s1", "s2")))
    pick = lambda r, c: F.max(F.when(F.col(run) == r, F.col(c))).alias(f"{c}_{r.lower()}")
    return t.groupBy(key).agg(*[pick(r, c) for c in ("words", "pauses", "rate", "balance") for r in ("A", "B")])


def residue(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per keys: texts, and what shouldn't be left in texts that are read aloud: line breaks, bold marks, addresses of pages."""
    n = lambda p, name: F.sum(F.regexp_count(text, F.lit(p))).alias(name)
    return texts.groupBy(*keys).agg(F.count("*").alias("docs"), n(r"\n", "breaks"), n(r"\*\*", "bold"), n("https?://", "urls"))


def paired(sections: DataFrame, narrations: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with their narrations by place; what has no counterpart is left out."""
    return sections.join(narrations, keys)
