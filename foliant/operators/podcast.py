"""Prompts and parses of an episode: outline, segments with rolling context, introduction and end, choice of parts, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import stripped
from foliant.operators.assembly import VOICES

#: Line ends in the sense of a text's lines.
LINES = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOPICS = "TOPICS COVERED:"
PREVIEW = 2000


def preview(content: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def outline_prompts(sections: DataFrame, minutes: Column | None = None, key: str = "doc_id") -> DataFrame:
    """key, prompt of sections (key, section_idx, title, content): the duration wished for (null or 0: none), the number of sections, and
    a numbered preview of each."""
    s = sections.select(key, "section_idx", F.concat("title", F.lit("\n"), preview(F.col("content")), F.lit("\n")).alias("s"), (F.lit(None).cast("long") if minutes is None else minutes).alias("minutes"))
    g = s.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section_idx", "s"))).alias("all"), F.max("minutes").alias("minutes"))
    hint = F.when(F.coalesce("minutes", F.lit(0)) != 0, F.concat(F.lit("Target duration: "), F.col("minutes").cast("string"), F.lit(" minutes\n"))).otherwise("Duration: cover all sections thoroughly — no fixed time limit.\n")
    parts = F.array_join(F.transform("all", lambda x, i: F.concat(F.lit("SECTION "), (i + 1).cast("string"), F.lit(": "), x["s"])), "\n")
    return g.select(key, F.concat(hint, F.lit("Number of source sections: "), F.size("all").cast("string"), F.lit("\n\n"), parts).alias("prompt"))


def outline_title(raw: Column) -> Column:
    """What follows the first colon of the first line that begins with "title:", in letters of either case; empty if there is none."""
    line = F.get(F.filter(F.split(raw, LINES, -1), lambda x: F.lower(stripped(x)).startswith("title:")), F.lit(0))
    return F.coalesce(stripped(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)), F.lit(""))


def summary_of(raw: Column) -> Column:
    return stripped(F.substring_index(raw, TOPICS, 1))


def topics_after(previous: Column, raw: Column) -> Column:
    """previous and the topics that raw lists after its mark, without bullets, each new one once."""
    after = F.get(F.split(raw, TOPICS, 2), F.lit(1))
    lines = F.transform(F.split(after, LINES, -1), lambda x: stripped(F.ltrim(stripped(x), F.lit("-•*"))))
    new = F.filter(F.array_distinct(lines), lambda x: (x != "") & ~F.array_contains(previous, x))
    return F.when(F.contains(raw, F.lit(TOPICS)), F.concat(previous, new)).otherwise(previous)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """template with {name} replaced by each value."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


def segment_prompt(outline: Column, number: Column, title: Column, summary: Column, topics: Column, content: Column) -> Column:
    """Prompt of a segment (number from 0): outline and title, the summary and topics so far where there are any, and the source."""
    heads = [F.concat(F.lit("PODCAST OUTLINE (for reference):\n"), outline, F.lit("\n")), F.concat(F.lit("CURRENT SEGMENT: "), (number + 1).cast("string"), F.lit(" — "), title, F.lit("\n"))]
    so_far = F.when(summary != "", F.concat(F.lit("CONVERSATION SO FAR (summary):\n"), summary, F.lit("\n")))
    listed = F.array_join(F.transform(topics, lambda t: F.concat(F.lit("- "), t)), "\n")
    covered = F.when(F.size(topics) > 0, F.concat(F.lit("TOPICS ALREADY COVERED (do NOT repeat):\n"), listed, F.lit("\n")))
    return F.concat_ws("\n", *heads, so_far, covered, F.concat(F.lit("SOURCE MATERIAL FOR THIS SEGMENT:\n"), content))


def outlined_prompts(segments: DataFrame, outlines: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments (key, section_idx, title, content, summary, covered_topics, ...) with the prompt of each, into which its document's outline
    (key, outline; one row a document, none: empty) is joined. The outline stands once a document and meets its segments by the key, so
    Spark sends the smaller side around where it is small, and deals both where it isn't."""
    of = outlines.select(F.col(key).alias("__key"), F.col("outline").alias("__outline"))
    s = segments.join(of, F.col(key).eqNullSafe(F.col("__key")), "left")
    number = F.row_number().over(Window.partitionBy(key).orderBy("section_idx")) - 1
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    topics = F.coalesce("covered_topics", F.array().cast("array<string>"))
    return s.select(*segments.columns, segment_prompt(some("__outline"), number, some("title"), some("summary"), topics, some("content")).alias("prompt"))


def frame_values(title: Column, topics: Column, speaker_1: Column, speaker_2: Column) -> dict[str, Column]:
    """What introduction and end are filled with: an untitled episode says so, and ten topics are named at most."""
    return {"speaker1": speaker_1, "speaker2": speaker_2, "title": F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Episode")), "topics": F.array_join(F.slice(topics, 1, 10), ", ")}


def in_order(intro: DataFrame, segments: DataFrame, outro: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, idx, label, dialogue: introduction, segments (key, section_idx, dialogue) and end, numbered from 0."""
    n = segments.groupBy(key).agg(F.count("*").alias("n"))
    rows = intro.select(key, F.lit(0).cast("long").alias("idx"), F.lit("intro").alias("label"), "dialogue")
    rows = rows.unionByName(segments.select(key, (F.col("section_idx") + 1).cast("long").alias("idx"), F.lit("segment").alias("label"), "dialogue"))
    last = outro.join(n, key, "left").select(key, (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("idx"), F.lit("outro").alias("label"), "dialogue")
    return rows.unionByName(last)


def selected(choices: DataFrame, value: str = "value", total: str = "total") -> DataFrame:
    """choices with idx, a row for each part chosen: "intro" is 0, "outro" the last, a-b all from a to b, a number itself, several parted
    by commas; what lies outside 0 to total - 1 is left out, as are ranges that run backwards. Anything else is an error."""
    n = F.col(total).cast("long")

    def number(part: Column, x: Column) -> Column:
        return F.when(x.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(x, F.lit("_"), F.lit("")).cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a part: "), part)).cast("long"))

    def of(raw: Column) -> Column:
        part = F.lower(stripped(raw))
        lo, hi = stripped(F.regexp_extract(part, r"^([^-]*)-(.*)$", 1)), stripped(F.regexp_extract(part, r"^([^-]*)-(.*)$", 2))
        end = lambda x: F.when(part == "intro", 0).when(part == "outro", n - 1).when(part.contains("-"), number(part, x)).otherwise(number(part, part))
        a, b = F.greatest(end(lo), F.lit(0)), F.least(end(hi), n - 1)
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    every = F.array_distinct(F.flatten(F.transform(F.split(value, ","), of)))
    return choices.withColumn("idx", F.explode(every))


def mismatched(voices: Column, lang: Column, presets: dict[str, tuple[str, ...]] = VOICES) -> Column:
    """The voices that don't belong to the language by their first letter (English takes a and b); none for a language without presets."""
    letters = {k: sorted({v[0] for v in vs}) for k, vs in presets.items()} | {"en": ["a", "b"]}
    allowed = F.element_at(F.create_map(*[x for k, v in letters.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lang)
    return F.when(allowed.isNull(), F.array().cast("array<string>")).otherwise(F.filter(voices, lambda v: ~F.array_contains(allowed, F.substring(v, 1, 1))))


def speakers(voices: Column, speed: Column, speeds: Column) -> dict[str, Column]:
    """Voice, speed and language letter of both speakers; fewer than two voices are an error, and speeds of their own go before the common one."""
    two = F.when(F.size(voices) >= 2, voices).otherwise(F.raise_error(F.lit("two voices are needed")).cast("array<string>"))
    own = F.coalesce(speeds, F.array(speed, speed))
    return {"voice_s1": two[0], "voice_s2": two[1], "speed_s1": own[0], "speed_s2": own[1], "lang_code": F.substring(two[0], 1, 1)}


def references(prompts: Column) -> dict[str, Column]:
    """Recordings that the speakers' voices are cloned from: two, one for both, or none."""
    first = F.get(prompts, F.lit(0))
    return {"ref_s1": first, "ref_s2": F.coalesce(F.get(prompts, F.lit(1)), first)}
