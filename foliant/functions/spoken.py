"""Spoken text in the JVM: what functions.text.spoken_paragraph says, as steps of columns.

Each step divides a text into the matches of a pattern and the gaps between them, puts into words what it has matched, and joins all
again. Steps stand in columns of their own, so that no expression is repeated inside the next. Digits are ASCII digits here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import ABBREVIATIONS, ONES, ORDINALS, UNITS, int_words, stripped

#: What is taken out of markdown, in this order, in Java's notation (see text.MARKDOWN): what a text must hold, pattern, what stays.
MARKDOWN = (
    (("![",), r"!\[[^\]]*\]\([^)]*\)", ""),
    (("](",), r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (("**", "__"), r"(?d)\*\*(.+?)\*\*|__(.+?)__", "$1$2"),
    (("*", "_"), r"(?Ud)(?<!\w)\*(.+?)\*(?!\w)|(?<!\w)_(.+?)_(?!\w)", "$1$2"),
    (("`",), r"`([^`]+)`", "$1"),
    (("~~",), r"(?d)~~(.+?)~~", "$1"),
    (("[^",), r"\[\^[^\]]+\]", ""),
    (("--", "**", "__", "-*", "-_", "*-", "*_", "_-", "_*"), r"(?mUd)^\s*[-*_]{3,}\s*$", ""),
    (("  ",), " {2,}", " "),
    (("\n\n\n",), "\n{3,}", "\n\n"),
)
ABBREVIATED = "|".join("\\Q" + k + "\\E" for k in sorted(ABBREVIATIONS, key=len, reverse=True))
#: Every abbreviation holds one of these.
SHORT = ("tok/s", "RAG", "LLM", "GPU", "CPU", "API", "SQL", "URL", "AI", "e.g.", "i.e.", "et al.", "etc.", "vs.", "ig.")
ENUMERATED = r"(?U)(?<=\s)\(?([0-9]+)\)|(?<=\s)\(([a-j])\)"
WORD = r"(?U)"
PERCENT, SUFFIX, COMMAS = WORD + r"\b([0-9]+(?:\.[0-9]+)?)\s*%", WORD + r"\b([0-9]+(?:\.[0-9]+)?)\s*([KkMmBbTt])\b", WORD + r"\b[0-9]{1,3}(?:,[0-9]{3})+\b"
DECIMAL, PLAIN = WORD + r"\b([0-9]+)\.([0-9]+)\b", WORD + r"\b[0-9]{1,6}\b"


def holds(t: Column, some: tuple[str, ...]) -> Column:
    return reduce(or_, (t.contains(x) for x in some))


def rebuilt(t: Column, pattern: str, groups: tuple[int, ...], say: Callable[..., Column]) -> Column:
    """t with each match of pattern replaced by say(whole, group, ...)."""
    gaps = F.split(t, pattern, -1)
    found = [F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    said = F.transform(found[0], lambda m, i: F.concat(say(m, *(F.get(g, i) for g in found[1:])), F.get(gaps, i + 1)))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(said, ""))


def number_words(digits: Column) -> Column:
    """Words of a number of any length, given as digits: groups of six, each million of millions said as such."""
    n = F.length(digits)
    padded = F.lpad(digits, (n + 5 - (n + 5) % 6).cast("int"), "0")
    six = F.regexp_extract_all(padded, F.lit("[0-9]{6}"), F.lit(0))

    def step(said: Column, group: Column) -> Column:
        own = F.when(group == "000000", "").otherwise(int_words(group))
        return F.when(said == "", own).otherwise(F.concat(said, F.lit(" million"), F.when(own == "", "").otherwise(F.concat(F.lit(" "), own))))

    return F.aggregate(six, F.lit(""), step, lambda x: F.when(x == "", "zero").otherwise(x))


def digit_words(digits: Column) -> Column:
    """Digits one by one; a zero is silent, but keeps its space."""
    ones = F.array(F.lit(""), *map(F.lit, ONES[1:]))
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda d: F.get(ones, d.cast("int"))), " ")


def is_year(digits: Column) -> Column:
    n = F.regexp_replace(digits, "^0+", "")
    return (F.length(n) == 4) & n.between("1800", "2099")


def _percent(m: Column, number: Column) -> Column:
    x = number.cast("double")
    n = F.rint(x)
    return F.concat(F.when(F.abs(x - n) > 0.4, "roughly ").otherwise(""), number_words(n.cast("decimal(38,0)").cast("string")), F.lit(" percent"))


def _suffixed(m: Column, number: Column, unit: Column) -> Column:
    part = F.replace(F.regexp_extract(number, r"\.([0-9]+)$", 1), F.lit("0"), F.lit(""))
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.concat(number_words(F.regexp_extract(number, "^[0-9]+", 0)), F.when(part == "", " ").otherwise(F.concat(F.lit(" point "), digit_words(part), F.lit(" "))), F.element_at(units, F.lower(unit)))


def _ordinal(m: Column, number: Column, letter: Column) -> Column:
    words = F.array(*map(F.lit, ORDINALS))
    digits = F.regexp_replace(number, "^0+", "")
    n = F.when(letter != "", F.ascii(letter) - 96).when(F.length(digits).between(1, 2), digits.cast("int"))
    return F.when(n.between(1, 10), F.concat(F.get(words, n - 1), F.lit(","))).otherwise(m)


def _plain(m: Column) -> Column:
    return F.when(is_year(m), m).otherwise(number_words(m))


def _decimal(m: Column, whole: Column, part: Column) -> Column:
    return F.when(is_year(whole), m).otherwise(F.concat(number_words(whole), F.lit(" point "), digit_words(part)))


#: Each form with what a text must have for it: cheap to look for, so most texts pass most steps untouched.
FORMS = (
    (lambda t: holds(t, SHORT), ABBREVIATED, (), lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), m)),
    (lambda t: t.contains(")"), ENUMERATED, (1, 2), _ordinal),
    (lambda t: t.contains("%"), PERCENT, (1,), _percent),
    (lambda t: t.rlike(r"[0-9]\W*[KkMmBbTt]"), SUFFIX, (1, 2), _suffixed),
    (lambda t: t.rlike("[0-9],[0-9]"), COMMAS, (), lambda m: number_words(F.replace(m, F.lit(","), F.lit("")))),
    (lambda t: t.rlike(r"[0-9]\.[0-9]"), DECIMAL, (1, 2), _decimal),
    (lambda t: t.rlike("[0-9]"), PLAIN, (), _plain),
)


def spoken_column(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the column as it is spoken: without markdown, with abbreviations, enumerations and numbers in words. Null stays null. One
    projection after the other in the JVM: no Python, no shuffle."""
    c = F.col(f"`{text}`")
    for some, pattern, to in MARKDOWN:
        df = df.withColumn(text, F.when(holds(c, some), F.regexp_replace(c, pattern, to)).otherwise(c))
    df = df.withColumn(text, stripped(c))
    for needed, pattern, groups, say in FORMS:
        df = df.withColumn(text, F.when(needed(c), rebuilt(c, pattern, groups, say)).otherwise(c))
    return df
