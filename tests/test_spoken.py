"""Spoken text as columns against the plain functions."""

import os
import random

from foliant.functions import spoken
from foliant.functions.spoken import spoken_column
from foliant.functions.text import ABBREVIATIONS, spoken_paragraph

SF = os.environ.get("FOLIANT_SF", "/root/testdata/sf0.001")
FORMS = ["3.05%", "12.5 %", "0.4%", "99.91%", "1.5K", "20 M", "3.007b", "1,234,567", "12,34", "2020", "2020.5", "1799.50", "0", "007", "123456", "1234567", "10.0", "e.g.", "APIs", "GenAI", "et al.", " (3)", " 11)", " (b)", " (k)", "**bold**", "*it*", "snake_case_name", "__u__", "`code`", "~~gone~~", "[a](b)", "![a](b)", "[^1]", "\n---\n", "  ", "\n\n\n\n", "word", "é", "x1", "1x", "$5", "12345678901234567890.5", "999,999,999,999,999,999,999", "1000000", " (10)", "(4)"]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: None if r.text is None else spoken_paragraph(r.text) for r in docs.collect()}
    assert {r.doc_id: r.text for r in spoken_column(docs).collect()} == want


def test_forms(spark):
    r = random.Random(8)
    texts = [None, "", " ", *FORMS, *("".join(r.choice([f, f + " ", " " + f]) for f in r.choices(FORMS, k=r.randrange(1, 9))) for _ in range(1500))]
    got = spoken_column(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()
    wrong = [(texts[x.i], x.text, w) for x in got if x.text != (w := None if texts[x.i] is None else spoken_paragraph(texts[x.i]))]
    assert wrong == []


def test_short_forms():
    assert all(any(x in k for x in spoken.SHORT) for k in ABBREVIATIONS)


def test_no_python_in_the_plan(spark):
    plan = spoken_column(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
