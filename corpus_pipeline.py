"""A corpus pipeline over `documents`: quality rules, n-gram Jaccard join, substring dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next stage's docs. All
but the last return the columns of documents. Part of the llm subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import jaccard, packing, pii, quality, substring
from foliant.llm.common import shared_dir, stored
from foliant.llm.entry import tokenizer_path
from foliant.llm.substring import NULL_ID


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, n_chars (where there is one) counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules or the model reject. The model learns from labelled rows of docs."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.passed(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id. Rows of other texts stay even if their ids are equal or
    null; so do null and empty texts."""
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts. Texts that lose nothing stay byte for byte; those that do keep their words, parted by
    single spaces. No document goes. Rows that share an id (null ones too) are documents of their own: they come before all others."""
    again = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__shared"), F.lit(True).alias("__again")), "again")
    if again.isEmpty():
        return _with_length(substring.removed(docs, counts=False), docs.columns)
    own = F.when(F.col("__again"), F.lit(NULL_ID + 1) + F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long"))
    keyed = stored(docs.join(again, F.col("doc_id").eqNullSafe(F.col("__shared")), "left").withColumn("__own", own).drop("__shared", "__again"), "keyed")
    out = substring.removed(keyed.withColumnsRenamed({"doc_id": "__was", "__own": "doc_id"}), counts=False)
    return _with_length(out.drop("doc_id").withColumnRenamed("__was", "doc_id"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of span in place of personal data."""
    return _with_length(pii.personal(docs, replace=True), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most 2048."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("substring dedup", substring_dedup), ("PII", personal_data), ("best-fit packing", best_fit_packing)]

#: The learned verdicts and packing can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows lie in the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
