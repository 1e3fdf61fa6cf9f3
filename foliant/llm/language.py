"""Language ID (operator 10): each document is a mixture of languages whose shares expectation-maximisation estimates from n-gram
likelihoods; the language set is the one of highest penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, release, slices, stored
from .runs import packed, unpacked

#: Rows of each language that are learned from at most: those with the smallest hash of their id.
SAMPLE = 400
BITS = 16
GRAM = 4
#: EM rounds, and the cost of each further language in the set (times half the logarithm of the number of n-grams).
ROUNDS, PENALTY = 8, 4.0
LETTER = regex.compile(r"\p{L}")
FOLD = bytes.maketrans(bytes(range(65, 91)) + bytes(range(0x21, 0x41)), bytes(range(97, 123)) + b" " * 32)


def grams(t: bytes) -> np.ndarray:
    """Hash buckets of the byte 4-grams; ASCII letters are folded, ASCII digits and marks count as spaces, spaces stand around the text
    (as many as a gram needs)."""
    a = np.frombuffer(b" " + t.translate(FOLD).ljust(GRAM - 2) + b" ", np.uint8).astype(np.uint32)
    w = a[: len(a) - 3] | a[1 : len(a) - 2] << np.uint32(8) | a[2 : len(a) - 1] << np.uint32(16) | a[3:] << np.uint32(24)
    return (w * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def has_letter(t: bytes) -> bool:
    """Whether a text has a character of the letter categories (its beginning is looked at first)."""
    return LETTER.search(t[:4096].decode("utf-8", "ignore")) is not None or LETTER.search(t.decode("utf-8", "ignore")) is not None


def model_of(counts: dict[str, np.ndarray]) -> dict | None:
    """Per language the smoothed probability of each bucket, from its counts."""
    if not counts:
        return None
    table = np.stack([counts[k] for k in sorted(counts)], 1) + 0.05
    return {"langs": sorted(counts), "p": (table / table.sum(0)).astype(np.float32)}


def fit(rows: list[tuple[str, bytes]]) -> dict | None:
    counts: dict[str, np.ndarray] = {}
    for lang, t in rows:
        counts[lang] = counts.get(lang, 0) + np.bincount(grams(t), minlength=1 << BITS)
    return model_of(counts)


def shares(p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expectation-maximisation: the shares of the languages (columns) under which n-grams of these weights are likeliest."""
    s, total = np.full(p.shape[1], 1 / p.shape[1], np.float32), weight.sum()
    for _ in range(ROUNDS if p.shape[1] > 1 else 0):
        s = s * ((weight / (p @ s)) @ p) / total
    return s


def mixture(p: np.ndarray, weight: np.ndarray) -> tuple[int, float, np.ndarray]:
    """p: probability of each distinct n-gram of a document (row) in each language (column); weight: how often it occurs. Best language,
    its share, and all shares. Sets of 1, 2, ... languages, in the order of the shares among all, get shares of their own; the set of
    highest penalised likelihood is taken. A language with less than one n-gram to its share ends the sets."""
    k, n = p.shape[1], float(weight.sum())
    every = shares(p, weight)
    order = np.lexsort((np.arange(k), -every))
    best, chosen, own, cost = -np.inf, order[:1], np.ones(1), PENALTY * 0.5 * np.log(max(2, n))
    for m in range(1, k + 1):
        part = order[:m]
        if m > 1 and every[part[-1]] * n < 1:
            break
        q = p[:, part]
        s = shares(q, weight)
        value = float((weight * np.log(q @ s + 1e-30)).sum()) - cost * m
        if value > best:
            best, chosen, own = value, part, s
    s = np.zeros(k)
    s[chosen] = own / own.sum()
    top = int(np.argmax(s))
    return top, float(min(1.0, s[top])), s


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Learns from rows with a language whose crc32 of the id isn't 2 modulo 4: at most `sample` rows of each language, those with the
    smallest hash of the id (a documented bound; every row is predicted); of rows that share an id and a language, the smallest text. None
    if there is none. What comes to the driver is a table of n-gram counts of each language and partition, no texts; the model takes 256 KB
    a language. Very long texts are learned from and predicted whole; other columns are ignored."""
    known = docs.where("lang is not null and text is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    sizes = known.groupBy("lang").count()
    # rows of small hash, so few that a window over each language stays small; a language has at least `sample` of them, or all it has
    near = F.xxhash64("doc_id")
    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 200) / F.col("count"))
    few = known.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(near.cast("double") <= share * float(1 << 64) - float(1 << 63)).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(near, "doc_id"))
    ids = stored(few.withColumn("r", rank).where(F.col("r") <= sample).select("doc_id", "lang"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), byte_texts(b.column("text")), strict=True):
                counts[lang] = counts.get(lang, 0) + np.bincount(grams(t), minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([packed(c.astype(np.int64)) for c in counts.values()], pa.binary())], ["lang", "counts"])

    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).repartition(8)  # an id that repeats counts once
    rows = rows.select("lang", "text").mapInArrow(run, "lang string, counts binary")
    total: dict[str, np.ndarray] = {}
    for r in rows.collect():  # 8 tables a language at most
        total[r["lang"]] = total.get(r["lang"], 0) + unpacked(r["counts"], np.int64)
    return model_of(total)


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs (the chosen set with shares) of every row. Null text, or text without a letter: und,
    score 0, no set; so is every row without a model. Equal texts get equal results. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            rows = []
            for t in byte_texts(b.column("text")):
                if model is None or not has_letter(t):
                    rows.append(("und", 0.0, ""))
                    continue
                gram, n = np.unique(grams(t), return_counts=True)
                top, s, share = mixture(model["p"].take(gram, 0), n.astype(np.float32))
                rows.append((model["langs"][top], round(s, 6), ",".join(f"{model['langs'][i]}:{share[i]:.3f}" for i in np.argsort(-share, kind="stable") if share[i] > 0)))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(c[0]), pa.array(c[1], pa.float64()), pa.array(c[2])], ["doc_id", "held_out", "lang_pred", "score", "langs"])
            release()

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs string")
