"""Quality rules (operator 5): fixed counts, and a hashed n-gram logistic regression trained on labelled rows.

Features are hashed words, pairs of words, and runs of 3 and of 5 characters (code points), each family normalised to its share of the
document, so the score is a mean of weights and needs no feature vector. A held-out part of the training sample calibrates it (Platt); thresholds are fixed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, release, slices, slim, stored

#: Labelled rows of each class that are used at most: those with the smallest hash of their id.
SAMPLE = 600
#: Longer texts (in bytes) aren't learned from; all are scored.
SAMPLE_BYTES = 1 << 16
#: A document is kept if its calibrated probability of being good is at least this.
KEEP = 0.35
BITS = 16
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
TAILS = bytes(range(0x80, 0xC0))
GRAMS = (3, 5)


def repeats(words: list[bytes], k: int = 5) -> int:
    """Words that stand in windows of k words found twice or more in the text. Exact: words are numbered, then pairs of numbers."""
    n = len(words)
    if n <= k:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == n:
        return 0
    code, width = ids, 1
    while width < k:  # codes of windows of `width` words, up to k
        step = min(width, k - width)
        top = int(code.max()) + 1
        code = code[: len(code) - step] * top + code[step:]
        width += step
        if width < k or top > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    hot = count[inverse] > 1
    if not hot.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hot)
    edge[at] += 1
    np.subtract.at(edge, at + k, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(t: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    words = t.split()
    lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
    return len(words), len(t.translate(None, SPACE + TAILS)), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats(words), words


def features(t: bytes, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash buckets of the words, of pairs of words, and of the runs of characters of each length; each family is one block of the
    weights."""
    a = np.frombuffer(t, np.uint8).astype(np.uint32) if t.isascii() else np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    w = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    out = [w >> np.uint32(32 - BITS), ((w[:-1] * np.uint32(0x01000193)) ^ w[1:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)]
    for k in GRAMS:
        if len(a) < k:
            out.append(np.zeros(0, np.uint32))
            continue
        h = a[: len(a) - k + 1].copy()
        for i in range(1, k):
            h *= np.uint32(0x01000193)
            h += a[i : len(a) - k + 1 + i]
        h *= np.uint32(0x9E3779B1)
        out.append(h >> np.uint32(32 - BITS))
    return tuple(out)


def score(weights: np.ndarray, bias: float, t: bytes, words: list[bytes]) -> float:
    """Raw score: bias and, for each family, the mean weight of its buckets."""
    return bias + sum(float(weights[i].take(f).mean()) for i, f in enumerate(features(t, words)) if len(f))


def fit(texts: list[bytes], good: list[int], rounds: int = 300, rate: float = 4.0) -> dict:
    """Logistic regression by full-batch gradient descent on sparse rows (a fifth is held out and calibrates); classes weigh alike."""
    n, families, y = len(texts), 2 + len(GRAMS), np.array(good, float)
    held = np.arange(n) % 5 == 0
    use = np.flatnonzero(~held)
    cols, vals, at = [], [], []
    for r, t in enumerate(texts):
        for i, f in enumerate(features(t, t.split())):
            u, c = np.unique(f, return_counts=True)
            cols.append(u.astype(np.int32) + np.int32(i << BITS))
            vals.append((c / max(1, c.sum())).astype(np.float32))
            at.append(np.full(len(u), r, np.int32))
    cols, vals, at = np.concatenate(cols), np.concatenate(vals), np.concatenate(at)
    # rare shares are small: scale each bucket by the inverse root of its mean share, so that steps are of one size
    scale = 1 / np.sqrt(np.bincount(cols, vals, families << BITS) / n + 1e-4)
    vals *= scale[cols].astype(np.float32)
    w, b = np.zeros(families << BITS), 0.0
    # rows held out weigh nothing
    weight = np.where(y > 0, 0.5 / max(1, y[use].sum()), 0.5 / max(1, (1 - y[use]).sum())) * ~held
    for _ in range(rounds):
        z = np.bincount(at, w[cols] * vals, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        w -= rate * (np.bincount(cols, g[at] * vals, families << BITS) + 1e-5 * w)
        b -= rate * g.sum()
    z = (np.bincount(at, w[cols] * vals, n) + b)[held]
    slope, shift, t = 1.0, 0.0, y[held]
    for _ in range(500 if len(t) else 0):  # Platt, towards smoothed targets
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        goal = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        slope -= 0.1 * float(((p - goal) * z).mean())
        shift -= 0.1 * float((p - goal).mean())
    return {"weights": (w * scale * slope).reshape(families, -1).astype(np.float32), "bias": b * slope + shift, "held_accuracy": float(((slope * z + shift > 0) == (t > 0)).mean()) if len(t) else None}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> dict | None:
    """A model from labelled documents: at most `sample` documents of each class, those with the smallest hash of doc_id among the labelled
    documents of docs whose texts have at most `most_bytes` (both bounds keep what is collected small; they don't touch the rows that are
    scored). Of rows that share an id the smallest text is learned from. None where docs has no row; ValueError where it has some, but a
    class has none to learn from."""
    slim(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    # first the ids, by hash, then the texts of the chosen
    there = short.select("doc_id").join(known, "doc_id").distinct()
    picked = [there.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = stored(picked[0].unionByName(picked[1]), "sample")
    rows = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()  # 2 * sample at most
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    lacking = {0, 1} - {r["quality"] for r in rows}
    if lacking and not docs.isEmpty():
        raise ValueError(f"no labelled document of at most {most_bytes} bytes and of quality {sorted(lacking)} to learn from")
    return None if lacking else fit([(r["text"] or "").encode() for r in rows], [r["quality"] for r in rows])


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
KINDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def verdicts(texts: list[bytes], model: dict | None, keep: float) -> list[tuple]:
    rows = []
    for t in texts:
        n, chars, symbols, dup, rep, words = measures(t)
        failed = n < 10 or 100 * rep > 20 * n
        p = None
        if model is not None:
            p = float(1 / (1 + np.exp(-min(30.0, max(-30.0, score(model["weights"], model["bias"], t, words))))))
        rows.append((n, chars, symbols, dup, rep, failed, p, not failed and (p is None or p >= keep)))
    return rows


def judge(docs: DataFrame, model: dict | None, keep: float = KEEP, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys (but for those that have a name of the measures) and the measures, score and verdict of every row. Null and empty texts have
    no words and fail the base rule. Without a model (no labelled rows of both classes) the score is null and the base rule decides.
    Rows that repeat are judged alike; very long texts are judged whole; an empty table gives no rows. One narrow pass."""
    keys = tuple(k for k in keys if k not in NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            c = list(zip(*verdicts(byte_texts(b.column(text)), model, keep), strict=True))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5]), pa.array(c[6], pa.float64()), pa.array(c[7])], [*keys, *NAMES])
            release()

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    cols = list(dict.fromkeys([*keys, text]))
    return docs.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, f"{kinds}, {KINDS}")


def passed(docs: DataFrame, model: dict | None, keep: float = KEEP, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield b.filter(pa.array([r[-1] for r in verdicts(byte_texts(b.column(text)), model, keep)], pa.bool_()))
            release()

    return docs.mapInArrow(run, docs.schema)
