"""Media columns (operator 9): texts stored as lossless WebP gray images, read back, and described by features of the pixels."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import byte_texts, slices

#: Samples in a row; a payload is a whole number of rows.
ROW = 576
#: Rows of an image at most; a longer payload becomes several images, one after the other.
ROWS = webp.SIDE


def payload(t: bytes, row: int = ROW) -> bytes:
    """t and bytes 255 up to a positive multiple of row."""
    n = max(1, -(-len(t) // row)) * row
    return t + b"\xff" * (n - len(t))


def stored_form(p: bytes, row: int = ROW) -> bytes:
    a = np.frombuffer(p, np.uint8).reshape(-1, row)
    return b"".join(webp.gray(a[i : i + ROWS]) for i in range(0, len(a), ROWS))


def read_back(media: bytes) -> np.ndarray:
    """All rows of samples of the images in media."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(webp.ungray(media[at : at + n]))
        at += n
    return np.concatenate(out)


def feature(a: np.ndarray) -> str:
    """Rows, mean, standard deviation, and a 64-bit hash of which of 64 column blocks are brighter than the mean."""
    blocks = a.reshape(len(a), 64, -1).mean((0, 2))
    bits = int("".join("1" if x else "0" for x in blocks > blocks.mean()), 2)
    return f"rows={len(a)};mean={a.mean():.4f};sd={a.std():.4f};blocks={bits:016x}"


def stored_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (with_media: and the file) of every
    row; all but the sizes of the text come from what is read back. Null counts as empty: one row of 255. Equal texts, equal values; very
    long texts are stored whole; other columns are ignored; an empty table gives no rows. One narrow pass."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if with_media else [])]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if with_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            rows = []
            for t in byte_texts(b.column(text)):
                media = stored_form(payload(t))
                a = read_back(media)
                p = a.tobytes()
                rows.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(a), *([media] if with_media else [])))
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(x, k) for x, k in zip(c, types, strict=True))], [key, *names])

    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {kinds}")
