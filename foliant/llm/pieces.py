"""SentencePiece encoding and decoding (operator 4) by a forward pass over the trie of distinct marked words.

A unigram model takes the best-scoring segmentation (Viterbi); a BPE model, as the one at hand, takes the segmentation that merging
ends with, which isn't the one of highest total score. So the forward table holds, for a BPE model, each prefix's unique valid last
piece (see bpe_forward), and for a unigram model its best score and last piece. Both reuse the table along common prefixes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_forward import ForwardBPE
from .common import slices

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_WORDS = 500_000


def unigram_states(scores: dict[str, float], words: Iterable[str], unknown: float) -> Iterator[tuple[str, list[float], list[int]]]:
    """Viterbi over sorted words: for each, the best score of every prefix and the start of its last piece."""
    longest = max(map(len, scores), default=1)
    best, back, before = [0.0], [0], ""
    for w in words:
        k = 0
        while k < min(len(before), len(w)) and before[k] == w[k]:
            k += 1
        del best[k + 1 :], back[k + 1 :]
        for i in range(k + 1, len(w) + 1):
            top, start = best[i - 1] + unknown, i - 1
            for j in range(max(0, i - longest), i):
                s = scores.get(w[j:i])
                if s is not None and best[j] + s > top:
                    top, start = best[j] + s, j
            best.append(top)
            back.append(start)
        before = w
        yield w, best, back


class Pieces:
    """Encoder and decoder for a .model file of the sentencepiece library: BPE, byte fallback, identity normaliser, a mark before the
    text. Control strings inside a text are ordinary text, as that library has them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        vocab = {names[i]: i for i in range(n) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in vocab):
            raise ValueError("a piece of this model spans words")
        rank = {p: -sp.get_score(i) for p, i in vocab.items()}
        self.piece = [b"" if special[i] and not sp.is_byte(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.bpe = ForwardBPE(vocab, lambda a, b: rank.get(a + b), lambda c: [self.byte_id[x] for x in c.encode("utf-8", "surrogatepass")])
        self.known: dict[str, bytes] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """Marked words: no piece spans two of them. An empty text has none."""
        if not text:
            return []
        if "  " in text or MARK in text or text[-1] == " ":
            return UNIT.findall(MARK + text.replace(" ", MARK))
        words = (MARK + text.replace(" ", " " + MARK)).split(" ")
        return words if words[0] != MARK else UNIT.findall(MARK + text.replace(" ", MARK))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set(words)
        for w, last, _ in self.bpe.states(sorted(new)):
            self.known[w] = np.array(self.bpe.tokens(w, last), np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.units(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), np.uint32) for w in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for, without the mark before it."""
        out = b"".join(map(self.piece.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every row; null text gives an empty array. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in slices(batches, text):
            ids = p.encode(b.column(text).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([p.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(ids).to_pylist()], pa.string())], [key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def piece_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every row: key, n_ids, n_byte_ids (ids that stand for single bytes), ids_crc32 (of little-endian unsigned
    32-bit ids), decoded_sha256, round_trip (decoded text equals the text). Null and empty texts: no ids, round_trip true. A text that
    holds U+2581 itself doesn't round-trip, as that character stands for a space. Repeated rows give equal rows; very long texts are
    encoded whole; other columns are ignored; an empty table gives no rows. No shuffle."""
    names = ["n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in slices(batches, text, 2 << 20):
            texts = b.column(text).fill_null("").to_pylist()
            rows = []
            for t, ids in zip(texts, p.encode(texts), strict=True):
                out = p.decode(ids)
                rows.append((len(ids), int(p.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), hashlib.sha256(out).hexdigest(), out == t.encode("utf-8", "surrogatepass")))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
