"""Best-fit packing (operator 6) by minimum bin slack.

Documents become token pieces of at most `size` tokens. Which lengths share a sequence is decided on the histogram of lengths (at most
`size` numbers, however large the input): the longest length left is fixed, a bitset subset-sum over the other lengths left finds the
fullest sequence that can be made, and that combination is taken as often as the counts allow, then removed. Each step uses up a
length, or what a combination needs of one, so the plan stays small. The pieces then find their places by their rank among pieces of
their length, which is counted in salted groups, so a length that many pieces share is split over tasks."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, release, slices, stored
from .tokens import byte_symbols

#: Word parts kept with their ids in a Python worker, in each of two generations (about 200 bytes each).
CACHE_PARTS = 200_000
#: Pieces in a salted group, on average.
GROUP = 20_000
#: Words of ASCII and Latin-1 letters, whose lower case, normal form and classes need no tables; others go to the library whole.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
# Fixed: the word pattern of the vocabulary, for lower-cased words of that kind. A line break parts words.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
#: Stands between words in a run of ids; no vocabulary is that large.
BREAK = 0xFFFFFFFF


class Ids:
    """Token ids of texts by the tokenizers library. White space always parts words in vocabularies of this kind (its pattern never
    crosses it and no special string holds it). The distinct words of a batch are divided into the parts that the vocabulary's pattern
    gives, whose ids are looked up or asked from the library's model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.parts, self.others = Recent(CACHE_PARTS), Recent(CACHE_PARTS // 8)

    def of_plain(self, words: pa.Array) -> np.ndarray:
        """Ids of plain words, by the model of the library, with BREAK between words."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        parts = PARTS.findall(joined.lower())
        known, model = self.parts, self.tok.model
        for x in known.lacks(set(parts)):
            symbols = x if x.isascii() else x.encode().decode("latin-1").translate(self.symbols)
            known.new[x] = array("I", [BREAK] if x == "\n" else [t.id for t in model.tokenize(symbols)]).tobytes()
        return np.frombuffer(b"".join(map(known.new.__getitem__, parts)), np.uint32)

    def of_others(self, words: pa.Array) -> np.ndarray:
        """The same for any words, by the library."""
        words = words.to_pylist()
        known, gap = self.others, array("I", [BREAK]).tobytes()
        new = known.lacks(dict.fromkeys(words))
        for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known.new[w] = array("I", e.ids).tobytes()
        return np.frombuffer(gap.join(map(known.new.__getitem__, words)), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls), one after the other, and where each text's begin (and the end)."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.values.dictionary_encode()
        distinct = words.dictionary
        plain = pc.match_substring_regex(distinct, PLAIN)
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(distinct, s)))
        plain = plain.to_numpy(zero_copy_only=False)
        begin, size, flat, total = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), [], 0
        for some, find in ((plain, self.of_plain), (~plain, self.of_others)):
            if some.any():
                ids = find(distinct.filter(pa.array(some)))
                cut = np.flatnonzero(ids == BREAK)
                low = np.append(0, cut + 1)
                begin[some], size[some] = low + total, np.append(cut, len(ids)) - low
                flat.append(ids)
                total += len(ids)
        at = words.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        end = np.append(0, np.cumsum(n))
        out = np.concatenate([*flat, np.zeros(0, np.uint32)])[np.repeat(begin[at] - end[:-1], n) + np.arange(end[-1])]
        return out, end[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


@lru_cache(1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cut(docs: DataFrame, path: str, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece: each row's ids and the end id, cut every `size` tokens. Null and empty texts
    are one piece of one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last = ids_of(path), np.array([end], np.uint32).tobytes()
        for b in slices(batches, text):
            ids, edge = t.encode(b.column(text).fill_null(""))
            raw, count = memoryview(ids.tobytes()), np.diff(edge) + 1  # and the end id
            pieces = -(-count // size)
            row = np.repeat(np.arange(len(b)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(count[row] - start, size)
            low = 4 * (edge[row] + start)
            crc = [zlib.crc32(last, zlib.crc32(raw[x : x + 4 * n - 4])) if whole else zlib.crc32(raw[x : x + 4 * n]) for x, n, whole in zip(low.tolist(), length.tolist(), (start + length == count[row]).tolist(), strict=True)]
            cols = [b.column(key).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "length", "ids_crc32"])
            release()

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(have: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, within the counts in have) whose sum is the largest that is at most room. Bitset subset-sum: bit s of
    reach[i] says that the first i lengths can sum to s; the longest come first, and shorter ones are taken only where those don't do."""
    lengths = sorted((x for x in have if x <= room and have[x]), reverse=True)
    mask, reach = (1 << (room + 1)) - 1, [1]
    used: list[tuple[int, int]] = []
    for x in lengths:
        left = min(have[x], room // x)
        take = 1
        while left:  # 1, 2, 4, ... copies: any number of them
            n = min(take, left)
            used.append((x, n))
            reach.append((reach[-1] | reach[-1] << (x * n)) & mask)
            left -= n
            take *= 2
        if reach[-1] >> room & 1:  # full already, and shorter ones are better kept
            break
    s, out = reach[-1].bit_length() - 1, []
    for i in range(len(used), 0, -1):
        if s and not reach[i - 1] >> s & 1:
            x, n = used[i - 1]
            out += [x] * n
            s -= x * n
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences), by minimum bin slack."""
    have, out = {int(k): int(v) for k, v in counts.items() if v}, []
    while have:
        top = max(have)
        have[top] -= 1
        rest = fullest(have, size - top)
        have[top] += 1
        need: dict[int, int] = {}
        for x in [top, *rest]:
            need[x] = need.get(x, 0) + 1
        times = min(have[x] // n for x, n in need.items())
        for x, n in need.items():
            have[x] -= n * times
            if not have[x]:
                del have[x]
        out.append(([top, *rest], times))
    return out


def places(sequences: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: for ranks from `rank` on, per `each` pieces one sequence, from number `sequence` on, at
    `offset` and the lengths of those before it. Sorted by length and rank."""
    rows, number, seen = [], 0, {}
    for lengths, times in sequences:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            n = lengths.count(x)
            rows.append((x, seen.get(x, 0), n, number, at))
            seen[x] = seen.get(x, 0) + n * times
            at += n * x
        number += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "each", "sequence", "offset"))}


def packed(pieces: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """pieces (key, piece, length, ...) with sequence_id and offset. pieces is read more than once: pass a stored table. Rows that repeat
    wholly are placed each; an empty table gives no rows; other columns stay, whatever their names, but for `sequence_id` and `offset`, which
    the result's replace. Rank order within a length: key, piece (nulls first)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    to = places(plan(counts, size))
    groups = sum(counts.values()) // GROUP + 1
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(f"`{key}`", "piece"), F.lit(groups)))
    ranked = salted.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(f"`{key}`", "piece")))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(sizes.select("length", "__salt", before.alias("__before")), ["length", "__salt"]).withColumn("__r", F.col("__r") - 1 + F.col("__before"))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = [*kept, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = to["length"] * (1 << 40) + to["rank"]
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("__r").to_numpy()
            i = np.searchsorted(first, n * (1 << 40) + r, "right") - 1
            r = r - to["rank"][i]
            cols = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(to["sequence"][i] + r // to["each"][i]), pa.array(to["offset"][i] + r % to["each"][i] * n)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept)
    return ranked.select(*[F.col(f"`{c}`") for c in kept], "__r").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs. Very long texts are cut whole; other columns
    are ignored."""
    return packed(stored(cut(docs, path, size, end), "pieces"), size)
