"""Phrase collocations (operator 12) by hierarchical pair naming.

Texts become blocks of word numbers. Level by level, the distinct pairs of adjacent frequent (k-1)-grams of a block are dealt, as sorted
arrays, to ranges of their hash; a range sums the counts over all blocks, gives the frequent pairs ids and hands these back to the blocks,
which put them in place of the pairs: names of k-grams. A name points to its parents, the first and the last (k-1) words, so frequencies
of all cuts and of longer phrases around it are looked up along these pointers, without the texts. Ranges are cut in levels (runs.py), so
the arrays that move grow with the input."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, discard, n_buckets, release, slices, stored, stored_at
from .runs import bucket_of, joined, packed, salted, unpacked, widths
from .wordstream import mix

squeezed, unsqueezed = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

#: Fixed values of the measure: phrases, least frequency, weight of the score, share of a longer phrase that drops a shorter one.
LONGEST, LEAST, WEIGHT, SHARE, TOP = 4, 30, 2_000_000, 80, 2000
#: Words and marks of a block, distinct words of a block, and bytes of text that are divided at once.
BLOCK, VOCABULARY, PART = 1 << 20, 200_000, 1 << 22
#: Bytes of text for which there is one range of the words' and pairs' hashes.
RANGE = 8 << 20
#: Candidates of a group that is ranked by itself before the ranks of a language are settled.
GROUP = 1_000_000
#: The marks and line ends that end a piece.
MARKS = b".,;:!?\n\x0b\x0c\r"
#: Stands between the language and the word of a key: a byte that UTF-8 doesn't have.
LEAD = b"\xff"
TOKEN = re.compile(rb"[%b]|[^ \t%b]+" % (MARKS, MARKS))
MARK = re.compile(rb"[%b]" % MARKS)


class _Numbers(dict):
    """Numbers of words in one language of a block; marks have -1."""

    def __init__(self, words: list[bytes], lang: str):
        super().__init__((bytes([m]), -1) for m in MARKS)
        self.words, self.lead = words, lang.encode() + LEAD

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(self.lead + word)
        return n


class _Block:
    """Word numbers of several texts, -1 where a piece ends. A word's key has its language before it."""

    def __init__(self):
        self.words: list[bytes] = []
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, raw: bytes) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(self.words, lang)
        tokens = TOKEN.findall(raw.lower())  # ASCII letters only, in bytes
        self.parts += [np.fromiter(map(self.numbers[lang].__getitem__, tokens), np.int32, len(tokens)), np.full(1, -1, np.int32)]
        self.size += len(tokens) + 1

    def full(self, most: int) -> bool:
        return self.size >= most or len(self.words) >= VOCABULARY


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in parts that end with a mark, of PART bytes and what follows up to the next mark."""
    at = 0
    while len(raw) - at > PART:
        m = MARK.search(raw, at + PART)
        if not m:
            break
        yield raw[at : m.end()]
        at = m.end()
    yield raw[at:] if at else raw


class _Words:
    """Keys that are words, each with its language before it."""

    @staticmethod
    def hashes(keys: pa.Array) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, keys.to_pylist()), np.uint64, len(keys)) << np.uint64(32)

    @staticmethod
    def order(keys: pa.Array, bucket: np.ndarray) -> np.ndarray:
        return np.lexsort((pc.rank(keys, tiebreaker="dense").to_numpy(), bucket))

    @staticmethod
    def take(keys: pa.Array, at: np.ndarray) -> pa.Array:
        return keys.take(pa.array(at))

    @staticmethod
    def packed(keys: pa.Array) -> tuple[bytes, bytes]:
        return squeezed(b"".join(keys.to_pylist())), packed(pc.binary_length(keys).to_numpy().astype(np.int32))

    @staticmethod
    def joined(a: list[bytes], b: list[bytes]) -> pa.Array:
        ends = np.append(0, np.cumsum(joined(b, np.int32), dtype=np.int64))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(map(unsqueezed, a)))])

    @staticmethod
    def numbered(keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
        d = keys.dictionary_encode()
        return d.indices.to_numpy().astype(np.int64), d.dictionary


class _Pairs:
    """Keys that are pairs of ids: arrays of two rows."""

    @staticmethod
    def hashes(keys: np.ndarray) -> np.ndarray:
        left, right = keys.view(np.uint64)
        return mix(mix(left.copy()) + right)

    @staticmethod
    def order(keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return np.lexsort((keys[1], keys[0], bucket))

    @staticmethod
    def take(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        return keys[:, at]

    @staticmethod
    def packed(keys: np.ndarray) -> tuple[bytes, bytes]:
        return stepped(keys[0]), packed(keys[1])  # sorted by the left one

    @staticmethod
    def joined(a: list[bytes], b: list[bytes]) -> np.ndarray:
        return np.stack([unstepped(a, np.int64), joined(b, np.int64)])

    @staticmethod
    def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.lexsort((keys[1], keys[0]))
        left, right = keys[:, at]
        new = np.append(True, (np.diff(left) != 0) | (np.diff(right) != 0))[: len(at)]
        number = np.empty(len(at), np.int64)
        number[at] = np.cumsum(new) - 1
        return number, keys[:, at[new]]


#: The keys of a block in one range of their hash: their numbers in it (idx), their counts (n), and themselves (a, b); and the numbers of
#: the places of a block (ids), in a row of their own.
PIECE = "bucket int, block long, blocks binary, idx binary, n binary, a binary, b binary, ids binary"
#: A frequent key (id, left and right or word, n); what a range tells a block: idx and their ids; words of a language in a range.
NAME = "id long, left long, right long, word binary, lang string, n long, block long, idx binary, ids binary"


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def stepped(a: np.ndarray) -> bytes:
    """packed() of the steps from each number to the next: rising numbers shrink to little."""
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def unstepped(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.cumsum(unpacked(b, kind), dtype=kind) for b in blobs)])


def _sorted(kind: type, keys, width: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Order of the keys by range, and each key's place in it."""
    at = kind.order(keys, bucket_of(kind.hashes(keys), width))
    place = np.empty(len(at), np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    return at, place


def _cut(kind: type, keys, blocks: np.ndarray, idx: np.ndarray, n: np.ndarray, width: int) -> list[dict]:  # noqa: ANN001
    """Rows of the ranges that the keys fall into; each has its keys sorted."""
    bucket = bucket_of(kind.hashes(keys), width)
    at = kind.order(keys, bucket)
    edge = np.append(np.flatnonzero(np.diff(bucket[at], prepend=-1)), len(at)).tolist()
    keys, blocks, idx, n, bucket = kind.take(keys, at), blocks[at], idx[at], n[at], bucket[at]
    out = []
    for x, y in zip(edge, edge[1:], strict=False):
        a, b = kind.packed(keys[x:y] if kind is _Words else keys[:, x:y])
        out.append({"bucket": int(bucket[x]), "blocks": stepped(blocks[x:y]), "idx": stepped(idx[x:y]), "n": packed(n[x:y]), "a": a, "b": b})
    return out


def _blocks(docs: DataFrame, width: int, most: int) -> DataFrame:
    """The blocks of all texts and their words by range."""

    def rows(b: _Block, number: int) -> Iterator[pa.RecordBatch]:
        ids, m = np.concatenate(b.parts), len(b.words)
        if m:  # numbers in the order of the ranges
            keys, n = pa.array(b.words, pa.large_binary()), np.bincount(ids[ids >= 0], minlength=m)
            at, place = _sorted(_Words, keys, width)
            out = _cut(_Words, keys.take(pa.array(at)), np.full(m, number), np.arange(m, dtype=np.int32), n[at], width)
            yield from _table(PIECE, [*out, {"block": number, "ids": packed(np.append(place, np.int32(-1))[ids])}]).to_batches()
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, b = TaskContext.get().partitionId() << 32, _Block()
        for batch in slices(batches):
            for lang, t in zip(batch.column("lang").to_pylist(), byte_texts(batch.column("text")), strict=True):
                for part in _pieces(t):
                    b.add(lang, part)
                    if b.full(most):
                        yield from rows(b, number)
                        number, b = number + 1, _Block()
        if b.size:
            yield from rows(b, number)

    return docs.mapInArrow(run, PIECE)


def _all(kind: type, t: pa.Table) -> tuple:
    col = lambda name: t[name].to_pylist()
    return kind.joined(col("a"), col("b")), unstepped(col("blocks"), np.int64), unstepped(col("idx"), np.int32), joined(col("n"), np.int64)


def _finer(kind: type, width: int):  # noqa: ANN202
    def run(t: pa.Table) -> pa.Table:
        out = _table(PIECE, _cut(kind, *_all(kind, t), width))
        release()
        return out

    return run


def _named(kind: type, least: int):  # noqa: ANN202
    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        keys, blocks, idx, n = _all(kind, t)
        number, keys = kind.numbered(keys)
        total = np.zeros(len(keys) if kind is _Words else keys.shape[1], np.int64)
        np.add.at(total, number, n)
        often = np.flatnonzero(total >= least)
        id_ = np.full(len(total), -1, np.int64)
        id_[often] = (bucket << 32) + np.arange(len(often))
        out = [{"id": i, "n": c} for i, c in zip(id_[often].tolist(), total[often].tolist(), strict=True)]
        if kind is _Words:
            words: dict[str, int] = {}
            for k, c in zip(keys.to_pylist(), total.tolist(), strict=True):
                lang = k[: k.index(LEAD)]
                words[lang] = words.get(lang, 0) + c
            for r, k in zip(out, keys.take(pa.array(often)).to_pylist(), strict=True):
                lang, _, r["word"] = k.partition(LEAD)
                r["lang"] = lang.decode()
            out += [{"lang": lang.decode(), "n": c} for lang, c in words.items()]
        else:
            for r, x, y in zip(out, *keys[:, often].tolist(), strict=True):
                r["left"], r["right"] = x, y
        has = np.flatnonzero(id_[number] >= 0)
        has = has[np.argsort(blocks[has], kind="stable")]
        edge = np.append(np.flatnonzero(np.diff(blocks[has], prepend=-1)), len(has)).tolist()
        out += [{"block": int(blocks[has[x]]), "idx": stepped(idx[has[x:y]]), "ids": packed(id_[number[has[x:y]]])} for x, y in zip(edge, edge[1:], strict=False)]
        release()
        return _table(NAME, out)

    return run


def _names(rows: DataFrame, kind: type, least: int, buckets: int) -> DataFrame:
    """Frequent keys of all blocks with an id each, and what the blocks are told, as a stored table."""
    pieces, wide = rows.where("bucket is not null"), widths(buckets)
    for before, now in zip(wide, wide[1:], strict=False):
        pieces = salted(pieces, "bucket", "idx", buckets, before).applyInArrow(_finer(kind, now), PIECE)
    return stored(pieces.groupBy("bucket").applyInArrow(_named(kind, least), NAME), "names")


def _paired(width: int):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block: its numbers with the ids that these now have (none: -1); then the distinct pairs of neighbours that both have one,
        and for each place the number of its pair."""
        if not len(left) or not len(right):
            return _table(PIECE, [])
        old = unpacked(left["ids"][0].as_py(), np.int32)
        name = np.full(int(old.max(initial=-1)) + 2, -1, np.int64)  # the last is that of -1
        name[unstepped(right["idx"].to_pylist(), np.int32)] = joined(right["ids"].to_pylist(), np.int64)
        ids, to = np.unique(name[old], return_inverse=True)
        good = ids[to] >= 0
        good = good[:-1] & good[1:]
        pairs, number, n = np.unique(to[:-1][good] * len(ids) + to[1:][good], return_inverse=True, return_counts=True)
        if not len(pairs):
            return _table(PIECE, [])
        new, m, block = np.full(len(good), -1, np.int32), len(pairs), left["block"][0].as_py()
        keys = np.stack([ids[pairs // len(ids)], ids[pairs % len(ids)]])
        at, place = _sorted(_Pairs, keys, width)
        new[good] = place[number]
        out = _cut(_Pairs, keys[:, at], np.full(m, block), np.arange(m, dtype=np.int32), n[at].astype(np.int64), width)
        out = _table(PIECE, [*out, {"block": block, "ids": packed(new)}])
        release()
        return out

    return run


def _next(rows: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """The blocks with the names in place of their numbers, paired again."""
    known = names.where("block is not null").select(F.col("block").alias("of"), "idx", "ids")
    blocks = rows.where("ids is not null").select("block", "ids")
    return blocks.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_paired(width), PIECE)


def _phrases(level: DataFrame, shorter: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """Names of one level with what their parents know. heads and tails: frequencies of the first and of the last 1, 2, ... words; cut:
    (score, words before the cut, l, r) of the lowest score; dropped: whether a longer phrase holds too large a share."""
    a, b = shorter.alias("a"), shorter.alias("b")
    rows = level.alias("p").join(a, F.col("p.left") == F.col("a.id")).join(b, F.col("p.right") == F.col("b.id"))
    n = F.col("p.n")
    cuts = F.transform(F.arrays_zip(F.col("a.heads").alias("l"), F.reverse("b.tails").alias("r")), _scored(n))
    rows = rows.select(
        F.col("p.id").alias("id"), F.col("a.lang").alias("lang"), F.concat("a.phrase", F.lit(b" "), "b.last").alias("phrase"), F.col("b.last").alias("last"), n.alias("n"),
        F.concat("a.heads", F.array(n)).alias("heads"), F.concat("b.tails", F.array(n)).alias("tails"), F.array_min(cuts).alias("cut"),
    )
    if longer is None:
        return rows.withColumn("dropped", F.lit(False))
    # what a still longer phrase drops, the one between drops too: it is as frequent at least
    around = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("m")).groupBy("id").agg(F.max("m").alias("m"))
    return rows.join(around, "id", "left").withColumn("dropped", F.coalesce(100 * F.col("m") >= share * F.col("n"), F.lit(False))).drop("m")


def _scored(n: Column):  # noqa: ANN202
    def of(pair: Column, at: Column) -> Column:
        wide = F.lit(WEIGHT).cast("decimal(18,0)") * n.cast("decimal(19,0)")  # up to 37 digits: may pass 64 bits
        both = pair["l"] + pair["r"]
        return F.struct(((wide - wide % both) / both).cast("long").alias("score"), at.alias("at"), pair["l"].alias("l"), pair["r"].alias("r"))

    return of


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least` times at least, by
    the score of their lowest cut; a, l, r: how often the phrase and the parts of that cut occur, n: all words of the language. Phrases of
    which a longer one (itself frequent) holds `share` per cent go. Null languages are `und`, null and empty texts have no words, rows
    that repeat count each, and texts of any length are counted whole (a long one in several parts, ended by marks). Ties: a descending,
    then the phrase's bytes. Other columns are ignored, whatever their names; an empty table gives no rows. Exchanges: distinct words or
    pairs of a block by range, as packed arrays, blocks by number; no text moves."""
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    spark, buckets = docs.sparkSession, n_buckets(named, RANGE)
    width = widths(buckets)[0]
    rows, path = stored_at(_blocks(named, width, block), "blocks")
    levels = [_names(rows, _Words, least, buckets)]
    for _ in range(longest - 1):
        rows, now = stored_at(_next(rows, levels[-1], width), "pairs")
        discard(spark, path)  # all that is needed of it is in the new table and in the names
        path = now
        levels.append(_names(rows, _Pairs, least, buckets))
    discard(spark, path)
    total = levels[0].where("id is null and lang is not null").groupBy("lang").agg(F.sum("n").alias("total"))
    levels = [x.where("id is not null") for x in levels]
    one = F.array("n")
    shorter = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", one.alias("heads"), one.alias("tails"))
    found = None
    for k in range(1, longest):
        shorter = stored(_phrases(levels[k], shorter, levels[k + 1] if k + 1 < longest else None, share), "phrases")
        found = shorter if found is None else found.unionByName(shorter)
    found = found.where("not dropped").select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = sum(x.count() for x in levels[1:]) // GROUP + 1
    first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order))
    found = found.withColumn("first", first).where(F.col("first") <= top).drop("first")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", F.col("rank").cast("long"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), "score")
