"""Token counts (operator 3): exact token count at every prefix of a text, by prefix dynamic programming."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_forward import ForwardBPE
from .common import Recent, release, slices
from .runs import packed, unpacked

#: Words and chunks kept with their counts in a Python worker, in each of two generations (about 150 bytes each).
CACHE_WORDS = 250_000
#: Where white space (U+001C to U+001F too) meets white space across a single space; elsewhere a space and what follows to the next one
#: are independent.
_S = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
KNIT = f"{_S} {_S}|  "
#: No white space beside white space, no apostrophe, no sign that may begin a special string.
PLAIN = regex.compile(r"\s?(?:[^\s'<]+\s)*[^\s'<]+")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE = regex.compile(r"\s")


def byte_symbols() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 bytes stand for themselves, the others
    for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for a byte-level BPE file of the tokenizers library (no normaliser, the usual word pattern)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sym = byte_symbols()
        raw = lambda s: bytes(sym[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks[raw(a), raw(b)] = i
        self.bpe = ForwardBPE(vocab, lambda a, b: ranks.get((a, b)))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks, self.parts = Recent(CACHE_WORDS), Recent(CACHE_WORDS)

    def words(self, text: str) -> list[str]:
        """Words in the sense of the vocabulary; a special string is a word of its own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return SPLIT.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text)):
            out += [part] if i % 2 else SPLIT.findall(part)
        return out

    def totals(self, texts: list[str]) -> list[int]:
        """Token count of each text, encoded alone: the sum over its words of the last state."""
        total, special = self.bpe.total, set(self.special)
        return [sum(1 if w in special else total(w.encode("utf-8", "surrogatepass")) for w in self.words(t)) for t in texts]

    def word_steps(self, w: str) -> bytes:
        """By how much the count changes at each character of one word: over its bytes, state by state."""
        node, step, out = self.bpe.root, self.bpe.step, []
        if w.isascii():
            for x in w.encode():
                node, more = node[2].get(x) or step(node, x)
                out.append(more)
        else:
            for c in w:
                n = 0
                for x in c.encode():
                    node, more = node[2].get(x) or step(node, x)
                    n += more
                out.append(n)
        return array("b", out).tobytes()

    def steps(self, chunk: str) -> bytes:
        """By how much the count changes at each character of a chunk (signed 8-bit), as if it were encoded alone. Where no white space
        meets white space and no contraction can stand, a prefix is divided as the whole is."""
        if not PLAIN.fullmatch(chunk):
            return array("b", np.diff(self.prefix_counts(chunk)).tolist()).tobytes()
        words = SPLIT.findall(chunk)
        known = self.parts
        for w in known.lacks(words):
            known.new[w] = self.word_steps(w)
        return known.new[words[0]] if len(words) == 1 else b"".join(map(known.new.__getitem__, words))

    def tables(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The prefix tables of all texts (strings without nulls), one after the other: by how much the count changes at each character,
        and where each text's begin (and the end). Single spaces part a text into chunks whose tables follow each other, so those of
        equal chunks are looked up; a text in which white space meets white space across a space, or with a special string, is one chunk."""
        knit = pc.match_substring_regex(texts, KNIT)
        for s in self.special:
            knit = pc.or_(knit, pc.match_substring(texts, s))
        # a space stands before each chunk but a text's first, so those are told apart by a mark
        lists = pc.split_pattern(texts, " ")
        size = np.diff(lists.offsets.to_numpy())
        first = np.cumsum(size) - size
        words = lists.values.dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.ones(len(at), bool)
        inner[first] = False
        whole = np.repeat(knit.to_numpy(zero_copy_only=False), size)
        n = len(words.dictionary)
        used = np.zeros(n, bool)
        used[at[inner & ~whole]] = True
        spaced, names = np.flatnonzero(used), words.dictionary
        keys = (" " + "\0 ".join(names.filter(pa.array(used)).to_pylist())).split("\0") if len(spaced) and not pc.any(pc.match_substring(names, "\0")).as_py() else [" " + x for x in names.filter(pa.array(used)).to_pylist()]
        heads = names.take(pa.array(at[first])).to_pylist()
        for i in np.flatnonzero(knit.to_numpy(zero_copy_only=False)).tolist():
            heads[i] = texts[i].as_py()
        # a head that is a whole text isn't kept: it may be as long as the text
        known = self.chunks
        for k in known.lacks(dict.fromkeys(keys)):
            known.new[k] = self.steps(k)
        blobs = [*map(known.new.__getitem__, keys), *map(self.steps, heads)]
        length = np.fromiter(map(len, blobs), np.int64, len(blobs))
        begin, flat = np.cumsum(length) - length, np.frombuffer(b"".join(blobs), np.int8)
        slot = np.zeros(n, np.int64)
        slot[spaced] = np.arange(len(spaced))
        use = slot[at]
        use[first] = len(keys) + np.arange(len(heads))
        keep = ~(inner & whole)
        row = np.repeat(np.arange(len(size)), size)[keep]
        use = use[keep]
        m = length[use]
        end = np.append(0, np.cumsum(m))
        out = flat[np.repeat(begin[use] - end[:-1], m) + np.arange(end[-1])]
        return out, np.append(0, np.cumsum(np.bincount(row, m, len(size)).astype(np.int64)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for i in 0..len(text), each as if that prefix were encoded alone. A prefix that ends inside white
        space or a contraction is divided into words anew from there; one that ends inside a special string, from its start."""
        out = np.zeros(len(text) + 1, np.int64)
        total = at = 0
        prior, prior_total = "", 0  # the word before, and the count before that
        node, open_space = self.bpe.root, None  # state and count of the white space that ends at `at`
        for w in self.words(text):
            ends: list[int] = []
            if w in self.special:
                ends = [prior_total - total + self.totals([prior + w[:k]])[0] for k in range(1, len(w))] + [1]
            else:
                b = w.encode("utf-8", "surrogatepass")
                (_, _, count), = self.bpe.states([b])
                sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in w])
                ends = [count[s] for s in sizes]
                if w[0] == "'" and len(w) > 1:
                    ends[:-1] = [self.totals([w[:k]])[0] for k in range(1, len(w))]
            for k, c in enumerate(ends):
                out[at + k + 1] = total + c
                if SPACE.match(w[k]) and w not in self.special:
                    if open_space is None:
                        node, open_space = self.bpe.root, total + (ends[k - 1] if k else 0)
                    for x in w[k].encode():
                        node, more = node[2].get(x) or self.bpe.step(node, x)
                        open_space += more
                    out[at + k + 1] = open_space
                else:
                    open_space = None
            prior, prior_total = ("", total + ends[-1]) if w in self.special else (w, total)
            at += len(w)
            total += ends[-1]
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most budget tokens, for a text whose table isn't stored."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


@lru_cache(1)
def counter(path: str) -> PrefixCounter:
    """One per Python worker."""
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", extra: bool = True) -> DataFrame:
    """key, n_bytes, n_tokens and the prefix table (binary) of every row: the exact token count of each prefix of the text, as its changes
    from character to character, compressed. Questions on truncation and budgets are answered from it, without encoding again: see
    counts_of, tokens_at and fitting. n_tokens is the table's last count. extra: False leaves the table out once n_tokens is read from it.
    Null text counts as empty; rows that repeat are counted each; very long texts are counted whole; other columns are ignored; an empty
    table gives no rows. One narrow pass: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, text):
            arr = b.column(text).fill_null("")
            steps, edge = c.tables(arr)
            run_ = np.append(0, np.cumsum(steps, dtype=np.int64))
            size = np.diff(np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1]).astype(np.int64)
            cols = [b.column(key), pa.array(size), pa.array(run_[edge[1:]] - run_[edge[:-1]])]
            if extra:
                cols.append(pa.array([packed(steps[x:y]) for x, y in zip(edge, edge[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [key, "n_bytes", "n_tokens", *["table"] * extra])
            release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long" + ", table binary" * extra)


def counts_of(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, ... characters, from a stored table."""
    return np.append(0, np.cumsum(unpacked(table, np.int8), dtype=np.int64))


def tokens_at(table: bytes, characters: int) -> int:
    """Tokens of the prefix of so many characters (of the whole text if it is shorter)."""
    counts = counts_of(table)
    return int(counts[min(characters, len(counts) - 1)])


def fitting(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(counts_of(table) <= budget)[-1])


def within(tables: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """key, n_chars (of the longest prefix within the budget) and its n_tokens, from stored prefix tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [counts_of(t) for t in b.column("table").to_pylist()]
            n = [int(np.flatnonzero(c <= budget)[-1]) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array([int(c[i]) for c, i in zip(counts, n, strict=True)], pa.int64())], [key, "n_chars", "n_tokens"])

    return tables.select(key, "table").mapInArrow(run, f"{key} {tables.schema[key].dataType.simpleString()}, n_chars long, n_tokens long")


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, read from its prefix table; see prefix_tables."""
    return prefix_tables(docs, path, key, text, extra=False).withColumn("over_limit", F.col("n_tokens") > limit)
