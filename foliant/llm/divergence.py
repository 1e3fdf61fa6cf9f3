"""Source divergence audit (operator 11): how far the sources of a language differ in their terms, and by which terms.

A language's terms are dealt into tiles by the hash of the term; a tile has the counts of its terms in all groups (sources) of the
language. Terms that stand in many groups of it are heavy: their counts become a dense matrix (terms by groups), and differences of all
pairs are sums over its rows. The others are light: every pair first gets the difference that absent terms have, then corrections for the
groups that hold a term (by how often each count occurs), and for the pairs of groups in which both hold it (along the postings). Both
partial sums are integers, so their total is exact."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, release, slices, stored

#: Fixed values of the measure: documents that a kept term stands in, smoothing, unit of a share, ranks of terms.
LEAST, SMOOTH, UNIT, TOP = 10, 2, 1_000_000_000, 10
#: A term is heavy if it stands in more than this share of a language's groups.
HEAVY = 0.25
#: Postings of a tile (at least; with more groups as many as there are pairs of them), and cells of a matrix that are worked on at once.
TILE, CELLS = 300_000, 1 << 21
#: Terms and bytes of them that a task counts before it hands the counts on.
HELD, HELD_BYTES = 200_000, 16 << 20
#: Bytes of text that are divided at once.
PART = 1 << 22
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """Terms in parts: runs of ASCII letters (lower-cased) and of bytes that aren't ASCII."""
    raw, at = raw.lower(), 0
    while at < len(raw):
        cut = OTHER.search(raw, at + PART) if len(raw) - at > PART else None
        end = cut.start() if cut else len(raw)
        yield TERM.findall(raw, at, end)
        at = end


def counted(docs: DataFrame, most: int = HELD) -> DataFrame:
    """lang, source, term (binary), n, docs: summed per task as far as its memory allows. A group without a term has a row of null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        found: dict[tuple[str, str], Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in counts.items():
                keys, m = list(n), max(1, len(n))
                d = found[lang, source]
                cols = [pa.array([lang] * m), pa.array([source] * m), pa.array(keys or [None], pa.binary()), pa.array(list(n.values()) or [0], pa.int64()), pa.array([d[k] for k in keys] or [0], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            counts.clear()
            found.clear()
            release()

        size = held = 0
        for b in slices(batches):
            for lang, source, t in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), byte_texts(b.column("text")), strict=True):
                n, d = counts.setdefault((lang, source), Counter()), found.setdefault((lang, source), Counter())
                before, own = len(n), set()
                for part in terms_of(t):
                    n.update(part)
                    own.update(part)
                d.update(own)
                size += len(n) - before
                held += sum(map(len, own)) if len(n) > before else 0
                if size > most or held > HELD_BYTES:
                    yield from rows()
                    size = held = 0
        yield from rows()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / whole), by long division in steps of a thousand, so that no product passes 64 bits."""
    left = np.asarray(count, np.int64) + SMOOTH
    whole = np.asarray(whole, np.int64)
    out, left = left // whole, left % whole
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)): below 2^63, as shares are a thousand millions at most (and two, from smoothing)."""
    d = p - q
    return d * d // (p + q)


def pair_sums(term: np.ndarray, group: np.ndarray, n: np.ndarray, whole: np.ndarray, terms: int, heavy: float = HEAVY, cells: int = CELLS) -> np.ndarray:
    """For postings (term number, group number, n > 0), sorted by term, of `terms` terms, and each group's denominator `whole`: the sums of
    differences over these terms of all pairs of groups, as a symmetric matrix."""
    k = len(whole)
    out = np.zeros((k, k), np.int64)
    spread = np.bincount(term, minlength=terms)
    dense = spread > max(1, heavy * k)
    # heavy: tiles of terms by groups
    row = np.cumsum(dense) - 1
    some = dense[term]
    x, g, c = row[term[some]], group[some], n[some]
    step = max(1, cells // k)
    for low in range(0, int(dense.sum()), step):
        a, b = np.searchsorted(x, [low, low + step])
        tile = np.zeros((min(step, int(dense.sum()) - low), k), np.int64)
        tile[x[a:b] - low, g[a:b]] = c[a:b]
        tile = shares(tile, whole)
        for i in range(k - 1):
            out[i, i + 1 :] += difference(tile[:, i : i + 1], tile[:, i + 1 :]).sum(0)
    # light: absent everywhere, then corrections
    light = terms - int(dense.sum())
    none = shares(np.zeros(k, np.int64), whole)
    apart = difference(none[:, None], none[None, :])
    both = light * apart
    x, g, c = term[~some], group[~some], n[~some]
    p = shares(c, whole[g])
    by = np.argsort(g, kind="stable")
    edge = np.searchsorted(g[by], np.arange(k + 1))
    for i in range(k):  # terms of group i against groups without them
        value, times = np.unique(p[by[edge[i] : edge[i + 1]]], return_counts=True)
        for low in range(0, len(value), step):
            v, t = value[low : low + step, None], times[low : low + step, None]
            gain = ((difference(v, none[None, :]) - apart[i][None, :]) * t).sum(0)
            gain[i] = 0
            both[i] += gain
            both[:, i] += gain
    far = 1
    while far < len(x):  # postings of one term, `far` places apart
        at = np.flatnonzero(x[far:] == x[:-far])
        if not len(at):
            break
        i, j = g[at], g[at + far]
        fix = difference(p[at], p[at + far]) - difference(p[at], none[j]) - difference(none[i], p[at + far]) + apart[i, j]
        low, high = np.minimum(i, j), np.maximum(i, j)
        np.add.at(out, (low, high), fix)
        far += 1
    out += np.triu(both, 1)
    return out + np.triu(out, 1).T


PARTIAL = "lang string, source string, part string, item string, value long"


def _tile(top: int):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: postings (lang, source, term, n); right: all groups of the language (source, whole, lang_whole)."""
        lang = right["lang"][0].as_py()
        names = right["source"].to_pylist()
        whole = right["whole"].to_numpy()
        number = {s: i for i, s in enumerate(names)}
        rows: list[tuple] = []
        sums = np.zeros((len(names), len(names)), np.int64)
        if len(left):
            words = left["term"].combine_chunks().dictionary_encode()
            term = words.indices.to_numpy().astype(np.int64)
            group = np.array([number[s] for s in left["source"].to_pylist()])
            n = left["n"].to_numpy()
            order = np.lexsort((group, term))
            term, group, n = term[order], group[order], n[order]
            sums = pair_sums(term, group, n, whole, len(words.dictionary))
            total = np.zeros(len(words.dictionary), np.int64)
            np.add.at(total, term, n)
            p, q = shares(n, whole[group]), shares(total, right["lang_whole"][0].as_py())[term]
            ahead = np.flatnonzero(p > q)
            value = difference(p[ahead], q[ahead])
            place = np.empty(len(words.dictionary), np.int64)  # of each term among the others, by bytes
            place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
            order = np.lexsort((place[term[ahead]], -value, group[ahead]))
            ahead, value = ahead[order], value[order]
            begin = np.searchsorted(group[ahead], np.arange(len(names) + 1)).tolist()
            best = [z for i in range(len(names)) for z in range(begin[i], min(begin[i] + top, begin[i + 1]))]
            item = words.dictionary.take(pa.array(term[ahead[best]])).cast(pa.string()).to_pylist()
            rows += [(lang, names[i], "term", w, v) for i, w, v in zip(group[ahead[best]].tolist(), item, value[best].tolist(), strict=True)]
        rows += [(lang, a, "pair", b, v) for i, a in enumerate(names) for j, (b, v) in enumerate(zip(names, sums[i].tolist(), strict=True)) if i != j]
        release()
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["lang", "source", "part", "item", "value"])

    return run


def audited(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, tile: int = TILE, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, value the sum of differences over the terms
    that the language keeps (those in `least` of its documents), all ranks. Part `term`: the `top` kept terms that the source has more of
    than its language. Null languages, sources and texts are empty ones; a group without a term, even one of a language that keeps none, has
    its pairs (value 0 there); rows that repeat count each; very long texts are counted whole, part by part; ties rank by the item's bytes;
    other columns are ignored, whatever their names; an empty table gives no rows. Exchanges: counts by group and term, summed in the
    tasks first; postings by tile; partial sums by pair."""
    c = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    counts = counted(docs.select(c(lang).alias("lang"), c(source).alias("source"), c(text).alias("text")), held)
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    postings = stored(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "postings")
    v = postings.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.count("*").alias("m"), F.sum("n").alias("lang_n"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(v, "lang", "left")
    k = F.count("*").over(Window.partitionBy("lang"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    tiles = F.greatest(F.lit(1), F.ceil(zero("m") / F.greatest(F.lit(tile).cast("double"), k.cast("double") * k)).cast("int"))
    groups = groups.select("lang", "source", (zero("own") + 2 * zero("v")).alias("whole"), (zero("lang_n") + 2 * zero("v")).alias("lang_whole"), tiles.alias("tiles"))
    groups = stored(groups, "groups")
    dealt = postings.join(groups.select("lang", "tiles").distinct(), "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")).drop("tiles")
    every = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(F.col("lang").alias("lang"), "source", "whole", "lang_whole", "at")
    parts = stored(dealt.groupBy("lang", "tile").cogroup(every.groupBy("lang", "at")).applyInArrow(_tile(top), PARTIAL), "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
