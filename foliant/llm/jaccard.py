"""N-gram Jaccard join (operator 7) by token-combination prefixes.

A document is its set of word 5-grams (tokens). Documents of one set are one vertex (its 64-bit signature). Two sets of similarity
t = 0.8 or more share so many tokens that, of all tokens in one global order (rare first), a prefix of each must share some:

* a set of n tokens may lack e = n - ceil(t n) of its tokens in a partner; e + 1 tokens of its prefix are enough to share one;
* tokens that occur in one set only cannot be shared, so they count towards the prefix but are not indexed;
* rare tokens are indexed singly. Frequent tokens (in FREQUENT sets or more) are dealt by hash into groups, and pairs of tokens of a
  group are indexed. A partner may share one token of each group unnoticed, so a group of c tokens counts c - 1, and the prefix is
  extended until tokens and groups count e + 1. How many groups there are depends on the size band of the pair, so a set is indexed
  under its own band and, for larger partners' sake, under the band below.

Sets that share an index entry are verified exactly on their shared tokens. In a few rounds each set is first compared with one most
central set of its entries (the one whose tokens are shared most, so the original of a family of copies), and components are formed; then
all pairs in an entry whose components still differ are compared. So a group of thousands of near copies costs a number of comparisons in
proportion to its size, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, n_buckets, release, slices, stored
from .runs import FAN, cuts, joined, packed, salted, unpacked, widths
from .wordstream import LOWERED, Words, mix

SHINGLE, TENTHS = 5, 8
#: Tokens in so many sets or more are a frequent class; their groups hold about a GROUP-th part of a set's size.
FREQUENT, GROUP = 12, 8
#: Text bytes a slice and a range of tokens stand for.
SLICE, RANGE = 3 << 20, 6 << 20
#: A token that so many sets of one run hold is hot; MANY stands for the number of its sets.
HOT, MANY = 64, 1 << 20
#: Longs in a sketch of a set's shared tokens.
WORDS = 16
#: Rounds in which a set is compared with one central set, before all pairs that are left.
ROUNDS = 3
U = np.uint64
KINDS = {"sign": U, "size": np.uint32, "token": U, "freq": np.uint32}


def least_common(n: int) -> int:
    """ceil(0.8 n)"""
    return -(-n * TENTHS // 10)


class Sets:
    """Sets of a batch: sorted distinct tokens, where each document's begin, and signatures (0 for an empty set)."""

    def __init__(self, arr: pa.Array):
        w = Words(arr)
        g, at = w.windows(w.hashes(LOWERED), SHINGLE, short=True)
        edge = np.searchsorted(at, w.first)
        g = g.copy()
        for i in range(len(arr)):
            g[edge[i] : edge[i + 1]].sort()
        keep = np.ones(len(g), bool)
        keep[1:] = g[1:] != g[:-1]
        keep[edge[:-1][edge[:-1] < len(g)]] = True
        self.tokens = g[keep]
        total = np.append(0, np.cumsum(keep))
        self.edge = total[edge]
        self.size = np.diff(self.edge)
        run = np.append(U(0), np.cumsum(mix(self.tokens, 11)))
        self.sign = mix(run[self.edge[1:]] - run[self.edge[:-1]], 5) ^ self.size.astype(np.uint64)
        self.sign[self.size == 0] = 0


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sign of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            s = Sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.size.astype(np.int64)), pa.array(s.sign.view(np.int64))], ["doc_id", "n_shingles", "sign"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, sign long")


POSTED = pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("signs", "sizes", "token", "set"))])
POSTINGS = "bucket long, signs binary, sizes binary, token binary, set binary"
SHARED = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in ("sign", "size", "token", "freq"))])


def posted(bucket: np.ndarray, cut: np.ndarray, token: np.ndarray, sign: np.ndarray, size: np.ndarray) -> pa.Table:
    """A row for each bucket, of the postings from its cut to the next."""
    rows = []
    for i in range(len(bucket)):
        part = slice(cut[i], cut[i + 1])
        used, first, back = np.unique(sign[part], return_index=True, return_inverse=True)
        rows.append((packed(used), packed(size[part][first].astype(np.uint32)), packed(token[part]), packed(back.astype(np.uint32))))
    return pa.Table.from_arrays([pa.array(bucket, pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(4))], schema=POSTED)


def dealt(token: np.ndarray, sign: np.ndarray, size: np.ndarray, width: int, least: int) -> pa.Table:
    """Postings of one run, sorted by token and set, by ranges of the token. A token that `least` sets of the run hold, or that is marked as
    held so elsewhere, is known to be shared: its postings needn't meet, go by ranges of the set (buckets below 0), and leave a mark (set
    0). So a token that every document holds fills no range: each run keeps fewer than `least` of its postings, and merging runs sheds more."""
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(token)))
    hot = (n >= least) | (sign[at] == 0)
    often = np.repeat(hot, n)
    t, s, z = token[~often], sign[~often], size[~often]
    if not hot.any():
        return posted(*cuts(t, width), t, s, z)
    marks = token[at][hot]
    t, s, z = np.append(t, marks), np.append(s, np.zeros(len(marks), U)), np.append(z, np.zeros(len(marks), z.dtype))
    o = np.argsort(t, kind="stable")
    cold = posted(*cuts(t[o], width), t[o], s[o], z[o])
    often &= sign != 0
    o = np.argsort(sign[often], kind="stable")
    t, s, z = token[often][o], sign[often][o], size[often][o]
    bucket, cut = cuts(s, width)
    return pa.concat_tables([cold, posted(-1 - bucket, cut, t, s, z)])


def postings(docs: DataFrame, width: int) -> DataFrame:
    """Tokens of every slice's distinct sets, dealt() in `width` ranges, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            s = Sets(b.column("text"))
            once = np.zeros(len(s.size), bool)
            once[np.unique(s.sign, return_index=True)[1]] = True
            of = np.repeat(np.arange(len(s.size)), s.size)
            use = once[of]
            token, of = s.tokens[use], of[use]
            o = np.argsort(token)
            of = of[o]
            yield from dealt(token[o], s.sign[of], s.size[of], width, HOT).to_batches()
            release()

    return docs.select("text").mapInArrow(run, POSTINGS)


def merged(table: pa.Table, by_token: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, set and size of the postings of several runs, sorted by token and set (or set and token), each posting once."""
    at = [unpacked(x, np.uint32) for x in table.column("set").to_pylist()]
    sign = np.concatenate([unpacked(x, U)[i] for x, i in zip(table.column("signs").to_pylist(), at, strict=True)])
    size = np.concatenate([unpacked(x, np.uint32)[i] for x, i in zip(table.column("sizes").to_pylist(), at, strict=True)])
    token = joined(table.column("token").to_pylist(), U)
    o = np.lexsort((sign, token) if by_token else (token, sign))
    token, sign, size = token[o], sign[o], size[o]
    new = np.append(True, (token[1:] != token[:-1]) | (sign[1:] != sign[:-1]))
    return token[new], sign[new], size[new]


def shared(post: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """Tokens that occur in two sets or more, with that number (MANY for hot ones), dealt by set: (part, sign, size, token, freq), packed."""
    wide = widths(buckets, fan)

    def finer(width: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            if table.column("bucket")[0].as_py() >= 0:
                return dealt(*merged(table), width, HOT)
            token, sign, size = merged(table, False)
            bucket, cut = cuts(sign, width)
            return posted(-1 - bucket, cut, token, sign, size)

        return run

    def finer_sets(width: int) -> Callable:
        return lambda table: by_set(*(joined(table.column(k).to_pylist(), KINDS[k]) for k in KINDS), width)

    def gather(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            token, sign, size = merged(table, False)
            freq = np.full(len(token), MANY, np.uint32)
        else:
            token, sign, size = merged(table)
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            n = np.diff(np.append(at, len(token)))
            freq = np.repeat(np.where(sign[at] == 0, MANY, n), n).astype(np.uint32)
            use = (freq > 1) & (sign != 0)
            sign, size, token, freq = sign[use], size[use], token[use], freq[use]
        return by_set(sign, size, token, freq, wide[0])

    def by_set(sign: np.ndarray, size: np.ndarray, token: np.ndarray, freq: np.ndarray, width: int) -> pa.Table:
        o = np.argsort(sign, kind="stable")
        part, cut = cuts(sign[o], width)
        rows = [[packed(x[o[cut[i] : cut[i + 1]]]) for i in range(len(part))] for x in (sign, size, token, freq)]
        release()
        return pa.Table.from_arrays([pa.array(part, pa.int64()), *(pa.array(x, pa.binary()) for x in rows)], schema=SHARED)

    kinds = "part long, sign binary, size binary, token binary, freq binary"
    for before, width in zip(wide, wide[1:], strict=False):
        post = salted(post, "bucket", "token", buckets, before).applyInArrow(finer(width), POSTINGS)
    found = post.groupBy("bucket").applyInArrow(gather, kinds)
    for before, width in zip(wide, wide[1:], strict=False):
        found = salted(found, "part", "token", buckets, before).applyInArrow(finer_sets(width), kinds)
    return found


def sketch(tokens: np.ndarray) -> list[int]:
    """Parities of the tokens that fall on each of 64 * WORDS bits. The bits in which two sketches differ are at most the tokens in which
    the sets differ, so it rules pairs out without error."""
    h = mix(tokens, 61)
    odd = np.bincount((h % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def band(n: int) -> int:
    """Size band: sets of similarity 0.8 have equal or neighbouring bands."""
    return int(np.floor(np.log(n) / np.log(1.25) + 1e-9))


def entries(n: int, tokens: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Index entries of a set of n tokens whose shared tokens, in the global order (freq, token), are given. Empty if it can have no
    partner."""
    if len(tokens) < least_common(n) or n < 4:
        return np.zeros(0, np.uint64)
    need = n - least_common(n) + 1 - (n - len(tokens))  # tokens of its own count first
    if need <= 0:  # cannot be: then it lacks more than it may
        return np.zeros(0, np.uint64)
    rare = int(np.searchsorted(freq, FREQUENT))
    out = [mix(tokens[: min(rare, need)], 21)]
    need -= rare
    if need > 0:
        often = tokens[rare:]
        for b in (band(n), band(n) - 1):
            groups = max(1, int(1.25**b) // GROUP)
            group = (mix(often, 31 + b) % U(groups)).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            counts = np.ones(len(often), np.int64)
            counts[first] = 0  # the first of a group doesn't count
            done = np.cumsum(counts)
            end = int(np.searchsorted(done, need)) + 1
            g, t = group[:end], often[:end]
            o = np.argsort(g, kind="stable")
            g, t = g[o], t[o]
            i = np.arange(len(g))
            step = 1
            while True:  # pairs at distance 1, 2, ... within a group
                a = i[: len(i) - step][g[: len(g) - step] == g[step:]] if step < len(g) else i[:0]
                if not len(a):
                    break
                x, y = np.minimum(t[a], t[a + step]), np.maximum(t[a], t[a + step])
                out.append(mix(mix(x, 41 + b) * U(3) + mix(y, 43)))
                step += 1
    return np.unique(np.concatenate(out))


def indexed(found: DataFrame) -> DataFrame:
    """From shared(): (sign, n, s, entry, central) rows of sets that may have a partner (s: how many tokens
    are shared; central: mean frequency of their tokens, in
    thousandths), and (sign, n, tokens) with their sorted shared tokens."""

    def gather(table: pa.Table) -> pa.Table:
        sign, size, token, freq = (joined(table.column(k).to_pylist(), KINDS[k]) for k in KINDS)
        o = np.lexsort((token, freq, sign))
        o = o[np.append(True, (sign[o[1:]] != sign[o[:-1]]) | (token[o[1:]] != token[o[:-1]]))]  # hot postings of several runs
        sign, size, token, freq = sign[o], size[o], token[o], freq[o]
        at = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        end = np.append(at[1:], len(sign))
        signs, sizes, sharing, all_entries, central, blobs, marks = [], [], [], [], [], [], []
        for a, b in zip(at[(end - at) * 10 >= size[at] * TENTHS], end[(end - at) * 10 >= size[at] * TENTHS], strict=True):
            e = entries(int(size[a]), token[a:b], freq[a:b])
            if len(e):
                signs += [sign[a]] * (len(e) + 1)
                sizes += [size[a]] * (len(e) + 1)
                sharing += [b - a] * (len(e) + 1)
                all_entries += [pa.array(e.view(np.int64)), pa.array([None], pa.int64())]
                central += [int(freq[a:b].sum() * 1000 // int(size[a]))] * (len(e) + 1)
                marks += [None] * len(e) + [sketch(token[a:b])]
                blobs += [None] * len(e) + [packed(np.sort(token[a:b]))]
        release()
        return pa.Table.from_arrays([pa.array(np.array(signs, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int64)), pa.array(np.array(sharing, np.int64)), pa.concat_arrays(all_entries) if all_entries else pa.array([], pa.int64()), pa.array(central, pa.int64()), pa.array(blobs, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], schema=OUT)

    OUT = pa.schema([("sign", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("entry", pa.int64()), ("central", pa.int64()), ("tokens", pa.binary()), ("sketch", pa.list_(pa.int64()))])
    return found.groupBy("part").applyInArrow(gather, "sign long, n long, s long, entry long, central long, tokens binary, sketch array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= 80 * union. Unshared tokens cannot be in an intersection, so shared ones do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, before, mine = [], None, None
            for a, n, x, m, y in zip(*(b.column(k).to_pylist() for k in ("a", "n", "x", "m", "y")), strict=True):
                if a != before:
                    before, mine = a, unpacked(x, np.uint64)
                both = len(mine) + len(t := unpacked(y, np.uint64)) - len(np.unique(np.concatenate([mine, t])))
                ok.append(10 * both >= TENTHS * (n + m - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
            release()

    left = sets.select(F.col("sign").alias("a"), "n", F.col("tokens").alias("x"))
    right = sets.select(F.col("sign").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "n", "x", "b", "m", "y").mapInArrow(run, "a long, b long")


def links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between signatures of different sets, enough to connect what the join connects."""
    buckets = n_buckets(docs, RANGE)
    index = stored(indexed(shared(postings(docs, widths(buckets)[0]), buckets)), "sets")
    sets = index.where("entry is null").select("sign", "n", "tokens")
    entry = index.where("entry is not null").select("entry", "sign", "n", "s", "central")
    member = stored(entry.join(entry.groupBy("entry").count().where("count > 1").select("entry"), "entry"), "members")

    def fits(n: str, s: str, m: str, t: str) -> Column:
        """Whether sets of n and m tokens, of which s and t are shared with any other set, can be similar: an intersection isn't larger
        than s, t, n or m, and must be 8/18 of n + m at least."""
        return F.least(n, s, m, t) * (10 + TENTHS) >= (F.col(n) + F.col(m)) * TENTHS


    def labelled(label: DataFrame | None) -> DataFrame:
        if label is None:
            return member.withColumn("label", F.col("sign"))
        return member.join(label.withColumnRenamed("id", "sign"), "sign", "left").withColumn("label", F.coalesce("label", "sign"))

    def mixed(m: DataFrame) -> DataFrame:
        """The most central member of each entry whose members aren't known to be of one component."""
        return m.groupBy("entry").agg(F.max(F.struct("central", "sign", "n", "s", "label")).alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("entry", "top")

    found = tried = label = None
    for _ in range(ROUNDS):
        m = labelled(label)
        near = m.join(mixed(m), "entry").select("sign", "n", "s", "label", "top.central", F.col("top.sign").alias("a"), F.col("top.n").alias("an"), F.col("top.s").alias("as"), F.col("top.label").alias("al"))
        near = near.where("label <> al").where(fits("n", "s", "an", "as"))
        if tried is not None:
            near = near.join(tried.withColumnRenamed("b", "sign"), ["sign", "a"], "left_anti")
        pairs = stored(near.groupBy("sign").agg(F.max(F.struct("central", "a")).alias("best")).select("best.a", F.col("sign").alias("b")), "pairs")
        new = stored(verified(pairs, sets), "near")
        tried, found = (pairs, new) if found is None else (tried.unionByName(pairs), found.unionByName(new))
        label = stored(components(found), "labels")
    m = labelled(label)
    marks = [F.col("sketch")[i].alias(f"w{i}") for i in range(WORDS)]
    m = m.join(mixed(m).select("entry"), "entry", "left_semi").join(index.where("entry is null").select("sign", *marks), "sign")
    m = stored(m, "rest")
    p = m.select("entry", F.col("sign").alias("p"), F.col("n").alias("pn"), F.col("s").alias("ps"), F.col("label").alias("pl"), *(F.col(f"w{i}").alias(f"v{i}") for i in range(WORDS)))
    differ = reduce(add, (F.bit_count(F.col(f"v{i}").bitwiseXOR(F.col(f"w{i}"))) for i in range(WORDS)))
    # tokens in which two sets differ: those of their own, and shared ones; at most a ninth of all if they are similar
    alike = (differ + F.col("pn") - F.col("ps") + F.col("n") - F.col("s")) * (10 + TENTHS) <= (F.col("pn") + F.col("n")) * (10 - TENTHS)
    pairs = p.join(m, "entry").where("p < sign and pl <> label").where(fits("pn", "ps", "n", "s") & alike).select(F.col("p").alias("a"), F.col("sign").alias("b")).distinct()
    either = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(found.unionByName(verified(pairs.join(either, ["a", "b"], "left_anti"), sets)), "links")


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, sign of every row, and of the signatures that other rows share or link with: sign, component_id and whether
    it is the one that stays of its component (that of the smallest id; ids that are null come last)."""
    rows = stored(signatures(docs), "signatures")
    heads = rows.where("sign <> 0").groupBy("sign").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    label = components(links(docs))
    of = heads.join(label.withColumnRenamed("id", "sign"), "sign", "left").withColumn("label", F.coalesce("label", "sign"))
    linked = stored(of.where("copies > 1 or label <> sign").unionByName(of.join(label.select("label").distinct(), "label", "left_semi").where("copies = 1 and label = sign").select(*of.columns)), "linked")
    best = linked.groupBy("label").agg(F.min(F.struct(F.col("head").isNull().alias("none"), "head", "sign")).alias("best"))
    return rows, linked.select("sign", "label").join(best, "label").select("sign", F.col("best.head").alias("component_id"), (F.col("sign") == F.col("best.sign")).alias("stays"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) of every row of docs (doc_id, text).
    Null and empty texts and texts without words: an empty set, linked with nothing. Rows that repeat are linked. A null doc_id is
    ignored as a label unless no linked row has one. Fewer than five words count as one token. Very long texts count whole; other columns are
    ignored. Empty table: no rows."""
    rows, known = linked_sets(docs)
    out = rows.join(known.select("sign", "component_id"), "sign", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def signed(docs: DataFrame) -> DataFrame:
    """docs with the signature of each row's text as __sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(Sets(b.column("text")).sign.view(np.int64))], [*b.schema.names, "__sign"])
            release()

    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns] + ["__sign long"])
    return docs.mapInArrow(run, kinds)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: one row of each component, of the smallest id (an id that is null comes last), and all rows
    linked with nothing, whatever ids they share. What is known of signatures is broadcast up to a checked number."""
    rows, known = linked_sets(docs.select("doc_id", "text"))
    known = stored(known.select(F.col("sign").alias("__sign"), F.col("component_id").alias("__first"), F.col("stays").alias("__stays")), "known")
    few = (lambda df: F.broadcast(df)) if known.count() <= BROADCAST_IDS else (lambda df: df)
    # of a component, the rows of the set that stays and of its smallest id: equal sets, so any of them does
    kept = signed(docs).join(few(known), "__sign", "left").where("__stays is null or (__stays and doc_id <=> __first)")
    twice = rows.withColumnRenamed("sign", "__sign").join(few(known.where("__stays")), "__sign").where("doc_id <=> __first").groupBy("__sign").count().where("count > 1").select("__sign")
    twice = stored(twice, "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # rows of one id and one set: the smallest text stays (then the smallest of what else is there), however often the job runs
    of = kept.join(few(twice), "__sign", "left_semi").withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    one = of.groupBy("__sign").agg(F.min_by("__row", F.struct("text", F.to_json("__row"))).alias("__row")).select("__sign", "__row.*")
    return kept.join(few(twice), "__sign", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
