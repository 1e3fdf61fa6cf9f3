"""Byte-level BPE against the library, on the whole smallest table, all characters, and very long pre-tokens."""

import base64
import hashlib
import os
import random
import time

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
import public_tokenizers as P  # noqa: E402

from foliant.llm import bytebpe, entry  # noqa: E402

SF = os.environ.get("FOLIANT_SF", "/root/testdata/sf0.001")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(c, t):
    return [x for part in c.encode(t) for x in part.tolist()]


def test_query(spark, library):
    rows = entry.queries()["op13_byte_bpe"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        want = np.array(library.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_characters(library):
    c = bytebpe.ByteBPE(PATH, P.PATTERN)
    chars = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for start in range(0, len(chars), 20_011):
        t = "".join(f"a{x} {x}{x}1" for x in chars[start : start + 20_011])
        assert ids(c, t) == library.encode_ordinary(t), hex(ord(chars[start]))


@pytest.mark.parametrize("seed", range(4))
def test_random(library, seed):
    r = random.Random(seed)
    c = bytebpe.ByteBPE(PATH, P.PATTERN)
    for _ in range(300):
        t = "".join(r.choice("aeinrst  \n\t'sd.,1é日 \U0001f600<|endoftext|>") for _ in range(r.randrange(200)))
        assert ids(c, t) == library.encode_ordinary(t)


def test_alike(library, monkeypatch):
    """Pre-tokens that share a list and those that have the queue to themselves get the same ids."""
    r, c = random.Random(3), bytebpe.ByteBPE(PATH, P.PATTERN)
    pieces = [bytes(r.choice(b"aaabetsin g\x00\xff") for _ in range(r.randrange(1, 40))) for _ in range(4000)] + [b"a" * n for n in range(1, 60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.merged_all(pieces)] == [c.merged(p) if p not in c.ranks else np.frombuffer(c.merged_all([p])[0], "<u4").tolist() for p in pieces]
    tops = [t.decode("utf-8", "ignore") for t in list(c.ranks)[::3]]
    words = [a + b for a, b in zip(tops, reversed(tops), strict=True)]
    assert [x.tolist() for x in c.encode_all(words)] == [library.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("unit", ["a", "abcd", " ", "\n ", "=-", "é", "random"])
def test_long_pretokens(library, unit):
    r = random.Random(5)
    t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)) if unit == "random" else unit * (60_000 // len(unit))
    c, began = bytebpe.ByteBPE(PATH, P.PATTERN), time.process_time()
    got = ids(c, t)
    took = time.process_time() - began
    assert got == library.encode_ordinary(t) and c.decode(np.array(got)) == t.encode()
    assert took < 3


def test_parts(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "CHUNK", 7)
    c = bytebpe.ByteBPE(PATH, P.PATTERN)
    for t in ("it's  a test\n\n of parts   that end 12 34 where they may, don't they?  ", "x" * 50, " " * 40 + "y z"):
        assert ids(c, t) == library.encode_ordinary(t)


def test_queue():
    r, q, held = random.Random(1), bytebpe.RankQueue(50_256), {}
    for _ in range(5000):
        if r.random() < 0.6 or not held:
            rank, place = r.choice([r.randrange(50_256), r.randrange(70)]), r.randrange(1000)
            q.push(rank, place)
            held.setdefault(rank, []).append(place)
        else:
            assert q.first() == min(held)
            assert q.take(min(held)) == sorted(held.pop(min(held)))
    assert q.first() == min(held, default=-1)


def test_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", None), (4, "twice", "y"), (4, "twice", "y"), (None, "no id", "z"), (5, "word " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bytebpe.digests(df, PATH, P.PATTERN).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(d, len(library.encode_ordinary(t or ""))) for d, t, _ in rows]
    out = bytebpe.encoded(df, PATH, P.PATTERN)
    assert [bytes(r.bytes).decode() for r in bytebpe.decoded(out, PATH, P.PATTERN).collect()] == [t or "" for _, t, _ in rows]
    odd = df.withColumnsRenamed({"doc_id": "ids", "text": "__text", "n_tokens": "a b"})
    assert [r["ids"] for r in bytebpe.digests(odd, PATH, P.PATTERN, "ids", "__text").collect()] == [r[0] for r in rows]
    for f in (bytebpe.digests, bytebpe.encoded):
        assert f(df.limit(0), PATH, P.PATTERN).collect() == []
    assert bytebpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH, P.PATTERN).first()["bytes"] == b""
