"""The registered queries over the smallest tables, against the libraries, SQL and brute force."""

import glob
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
import public_tokenizers as P  # noqa: E402

from foliant.llm import entry, licenses, media, tokens  # noqa: E402

SF = os.environ.get("FOLIANT_SF", "/root/testdata/sf0.001")
SPACES = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}, rows


def test_op1(spark, docs):
    got, rows = run(spark, "op1_license_scan")
    assert len(rows) == len(docs)
    for d, t in docs.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, x) for x in licenses.BASE for i in range(len(w)) if w[i : i + len(x.split())] == x.split()]
        r = got[d]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        base = sorted({licenses.BASE[x] for _, x in at})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op1_hits_are_linear():
    text = b"cc by " * 60_000
    f = licenses.scan(text)
    assert (f["n_base"], f["first_word"], f["last_word"]) == (60_000, 0, 119_998)
    assert licenses.scan(b"SPDX-License-Identifier: MIT / GPL-2.0")["labels"] == "mit"


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def plain_spans(t):
    """The base by its patterns alone."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda x: re.sub("[^0-9]", "", x)
    ok = {"email": lambda x: True, "ip": lambda x: all(int(p) < 256 for p in x.split(".")), "card": lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x)), "phone": lambda x: 10 <= len(digits(x)) <= 15}
    kinds = list(patterns)
    return sorted(((k, *m.span()) for k in kinds for m in re.finditer(patterns[k], t) if ok[k](m[0])), key=lambda x: (x[1], kinds.index(x[0])))


def test_op2(spark, docs):
    got, rows = run(spark, "op2_pii")
    assert len(rows) == len(docs)
    for d, t in docs.items():
        base = plain_spans(t)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans) and r.n_spans == len(spans)
    assert sum(r.n_spans for r in rows) >= sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)


def test_op3(spark, docs):
    from tokenizers import Tokenizer

    got, rows = run(spark, "op3_token_counts")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in docs.items()}
    assert len(rows) == len(docs)
    assert {d: (r.n_bytes, r.n_tokens, r.over_limit) for d, r in got.items()} == {d: (len(x.encode()), want[d], want[d] > 512) for d, x in docs.items()}


def test_prefix_tables(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    some = {d: x for d, x in docs.items() if d % 10 == 0} | {-1: "it's  two\n\nlines <|endoftext|> é日本", -2: ""}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    table = tokens.prefix_tables(df, P.path("byte_bpe_50k.json"))
    cut = {r.doc_id: r for r in tokens.within(table, 40).collect()}
    for r in table.collect():
        x = some[r.doc_id]
        for i in {0, 1, len(x) // 3, len(x) // 2, len(x) - 1, len(x)}:
            assert tokens.tokens_at(r.table, max(0, i)) == size(x[: max(0, i)])
        n = tokens.fitting(r.table, 40)
        assert size(x[:n]) <= 40 and (cut[r.doc_id].n_chars, cut[r.doc_id].n_tokens) == (n, size(x[:n]))
        assert n == len(x) or size(x[: n + 1]) > 40


def test_op5(spark, docs):
    got, rows = run(spark, "op5_quality_rules")
    assert len(rows) == len(docs)
    for d, t in docs.items():
        w = [x for x in SPACES.split(t) if x]
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        rep = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACES.sub("", line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep, failed)
        assert not (r.kept and failed)
    assert any(r.kept for r in rows)


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    _, rows = run(spark, "op6_best_fit_packing")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    of, sequences = {}, {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(of) == set(docs)
    for d, x in docs.items():
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(of[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(i, a, min(2048, len(ids) - a)) for i, a in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    for part in sequences.values():
        end = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    room = []
    for n in sorted((r.length for r in rows), reverse=True):
        fit = min((i for i, y in enumerate(room) if y >= n), key=lambda i: room[i], default=None)
        if fit is None:
            room.append(2048 - n)
        else:
            room[fit] -= n
    assert len(sequences) <= len(room)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.fetchall())


def test_op9(spark, docs):
    got, rows = run(spark, "op9_media_columns")
    files = {r.doc_id: r.media for r in media.stored_texts(entry.documents(spark, SF), with_media=True).collect()}
    assert len(rows) == len(docs)
    for d, t in docs.items():
        raw = t.encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[d]), hashlib.sha256(files[d]).hexdigest())
        assert media.read_back(bytes(files[d])).tobytes() == p
    assert sum(r.media_bytes for r in rows) < 0.6 * sum(r.payload_bytes for r in rows)


def test_op10(spark, docs):
    got, rows = run(spark, "op10_language_id")
    assert len(rows) == len(docs)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r.held_out == (d in set(held)) for d, r in got.items())
    right = [got[d].lang_pred == truth[d] for d in held if truth[d]]
    assert sum(right) >= 0.97 * len(right)


def test_language_contract(spark):
    from foliant.llm import language

    rows = [(i, f"{'the cat sat on the mat ' if i % 2 else 'le chat est sur le tapis '}{i}", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, "a", None), (101, "½", None), (102, "12 3", None), (103, None, None), (104, "日", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identified(df, language.learn(df)).collect()}
    assert got[100] in ("en", "fr") and got[104] in ("en", "fr")  # a letter is enough
    assert got[101] == got[102] == got[103] == "und"


def test_mixture_of_many_languages():
    from foliant.llm import language

    k, n = 6, 600
    p = np.full((n, k), 1e-6, np.float32)
    for i in range(n):
        p[i, i % k] = 0.01  # each n-gram belongs to one of six languages
    top, score, s = language.mixture(p, np.ones(n, np.float32))
    assert (s > 0.1).sum() == k and abs(score - 1 / k) < 0.02
