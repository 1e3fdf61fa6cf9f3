"""Operators against brute force, the libraries, round trips, and the edge cases that their docstrings define."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
import public_tokenizers as P  # noqa: E402

from foliant.llm import common, jaccard, language, licenses, media, packing, pieces, pii, quality, substring, tokens, webp  # noqa: E402

EDGE = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a", "x"), (4, "a", "x"), (5, "word " * 60_000, "x"), (6, "é日本 ½ \U0001f600", None), (None, "no id here", "x")]
SCHEMA = "doc_id long, text string, n_words string"  # an extra column whose name a result has too


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, edge, empty):
    docs = edge.limit(0) if empty else edge
    narrow = docs.select("doc_id", "text")
    out = {
        "licenses": licenses.licenses(docs), "pii": pii.personal(narrow), "tokens": tokens.token_counts(docs, P.path("byte_bpe_50k.json")), "pieces": pieces.piece_digest(docs, P.path("piece_bpe_32k.model")), "quality": quality.judge(docs, None),
        "packing": packing.pack_documents(docs, P.path("word_bpe_49k.json")), "jaccard": jaccard.classes(docs), "substring": substring.removed(narrow, digest=True), "media": media.stored_texts(docs), "language": language.identified(docs, None),
    }
    for name, df in out.items():
        rows = df.collect()
        assert len({r["doc_id"] for r in rows}) == (0 if empty else 7), name
        if name != "packing":
            assert len(rows) == (0 if empty else len(EDGE)), name
    if not empty:
        j = {r["doc_id"]: r for r in out["jaccard"].collect()}
        assert (j[1]["n_shingles"], j[3]["n_shingles"], j[4]["n_shingles"], j[5]["n_shingles"]) == (0, 0, 1, 1)
        assert [r["over_limit"] for r in out["tokens"].where("doc_id = 5").collect()] == [True]
        gone = out["substring"].where("doc_id = 5").first()
        assert gone["n_removed"] == 60_000 - 1 and gone["n_words"] == 60_000


def family(r, size, base, edits):
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(8)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    texts = []
    for n, size, edits in ((40, 30, 2), (90, 40, 3), (25, 20, 1), (7, 10, 1), (5, 6, 1)):
        texts += family(r, size, [word() for _ in range(n)], edits)
    passage = " ".join(word() for _ in range(30))
    texts += [" ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(r.randint(0, 9))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(40)] + ["Same Text here now OK"] * 3 + ["same text here now ok", None, ""]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent", [3, 12])
def test_jaccard(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(frequent)
    got = {r[0]: (r[1], r[2]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in words(t)]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "EDGES", most)  # a few edges a task: star rounds; many: one contraction
    r = random.Random(most)
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (300, 301), (300, 301)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((k, v) for k, v in top.items() if k != v)
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_combinations_find_every_pair():
    r = np.random.default_rng(4)
    for n in (5, 12, 60, 200):
        for _ in range(60):
            pool = r.integers(1, 2**63, n * 2, dtype=np.uint64)
            freq = dict(zip(pool.tolist(), r.integers(2, 40, n * 2).tolist(), strict=True))
            x = set(r.permutation(pool)[:n].tolist())
            y = set(x)
            while True:  # take tokens out of y or put others in, as long as they stay similar
                z = set(y)
                z.discard(r.choice(sorted(z))) if r.random() < 0.5 else z.add(int(r.choice(pool)))
                if 10 * len(x & z) < 8 * len(x | z):
                    break
                y = z
                if r.random() < 0.02:
                    break
            e = []
            for s in (x, y):
                t = sorted(s, key=lambda k: (freq[k], k))
                e.append(set(jaccard.entries(len(s), np.array(t, np.uint64), np.array([freq[k] for k in t])).tolist()))
            assert e[0] & e[1] or min(len(x), len(y)) < 4


def brute_windows(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            seen.add(key)
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE", 3000)  # many runs
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in substring.removed(docs, digest=True, buckets=5).collect()}
    assert got == {d: (n, g, hashlib.sha256(k).hexdigest()) for d, (n, g, k) in brute_windows(rows).items()}
    old, new = docs.where("doc_id < 90"), docs.where("doc_id >= 90")
    history = substring.compacted(substring.runs(old, 5, old=True))
    got = {r[0]: tuple(r[1:]) for r in substring.removed(new, digest=True, buckets=5, history=history).collect()}
    assert got == {d: (n, g, hashlib.sha256(k).hexdigest()) for d, (n, g, k) in brute_windows(rows).items() if d >= 90}


def test_repeats():
    r = random.Random(1)
    for _ in range(300):
        w = [r.choice(["a", "b", "c"]).encode() for _ in range(r.randint(0, 40))]
        count = {}
        for i in range(len(w) - 4):
            count.setdefault(tuple(w[i : i + 5]), []).append(i)
        hit = {j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        assert quality.repeats(w) == len(hit)


def test_tokens_and_pieces():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    r = random.Random(2)
    alpha = ["a", "the", " ", "  ", "\n", "'s", "é", "12", "²", "<|endoftext|>", "<|endo", "!", "日本", "▁", "ing", " of", "<s>", "\r\n", "\x85"]
    texts = ["".join(r.choice(alpha) for _ in range(r.randint(0, 25))) for _ in range(500)]
    t, c = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.PrefixCounter(P.path("byte_bpe_50k.json"))
    size = lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]
    assert c.totals(texts) == size(texts)
    for x in texts[:60]:
        assert c.prefix_counts(x).tolist() == size([x[:i] for i in range(len(x) + 1)])
        assert size([x[: c.longest_prefix(x, 5)]])[0] <= 5
    p, sp = pieces.Pieces(P.path("piece_bpe_32k.model")), SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = p.encode(texts)
    assert [x.tolist() for x in ids] == sp.encode(texts)
    assert all(p.decode(i).decode() == x for i, x in zip(ids, texts, strict=True) if "▁" not in x)


def test_unigram_viterbi():
    scores = {"a": -1.0, "b": -1.5, "ab": -1.2, "aba": -3.0, "ba": -2.0}
    for w, best, _ in pieces.unigram_states(scores, sorted(["ab", "aba", "abab", "b", "x"]), -10.0):
        if w == "abab":
            assert best[-1] == pytest.approx(-2.4)
        if w == "x":
            assert best[-1] == -10.0


def test_packing():
    r = random.Random(3)
    for _ in range(20):
        counts = {}
        for _ in range(r.randint(1, 200)):
            n = r.randint(1, 64)
            counts[n] = counts.get(n, 0) + 1
        sequences = packing.plan(counts, 64)
        used = {}
        for lengths, times in sequences:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
        room = []  # best-fit decreasing, piece by piece
        for x in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((i for i, y in enumerate(room) if y >= x), key=lambda i: room[i], default=None)
            if fit is None:
                room.append(64 - x)
            else:
                room[fit] -= x
        assert sum(t for _, t in sequences) <= len(room)
    assert sum(packing.fullest({30: 5, 20: 2, 7: 3}, 64)) == 64


def test_webp():
    r = np.random.default_rng(1)
    for i in range(45):
        h, w, k = int(r.integers(1, 20)), int(r.integers(1, 30)), int(r.choice([1, 2, 3, 9, 40]))
        p = r.integers(0, 2**32, k, dtype=np.uint32)[r.integers(0, k, (h, w))]
        data = webp.encode(p, predictor=[None, *range(14)][i % 15], multipliers=[None, 0xFF1203F0][i % 2], green=i % 4 > 1, palette=i % 5 == 0, cache_bits=[0, 1, 5, 11][i % 4], groups=[1, 2, 3][i % 3])
        assert (webp.decode(data) == p).all()
    for t in (b"", b"a", b"a" * 576, bytes(range(256)) * 9):
        assert media.read_back(media.stored_form(media.payload(t))).tobytes() == media.payload(t)
    with pytest.raises(webp.BadStream):
        webp.decode(data[:40] + data[-4:])


def test_pii():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) < 256 for x in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    r = random.Random(3)
    alpha = [*"0123456789" * 3, *"..@@ab%+-() \n_é", "192.168.1.1", "a@b.co", "4111111111111111", "+1 (743) 555-3824"]
    for _ in range(4000):
        t = "".join(r.choice(alpha) for _ in range(r.randint(0, 40)))
        brute = sorted(((k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if ok[k](m[0])), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert pii.base_spans(t) == brute
    rows = pii.invented(400, 99)
    p = pii.model().predict(np.array([pii.features(*x[:4]) for x in rows]))
    assert ((p > 0.7) == np.array([x[4] for x in rows])).mean() > 0.95
    assert pii.redacted("mail a.b@c.de now", pii.base_spans("mail a.b@c.de now")) == "mail <EMAIL> now"


def test_licenses():
    assert licenses.alternatives("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath)") == [frozenset({"mit"}), frozenset({"apache-2.0", "gpl-2.0 with classpath"})]
    for bad in ("", "MIT AND", "(MIT", "MIT MIT", "MIT)", "(A OR B) WITH C"):
        with pytest.raises(licenses.BadExpression):
            licenses.alternatives(bad)
    f = licenses.scan("é CC-BY cc by x\nAll rights  reserved. GNU General Public License".encode())
    assert (f["n_words"], f["n_base"], f["first_word"], f["last_word"], f["base_labels"]) == (13, 4, 1, 10, "cc-by,gpl,reserved")


def test_language(spark):
    rows = [(i, ["the cat and the dog sat on a mat ", "le chat et le chien sont sur un tapis "][i % 2] * 3, ["en", "fr"][i % 2]) for i in range(60)] + [(100, "123 456", None), (101, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identified(docs, language.learn(docs)).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(60))
    assert out[100]["lang_pred"] == out[101]["lang_pred"] == "und"


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    a, b, c, d = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen[1:])
    assert set(b) <= set(a) and set(c) == set(b) == set(d)
    brute = brute_windows(list(b.items()))
    assert all(c[k] == (brute[k][2].decode() if brute[k][1] else b[k]) for k in b)
    assert not any(pii.base_spans(t) for t in d.values())
    packed = corpus_pipeline.STAGES[4][1](spark, seen[-1], sf).collect()
    assert {r["doc_id"] for r in packed} == set(d)
