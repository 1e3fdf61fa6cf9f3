"""Phrase collocations against brute force; the registered query is held against SQL in test_queries."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("foliant.llm.entry")
from foliant.llm import collocations as C  # noqa: E402
from foliant.llm.runs import widths  # noqa: E402


def plain(rows, longest, least, share, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        inside = [b for (other, v), b in cand.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((C.WEIGHT * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_brute_force(spark, monkeypatch, block):
    r = random.Random(block)
    monkeypatch.setattr(C, "GROUP", 20)
    if block == 40:  # many ranges, dealt in levels
        monkeypatch.setattr(C, "RANGE", 900)
        monkeypatch.setattr(C, "widths", lambda n: widths(n, 3))
    words = ["a", "B", "b", "é", "日本", "new", "York", "city", "\xa0", "x\x00y", "--", "İ"]
    rows = []
    for _ in range(300):
        t = " ".join(r.choice(words) + r.choice(["", "", "", ".", "\n", ",\r", "\t", "  "]) for _ in range(r.randrange(30)))
        rows.append((r.choice(["en", "fr", None]), t + " new york city hall" * r.randrange(3)))
    rows += [("en", None), (None, ""), ("xx", "only few words"), ("en", rows[0][1]), ("en", rows[0][1])]
    df = spark.createDataFrame([(i, *x, "s") for i, x in enumerate(rows)], "id long, lang string, text string, phrase string").repartition(3)
    for longest, least, share, top in ((4, 5, 80, 40), (2, 3, 80, 1000)) if block == 40 else ((5, 3, 100, 1000),):
        got = sorted(map(tuple, C.collocations(df, longest=longest, least=least, share=share, top=top, block=block).collect()))
        assert got == plain(rows, longest, least, share, top)


def test_long_texts_and_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 50)
    t = ("some words. and more\n" * 40 + "x" * 200 + ", end").encode()
    assert b"".join(C._pieces(t)) == t and all(p[-1:] in b".,\n" for p in list(C._pieces(t))[:-1]) and len(list(C._pieces(t))) > 9
    rows = [("en", "one two three four. " * 50), ("en", "word " * 2000), (None, None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, C.collocations(df).collect()))
    assert got == plain(rows, C.LONGEST, C.LEAST, C.SHARE, C.TOP) and got
    assert C.collocations(df.limit(0)).collect() == []
    odd = df.withColumnsRenamed({"lang": "id", "text": "n"}).selectExpr("*", "1 as lang", "2 as block")
    assert sorted(map(tuple, C.collocations(odd, "id", "n").collect())) == got


def test_wide_products(spark):
    """Frequencies so large that the score's product passes 64 bits."""
    big = 3 * 10**15
    level = spark.createDataFrame([(1, 10, 11, big)], "id long, left long, right long, n long")
    shorter = spark.createDataFrame([(10, "en", b"a", b"a", 2 * big, [2 * big], [2 * big]), (11, "en", b"b", b"b", big, [big], [big])], "id long, lang string, phrase binary, last binary, n long, heads array<long>, tails array<long>")
    assert C._phrases(level, shorter, None, 80).first()["cut"]["score"] == C.WEIGHT * big // (3 * big)
