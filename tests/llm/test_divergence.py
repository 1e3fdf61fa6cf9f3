"""Source divergence against brute force; the registered query is held against SQL in test_queries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
from foliant.llm import divergence as D  # noqa: E402


def plain(rows, least, top):
    counts, docs, groups = {}, Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, x) for x in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in own:
            found = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s], "term": [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, v in found.items():
                out += [(lang, s, part, item.decode(), -x, i) for i, (x, item) in enumerate(sorted(v), 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize(("seed", "tile"), [(1, 5), (2, 300_000)])
def test_brute_force(spark, monkeypatch, seed, tile):
    r = random.Random(seed)
    monkeypatch.setattr(D, "PART", 40)
    long = "One two.three " * 30 + "x" * 90
    assert [t for part in D.terms_of(long.encode()) for t in part] == D.TERM.findall(long.lower().encode()) and len(list(D.terms_of(long.encode()))) > 5
    rows = []
    for _ in range(400):
        source = r.choice(["s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9", None])
        vocabulary = ["the", "The", "of", "\xc9t\xe9", "\u65e5\u672c"] + [f"w{chr(97 + r.randrange(12))}" for _ in range(3)] + ([f"own{source}"[:3] + chr(97 + r.randrange(3))] if source else [])
        rows.append((r.choice(["en", "fr", None]), source, " ".join(r.choice(vocabulary) + r.choice(["", "", ".", "1", "_x"]) for _ in range(r.randrange(12)))))
    rows += [("en", "empty", None), ("zz", "a", "few words"), ("zz", "b", ""), ("", "s1", "the the"), ("en", "\u00e9", "the")]
    df = spark.createDataFrame([(i, *x, "x") for i, x in enumerate(rows)], "id long, lang string, source string, text string, item string").repartition(3)
    assert sorted(map(tuple, D.audited(df, least=5, top=4, tile=tile, held=30 if tile == 5 else D.HELD).collect())) == plain(rows, 5, 4)
    if seed == 2:
        assert D.audited(df.limit(0)).collect() == []
        odd = df.withColumnsRenamed({"lang": "term", "source": "n", "text": "whole"}).selectExpr("*", "1 as lang", "2 as tile")
        assert sorted(map(tuple, D.audited(odd, "term", "n", "whole", least=5, top=4).collect())) == plain(rows, 5, 4)


@pytest.mark.parametrize("heavy", [0.0, 0.2, 1.0])
def test_heavy_and_light(heavy):
    """However terms are divided into heavy and light ones, the sums are the same."""
    r = np.random.default_rng(7)
    k, terms = 13, 200
    dense = r.integers(0, 50, (terms, k)) * (r.random((terms, k)) < r.random((terms, 1)))
    whole = dense.sum(0) + 2 * terms
    term, group = np.nonzero(dense)
    got = D.pair_sums(term, group, dense[term, group], whole, terms, heavy, cells=100)
    p = [[1 + 1_000_000_000 * (int(dense[t, g]) + 2) // int(whole[g]) for t in range(terms)] for g in range(k)]
    assert got.tolist() == [[sum((a - b) * (a - b) // (a + b) for a, b in zip(p[i], p[j], strict=True)) for j in range(k)] for i in range(k)]


def test_large_counts():
    for c, w in ((10**13, 3 * 10**13), (0, 9 * 10**15), (7, 10), (9 * 10**15 - 2, 9 * 10**15)):
        assert int(D.shares(np.array([c]), w)[0]) == 1 + 10**9 * (c + 2) // w
