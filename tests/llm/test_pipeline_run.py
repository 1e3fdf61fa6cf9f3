"""run() of the corpus pipeline against brute force, stage by stage, on tables with odd rows, and on empty ones."""

import random
import re
import zlib

import pytest

pytest.importorskip("foliant.llm.entry")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers as P  # noqa: E402

from foliant.llm import pii, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `doc id` string"


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def deduplicated(rows):
    """One row of each group of near copies, of the smallest id; rows without words stay."""
    top, sets = list(range(len(rows))), [shingles(r[1]) for r in rows]
    find = lambda i: i if top[i] == i else find(top[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0], r[1])) for g in groups.values()]


def without_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        w = split(r[1])
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            gone.update(range(i, i + 20) if key in seen else ())
            seen.add(key)
        out.append((r[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1], *r[2:]))
    return out


def test_run(spark, tmp_path):
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu", "sar") for b in ("n", "lt", "ro", "sk", "ve", "")]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    good = [sentence(r.randint(40, 90)) for _ in range(60)]
    passage = sentence(60)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100 + i, " ".join([*t.split()[:-1], "changed"])) for i, t in enumerate(good[:8])]  # near copies
    rows += [(200 + i, f"{sentence(30)} {passage} {sentence(30)}") for i in range(5)]
    rows += [(300 + i, f"{sentence(40)} mail me at u{i}@example.org or call +1 555 123 4567 {sentence(10)}") for i in range(3)]
    rows += [(400 + i, f"$$$ buy ### now %%% {i} " * 12) for i in range(40)] + [(500, None), (501, ""), (None, sentence(50)), (None, good[3]), (502, "few"), (7, sentence(45))]
    rows = [(d, t, "en", "s", len(t or ""), "x") for d, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)] + [(400 + i, 0) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [x for x, v in zip(rows, quality.verdicts([(x[1] or "").encode() for x in rows], model, quality.KEEP), strict=True) if v[-1]]
    want = without_repeats(deduplicated(want))
    trees = pii.model()
    want = [(x[0], pii.redacted(x[1], pii.chosen(x[1], trees, pii.base_spans(x[1])))) for x in want]
    assert len(want) >= 60 and any("<EMAIL>" in t for _, t in want) and sum(passage in t for _, t in want) == 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = lambda t: b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t, add_special_tokens=False).ids, 0])
    assert sorted((str(x.doc_id), x.ids_crc32, x.length) for x in got) == sorted((str(d), zlib.crc32(ids(t)), len(ids(t)) // 4) for d, t in want)
    ends = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert max(ends.values()) <= 2048


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
