"""License scans (operator 1): an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the
licence expressions that follow tags."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, slices

#: Phrases (whole consecutive words, lower case) and labels of the base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases and labels that the method adds, with the weight of each as evidence of a licence.
MORE = {
    "mit license": ("mit", 0.9), "apache license": ("apache", 0.9), "bsd license": ("bsd", 0.9), "mozilla public license": ("mpl", 0.9), "creative commons": ("cc", 0.8),
    "creative commons attribution": ("cc-by", 0.9), "lesser general public license": ("lgpl", 0.9), "affero general public license": ("agpl", 0.9), "public domain": ("public-domain", 0.6),
    "licensed under": ("notice", 0.5), "released under": ("notice", 0.4), "permission is hereby granted": ("mit", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.8),
}
BASE_WEIGHT = {"cc-by": 0.9, "gpl": 0.9, "reserved": 0.6}
TAG = "spdx license identifier"
TAG_START = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*", re.I)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
#: Words: runs of bytes that are ASCII digits or letters, or not ASCII; ASCII letters are lower-cased.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RANK = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    """The expression can't be parsed."""


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: and/or/with (left-associative; with binds most, or least) and brackets to postfix order."""
    out: list[str] = []
    ops: list[str] = []
    operand = True  # an operand or an opening bracket must come next
    for t in tokens:
        low = t.lower()
        if t == "(":
            if not operand:
                raise BadExpression(t)
            ops.append(t)
        elif t == ")":
            if operand:
                raise BadExpression(t)
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise BadExpression(t)
            ops.pop()
        elif low in RANK:
            if operand:
                raise BadExpression(t)
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        else:
            if not operand:
                raise BadExpression(t)
            out.append(t)
            operand = False
    if operand or "(" in ops:
        raise BadExpression("end")
    return out + ops[::-1]


def alternatives(expression: str, most: int = 256) -> list[frozenset[str]]:
    """The sets of licences (with exceptions, as "x with y") any one of which satisfies the expression, in order, without supersets.
    Raises BadExpression; also where an exception is given for more than a single licence, and where a step would make more than `most`
    sets (before it makes them). The scan doesn't need this: see evaluated()."""
    stack: list[list[frozenset[str]]] = []
    for t in postfix(TOKEN.findall(expression)):
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            if t != "with" and (len(a) + len(b) if t == "or" else len(a) * len(b)) > most:
                raise BadExpression("too many alternatives")
            if t == "or":
                new = a + b
            elif t == "and":
                new = [x | y for x in a for y in b]
            else:
                if len(a) != 1 or len(b) != 1 or len(a[0]) != 1 or len(b[0]) != 1:
                    raise BadExpression(t)
                new = [frozenset({f"{next(iter(a[0]))} with {next(iter(b[0]))}"})]
            new = list(dict.fromkeys(new))
            new = [x for x in new if not any(y < x for y in new)]
            stack.append(new)
        else:
            stack.append([frozenset({t.lower()})])
    return stack[0]


def names(tokens: list[str]) -> set[str]:
    """All licences of an expression (with exceptions, as "x with y"). Nothing is expanded. Raises BadExpression as alternatives() does."""
    stack: list[set[str]] = []
    for t in postfix(tokens):
        if t in RANK:
            b, a = stack.pop(), stack.pop()
            if t == "with" and len(a) + len(b) != 2:
                raise BadExpression(t)
            if t == "with":
                a = {f"{a.pop()} with {b.pop()}"}
            else:  # into the larger one
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
            stack.append(a)
        else:
            stack.append({t.lower()})
    return stack[0]


def evaluated(tokens: list[str]) -> str:
    """The expression in one form, with `&`, `|` and `with`, in its order and with as few brackets as it needs. Parts are joined into the
    longer one, so its length bounds the work. Raises BadExpression."""
    stack: list[tuple[deque[str], int]] = []
    for t in postfix(tokens):
        if t not in RANK:
            stack.append((deque([t.lower()]), 9))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        for part, rank in ((a, left), (b, right)):
            if rank < RANK[t]:
                part.appendleft("(")
                part.append(")")
        sign = {"and": " & ", "or": " | ", "with": " with "}[t]
        if len(a) >= len(b):
            a.append(sign)
            a.extend(b)
        else:
            b.appendleft(sign)
            b.extendleft(reversed(a))
            a = b
        stack.append((a, RANK[t]))
    return "".join(stack[0][0])


def longest(t: str, at: int, end: int) -> list[str]:
    """Tokens of the longest valid expression that starts at `at`, none if there isn't any. Stops where no more can follow."""
    tokens, ends, deep, operand, last = [], [], 0, True, at
    for m in TOKEN.finditer(t, at, end):
        x = m[0].rstrip(".:-")
        if not x or operand == (x == ")" or x.lower() in RANK) or t[last : m.start()].strip(" \t"):
            break
        last = m.start() + len(x)  # a mark after an identifier, or any other sign, ends the expression
        deep += (x == "(") - (x == ")")
        if deep < 0:
            break
        operand = x == "(" or x.lower() in RANK
        tokens.append(x)
        if not (operand or deep):
            ends.append(len(tokens))
    low, high = 0, len(ends)  # an exception of more than one licence spoils all that is longer
    while low < high:
        mid = (low + high + 1) // 2
        try:
            names(tokens[: ends[mid - 1]])
            low = mid
        except BadExpression:
            high = mid - 1
    return tokens[: ends[low - 1]] if low else []


def family(name: str) -> str:
    """Label of a licence identifier: its family where known, else itself."""
    for start, label in (("cc-by", "cc-by"), ("cc0", "public-domain"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("bsd", "bsd"), ("mpl", "mpl"), ("mit", "mit")):
        if name.startswith(start):
            return label
    return name


@lru_cache(1)
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in {*BASE, *MORE, TAG}:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def scan(t: bytes) -> dict:
    """All findings of one text (UTF-8)."""
    words = t.translate(WORDS).split()
    line = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places: list[int] = []
    spaces = seen = 0  # spaces before the character `seen`
    base: set[str] = set()
    labels: dict[str, float] = {}
    expressions: list[str] = []
    tagged = False
    for end, p in automaton().iter(line):
        if p in BASE:
            begin = end - len(p)
            spaces += line.count(" ", seen, begin) - line.count(" ", begin, seen)
            seen = begin
            places.append(spaces - 1)
            base.add(BASE[p])
        elif p == TAG:
            tagged = True
        else:
            label, weight = MORE[p]
            labels[label] = max(weight, labels.get(label, 0))
    for x in base:
        labels[x] = max(BASE_WEIGHT[x], labels.get(x, 0))
    if tagged:
        text = t.decode("utf-8", "replace")
        tags = [m.span() for m in TAG_START.finditer(text)]
        for i, (_, at) in enumerate(tags):
            line_end = text.find("\n", at)
            tokens = longest(text, at, min(line_end if line_end >= 0 else len(text), tags[i + 1][0] if i + 1 < len(tags) else len(text)))
            if not tokens:
                labels["unparsed"] = max(0.3, labels.get("unparsed", 0))
                continue
            for name in sorted(names(tokens)):
                labels[family(name.split(" with ")[0])] = 0.99
            expressions.append(evaluated(tokens))
    miss = 1.0
    for x in sorted(labels):
        miss *= 1 - labels[x]
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": round(1 - miss, 6), "expressions": "; ".join(expressions)}


KINDS = {"n_words": ("long", pa.int64()), "n_base": ("long", pa.int64()), "first_word": ("long", pa.int64()), "last_word": ("long", pa.int64()), "base_labels": ("string", pa.string()), "labels": ("string", pa.string()), "score": ("double", pa.float64()), "expressions": ("string", pa.string())}


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and findings of every row. Null and empty texts: no words, no labels (empty strings), null places, score 0. Repeated rows give
    equal rows; other columns are ignored, whatever their names; very long texts are scanned whole; an empty table gives no rows. score: 1 minus the product of (1 - weight) over the labels.
    One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            rows = [scan(t) for t in byte_texts(b.column("__text"))]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r[k] for r in rows], t) for k, (_, t) in KINDS.items())], [key, *KINDS])

    kinds = ", ".join(f"{k} {s}" for k, (s, _) in KINDS.items())
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {kinds}")
