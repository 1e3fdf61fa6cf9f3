"""PII (operator 2): candidate gradient boosting. Generators with high recall propose overlapping spans; boosted trees score them by
format and context; calibrated thresholds select those to redact. The base spans (fixed formats) always stay.

The tests' documents carry no span labels, so the trees are trained on invented contexts with known answers (seeded, on the driver, a
fixed small number): numbers and strings that are personal or secret beside look-alikes such as dates, versions, prices, hashes."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import release, slices

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national", "mac")
BASE_KINDS = KINDS[:4]
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digit runs part where a match may start, so these equal the contract's patterns without backtracking.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: High-recall generators of the method, by kind; secrets have their own, see secrets().
PROPOSE = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", re.A), "national": re.compile(r"(?<![0-9.+-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b", re.A), "phone": re.compile(r"(?<![0-9.+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.])"),
}
SECRET = re.compile(r"[A-Za-z0-9_\-+/=]{16,}")
#: In key=value the value is a candidate of its own; '=' at the end is padding.
ASSIGN = re.compile(r"=+(?=[^=])")
SECRET_CUES = re.compile(r"token|secret|passw(?:or)?d|passphrase|passcode|api[_ -]?key|bearer|key", re.I)
#: One of these is in every text that has a cue.
CUE_PARTS = ("token", "secret", "passw", "passphrase", "passcode", "bearer", "key")
#: A quoted value right after a cue may hold any characters.
QUOTED = re.compile(r"(?:token|secret|passw(?:or)?d|passphrase|passcode|api[_ -]?key)[\"']?\s*[:=]\s*([\"'])([^\"'\n]{8,})\1", re.I)
LEAST, LEAST_CUED = 16, 8
CUES = re.compile(r"token|secret|password|passwd|passphrase|passcode|api[_ -]?key|bearer|key|ssn|social|iban|account|phone|tel|call|fax|mobile|mac\b|contact", re.I)
AGAINST = re.compile(r"version|sha|commit|md5|hash|order|invoice|isbn|page|checksum|total|price|date|build", re.I)
#: A proposed span is redacted if its calibrated probability is at least its kind's threshold: the lowest at which this share of the
#: spans over it is personal or secret in the rows that calibrate.
PRECISION = 0.97
CONTEXT = 32
TRAIN_ROWS = 1600


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    end, at = 0, t.find("@")
    while at >= 0:
        i = at
        while i > end and t[i - 1] in LOCAL_CHARS:
            i -= 1
        m = DOMAIN.match(t, at + 1) if i < at else None
        if m:
            yield i, m.end()
            end = m.end()
        at = t.find("@", at + 1)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by start and kind."""
    out = [("email", a, b) for a, b in emails(t)] if "@" in t else []
    if DIGIT.search(t):
        if "." in t:
            out += [("ip", *m.span()) for m in IP.finditer(t) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(t: str, digit: bool, cue: bool) -> Iterator[tuple[int, int]]:
    """Runs of key characters, parted after '=', that hold a digit or follow a cue. Values of key=value and quoted values may be shorter
    where the cue is their key."""
    for m in SECRET.finditer(t):
        a = m.start()
        for b, after in [*(x.span() for x in ASSIGN.finditer(m[0])), (len(m[0]), len(m[0]))]:
            b += m.start()
            cued = cue and SECRET_CUES.search(t, max(0, a - CONTEXT), a) is not None
            if b - a >= (LEAST_CUED if cued and a > m.start() else LEAST) and (cued or (digit and DIGIT.search(t, a, b))):
                yield a, b
            a = m.start() + after
    if cue:
        yield from (m.span(2) for m in QUOTED.finditer(t))


def proposals(t: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of the method. Hardware addresses and secrets after a cue need no digit, the other generators do."""
    digit, low = DIGIT.search(t) is not None, t.lower()
    cue = any(c in low for c in CUE_PARTS)
    out = [("secret", *s) for s in dict.fromkeys(secrets(t, digit, cue))] if digit or cue else []
    if t.count(":") + t.count("-") > 4:
        out += [("mac", *m.span()) for m in PROPOSE["mac"].finditer(t)]
    return out + [(k, *m.span()) for k, r in PROPOSE.items() if k != "mac" and digit for m in r.finditer(t)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(t: str, kind: str, a: int, b: int) -> list[float]:
    s = t[a:b]
    before, after = t[max(0, a - CONTEXT) : a], t[b : b + CONTEXT]
    digits = sum(c in "0123456789" for c in s)
    kinds = (any(c.islower() for c in s)) + (any(c.isupper() for c in s)) + (digits > 0)
    seps = sum(c in " -.()+/_=:" for c in s)
    return [
        float(KINDS.index(kind)), float(min(80, b - a)), digits / max(1, b - a), float(kinds), float(seps), len(set(s[:80])) / min(80, max(1, b - a)), float(bool(CUES.search(before))), float(bool(AGAINST.search(before))),
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")), float(before[-1:] in ('"', "'") and after[:1] in ('"', "'")), float(kind == "iban" and iban_ok(s)), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(s.lower() == s or s.upper() == s), float(sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:80], strict=False)) / max(1, min(80, b - a))),
    ]


def invented(rows: int, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, personal or secret?) of made-up contexts; the spans are those that proposals() finds there."""
    r = random.Random(seed)
    syl = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ció", "que", "en", "ich", "la", "de", "ung", "eau"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    pick = lambda cs, n: "".join(r.choice(cs) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long_word = lambda sep: sep.join(word() + word() for _ in range(r.randint(2, 5) if sep else r.randint(1, 3))).replace("ció", "cio").ljust(16, "e")
    hexa, alnum, dig = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    out = []

    def iban() -> str:
        body = pick(dig, 18)
        c = 98 - int(body + "1314" + "00") % 97
        return f"DE{c:02d}{body}"

    assigned = ["password: ", "password=", "secret=", "secret: ", "token = ", "token: ", "api_key=", "passwd = ", "passphrase: ", "key = "]
    phrased = ['password: "', 'passphrase = "', "secret: '", 'password="']
    while len(out) < rows:
        case = r.randrange(17)
        cue, none, bad = r.choice(["token = ", "api_key: ", "secret=", "password: ", "bearer ", "key = ", "password=", "api_key=", "token="]), "", r.choice(["sha ", "commit ", "order ", "checksum ", "invoice ", "version "])
        quote = r.choice(["", '"'])
        phone = f"{r.choice(['(', ''])}" + pick(dig, 3)
        phone = (phone + ")" if phone[0] == "(" else phone) + r.choice([" ", "-", "."]) + pick(dig, 3) + r.choice(["-", " ", "."]) + pick(dig, 4)
        kind, lead, s, y = [
            ("secret", cue, pick(hexa, r.choice([24, 32, 40, 64])), 1), ("secret", cue, pick(alnum, r.randint(18, 44)) + "7", 1), ("secret", bad, pick(hexa, r.choice([32, 40, 64])), 0), ("secret", none, pick(dig, r.randint(16, 24)), 0),
            ("iban", r.choice(["iban ", "account ", none]), iban(), 1), ("iban", bad, "AB" + pick(dig, 2) + pick(dig, 16), 0), ("national", r.choice(["ssn ", "social security ", "ssn: "]), f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", 1),
            ("national", bad, f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}", 0), ("mac", r.choice(["mac ", none]), ":".join(pick(hexa, 2) for _ in range(6)), 1), ("phone", r.choice(["phone ", "call ", "tel: ", "mobile "]), phone, 1), ("phone", r.choice([bad, none]), f"{pick(dig, 3)} {pick(dig, 3)} {pick(dig, 3)}", 0),
            ("secret", r.choice(assigned), pick(letters, r.randint(16, 40)), 1), ("secret", r.choice(assigned), "".join(word().capitalize() for _ in range(9)).replace("ó", "o").ljust(16, "X"), 1), ("secret", r.choice(phrased), " ".join(word() for _ in range(r.randint(3, 6))).ljust(8, "e"), 1),
            ("secret", r.choice(["the key ", "a secret ", "token of ", "key ", "keys to ", "bearer of ", "password for "]), long_word(r.choice(["", "-", "/", "_"])), 0), ("secret", r.choice(["sorted ", "see ", "v=", "id=", "page=", "sha="]), pick(hexa, 32), 0), ("mac", r.choice(["mac ", none]), r.choice([":", "-"]).join(r.choice([pick(x, 2), pick(x, 1) * 2]) for x in [r.choice(["abcdef", "ABCDEF"])] * 6), 1),
        ][case]
        shut = lead[-1:] if lead in phrased else ""
        head = " ".join(word() for _ in range(r.randint(2, 8))) + " " + lead
        if not shut and lead.endswith(("= ", "=", ": ")):
            shut = quote
            head += quote
        t = head + s + shut + " " + " ".join(word() for _ in range(r.randint(2, 8)))
        found = [(a, b) for k, a, b in proposals(t) if k == kind and a < len(head) + len(s) and len(head) < b]
        out += [(t, kind, a, b, y) for a, b in found[:1]]
    return out


def thresholds(kinds: list[str], p: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Per kind the lowest probability (0.05 at least) from which on PRECISION holds; over 1 (never) where none does."""
    out = {}
    for k in KINDS:
        mine = np.array([x == k for x in kinds])
        order = np.argsort(-p[mine], kind="stable")
        q, right = p[mine][order], np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero((right >= PRECISION) & (np.append(q[1:], -1) < q))
        out[k] = max(0.05, float(q[ok[-1]])) if len(ok) else 1.1
    return out


@lru_cache(1)
def model() -> Boosted:
    """Trees and thresholds, trained once in the driver: 3 of 4 rows fit the trees, the others calibrate and choose the thresholds."""
    rows = invented(TRAIN_ROWS)
    x, y = np.array([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([r[4] for r in rows], float)
    held = np.arange(len(y)) % 4 == 0
    trees = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    trees.least = thresholds([r[1] for r, h in zip(rows, held, strict=True) if h], trees.predict(x[held]), y[held])
    return trees


def _meets(begins: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a..b overlaps one of the sorted stretches, of which no two overlap."""
    i = bisect_left(begins, b)
    return i > 0 and ends[i - 1] > a


def chosen(t: str, trees: Boosted, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and, of the proposals that overlap none of them, those over their thresholds; of overlapping ones the likelier."""
    begins, ends = [], []  # stretches that base spans cover
    for _, a, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    cand = [c for c in proposals(t) if not _meets(begins, ends, c[1], c[2])]
    if not cand:
        return base
    p = trees.predict(np.array([features(t, *c) for c in cand]))
    taken: list[tuple[str, int, int]] = []
    begins, ends = [], []
    for i in sorted(range(len(cand)), key=lambda i: (-p[i], cand[i][1], KINDS.index(cand[i][0]))):
        kind, a, b = cand[i]
        if p[i] >= trees.least[kind] and not _meets(begins, ends, a, b):
            taken.append(cand[i])
            at = bisect_left(begins, a)
            begins.insert(at, a)
            ends.insert(at, b)
    return sorted(base + taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(t: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans gives way to the kind of its first, in angle brackets."""
    out, at, end = [], 0, -1
    for k, a, b in spans:
        if a >= end:
            out += [t[at : max(at, a)], f"<{k.upper()}>"]
        end = at = max(end, b)
    return "".join([*out, t[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = {"n_email": pa.int64(), "n_ip": pa.int64(), "n_card": pa.int64(), "n_phone": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}


def personal(docs: DataFrame, replace: bool = False, text: str = "text") -> DataFrame:
    """The columns of docs except text, with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (all of them);
    columns of docs by these names give way. replace: the columns of docs alone, the spans of the text redacted (null stays null). Null
    and empty texts have no spans; repeated rows give equal rows; an empty table gives no rows; very long texts are gone through whole.
    Offsets count code points. One narrow pass."""
    trees = model()
    kept = [c for c in docs.columns if replace or (c != text and c not in RESULT)]
    names = [] if replace else list(RESULT)

    def findings(base: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> tuple:
        n = [sum(k == x for k, _, _ in base) for x in BASE_KINDS]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = findings([], [])
        for b in slices(batches, text):
            rows, texts = [], []
            for t in b.column(text).to_pylist():
                base = base_spans(t) if t else []
                spans = chosen(t, trees, base) if t else []
                rows.append(findings(base, spans) if spans else none)
                texts.append(redacted(t, spans) if spans else t)
            cols = [pa.array(texts, pa.string()) if k == text else b.column(k) for k in kept]
            if names:
                cols += [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), RESULT.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *names])
            release()

    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{k} {'long' if RESULT[k] == pa.int64() else 'string'}" for k in names])
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, kinds)
