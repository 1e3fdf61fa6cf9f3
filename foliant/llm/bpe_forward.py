"""Byte-pair encoding by a forward pass over prefixes.

Each prefix of a word has exactly one encoding, and dropping that encoding's last token leaves the encoding of a shorter prefix. So
the state of a prefix is its last token and its token count, and it follows from the states of shorter prefixes: the last token is the
one vocabulary entry that ends there, encodes as itself, and stays apart from the token before it when both are encoded together. Words
are visited in sorted order, which walks their trie depth first: the states of the prefix shared with the previous word are reused."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator


#: States kept; beyond it they are dropped and found anew.
MOST_NODES = 400_000


class ForwardBPE:
    """vocab: token (bytes or str) to id. rank(a, b): priority of merging two adjacent symbols, lower first, or None. Equal
    priorities merge from the left. single(symbol): ids of a symbol outside the vocabulary; no token spans such a symbol."""

    def __init__(self, vocab: dict, rank: Callable, single: Callable | None = None):
        self.vocab, self.rank, self.single = vocab, rank, single
        self.begins = {t[:k] for t in vocab for k in range(1, len(t))}
        #: A state: the last token, the tokens begun before (text so far, last token before it, count before it less the count now), and
        #: the states that follow. It holds all that the rest of a word can depend on, so equal states of different words are one.
        self.root: tuple = (None, (), {})
        self.nodes: dict = {}
        self.valid: dict = {}
        self.apart: dict = {}
        #: By token: the two tokens of its last merge and that merge's priority; None for one symbol.
        self.made: dict = {}

    def merged(self, s) -> list:
        """The encoding of s by merging, as tokens. Used on single tokens only; notes how one that encodes as itself is made."""
        parts: list = [s[i : i + 1] for i in range(len(s))]
        right, left = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (r := self.rank(parts[i], parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        last = None
        for i in range(len(parts)):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            last = (a, b, r)
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        if parts[0] == s:
            self.made[s] = last
        return [p for p in parts if p is not None]

    def is_token(self, t) -> bool:
        if (ok := self.valid.get(t)) is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            ok = self.valid[t] = t in self.vocab and self.merged(t) == [t]
        return ok

    def stays_apart(self, a, b) -> bool:
        """Whether tokens a and b, side by side, are encoded as these two. Their merges are undone from the last to the first; at each
        stage the symbols at the border must not merge before the merge that was undone takes one of them away. Of equal priorities
        the left merge goes first."""
        if (ok := self.apart.get((a, b))) is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            ok = self.apart[a, b] = self._apart(a, b)
        return ok

    def _tree(self, t) -> tuple | None:
        if t not in self.made:
            if len(self.made) > 1_000_000:
                self.made.clear()
            self.merged(t)
        return self.made[t]

    def _apart(self, x, y) -> bool:
        rank, limit, also = self.rank, None, False
        left, right = self._tree(x), self._tree(y)
        while True:
            r = rank(x, y)
            if r is not None and (limit is None or r < limit or (also and r == limit)):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left[2] > right[2]):
                x, limit, also = left[1], left[2], False
                left = self._tree(x)
            else:
                y, limit, also = right[0], right[2], True
                right = self._tree(y)

    def states(self, words: Iterable) -> Iterator[tuple[object, list, list[int]]]:
        """For each of the sorted words: the word, the last token of each of its prefixes, and their token counts (index: prefix
        length). Both lists are reused; copy what is to be kept. A symbol outside the vocabulary counts as len(single(symbol))."""
        nodes, last, count = [self.root], [None], [0]
        before = None
        for w in words:
            k = 0
            if before is not None:
                n = min(len(before), len(w))
                while k < n and before[k] == w[k]:
                    k += 1
            del nodes[k + 1 :], last[k + 1 :], count[k + 1 :]
            node, c = nodes[k], count[k]
            for x in w[k:]:
                node, more = node[2].get(x) or self.step(node, x)
                c += more
                nodes.append(node)
                last.append(node[0])
                count.append(c)
            before = w
            yield w, last, count

    def total(self, w) -> int:
        """Token count of w: the state of its last prefix."""
        node, c = self.root, 0
        for x in w:
            node, more = node[2].get(x) or self.step(node, x)
            c += more
        return c

    def step(self, node: tuple, x) -> tuple:
        """The state that symbol x leads to, and by how much the count changes; remembered in the node."""
        last, opened, after = node
        s = bytes((x,)) if isinstance(x, int) else x
        found, now = None, []
        for begun, prior, back in (*opened, (s[:0], last, 0)):
            t = begun + s
            if found is None and self.is_token(t) and (prior is None or self.stays_apart(prior, t)):
                found = (t, back + 1)
            if t in self.begins:
                now.append((t, prior, back))
        token, more = found or (None, len(self.single(s)) if self.single else 1)
        key = (token, tuple((t, prior, back - more) for t, prior, back in now))
        if len(self.nodes) > MOST_NODES:
            self.nodes.clear()
            self.root[2].clear()
        to = self.nodes.setdefault(key, (*key, {}))
        after[x] = (to, more)
        return to, more

    def tokens(self, w, last: list) -> list[int]:
        """Ids of the word's encoding, read back from its states."""
        out: list[int] = []
        i = len(w)
        while i:
            if (t := last[i]) is None:
                out += reversed(self.single(w[i - 1 : i]))
                i -= 1
            else:
                out.append(self.vocab[t])
                i -= len(t)
        return out[::-1]
