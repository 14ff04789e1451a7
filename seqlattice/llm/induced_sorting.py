"""External induced sorting of the suffixes of one shard, with common-prefix values.

The suffixes that begin a rising stretch of the text (S*) are sorted first; a scan of the
sorted suffixes then induces the order of the rest: each scanned suffix puts its left
neighbour at the end of the queue of that neighbour's first character, L-type ones in a rising
scan, S-type ones in a falling scan. The queues are the buckets of a priority queue keyed by
(character, rank); each holds tuples (position, common prefix with the tuple before it) and
goes to disk beyond a fixed number of tuples. A tuple's common prefix is one more than the
least of those between its source and the source before it in the same queue.

S* suffixes are sorted by the same induction on unsorted S* positions, which sorts the S*
substrings; these get names by their characters, and the string of names is sorted by recursion. Recursion ends
where the names outnumber ``BYTE_LIKE``: from there the names are refined by doubling, as a
queue a name would cost a Python step each. Common prefixes are counted up to ``CAP``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from .common import same_spans

CAP = 200
BYTE_LIKE = 1 << 10
CHUNK = 1 << 16


class Queue:
    """Tuples in order of arrival; those beyond ``hold`` wait in a file."""

    def __init__(self, folder: str, hold: int):
        self.folder, self.hold = folder, hold
        self.parts: list[np.ndarray] = []
        self.held = self.size = self.read_to = 0
        self.file = None

    KIND = np.dtype([("at", np.int64), ("lcp", np.uint8)])

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        part = np.empty(len(at), self.KIND)
        part["at"], part["lcp"] = at, lcp
        self.parts.append(part)
        self.held += len(part)
        self.size += len(part)
        if self.held > self.hold:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(0, 2)
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts, self.held = [], 0

    def _slice(self, first: int, after: int) -> np.ndarray:
        stored = self.size - self.held
        out = []
        if first < stored:
            self.file.seek(first * self.KIND.itemsize)
            out.append(np.frombuffer(self.file.read((min(after, stored) - first) * self.KIND.itemsize), self.KIND))
        if after > stored:
            if len(self.parts) > 1:
                self.parts = [np.concatenate(self.parts)]
            out.append(self.parts[0][max(first - stored, 0) : after - stored])
        return np.concatenate(out) if out else np.empty(0, self.KIND)

    def forward(self) -> Iterator[np.ndarray]:
        """The tuples not yet read, including those that arrive meanwhile."""
        while self.read_to < self.size:
            after = min(self.size, self.read_to + CHUNK)
            part = self._slice(self.read_to, after)
            self.read_to = after
            yield part

    def all(self) -> Iterator[np.ndarray]:
        for first in range(0, self.size, CHUNK):
            yield self._slice(first, min(first + CHUNK, self.size))

    def backward(self) -> Iterator[np.ndarray]:
        for after in range(self.size, 0, -CHUNK):
            yield self._slice(max(0, after - CHUNK), after)[::-1]

    def first(self) -> int:
        return int(self._slice(0, 1)["at"][0])

    def last(self) -> int:
        return int(self._slice(self.size - 1, self.size)["at"][0])

    def close(self) -> None:
        if self.file:
            self.file.close()


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) of each pair of places, both included."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    level = np.zeros(len(first), np.int64)
    span = last - first + 1
    level = np.floor(np.log2(span)).astype(np.int64) if len(span) else level
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] + 1 - (1 << int(k))])
    return out


class _Sources:
    """Turns scanned tuples into tuples of their left neighbours and deals them out to the queues."""

    def __init__(self, text: np.ndarray, queues: list[Queue]):
        self.text, self.queues = text, queues
        self.small = np.uint16 if len(queues) <= 1 << 16 else np.int64
        self.since = np.zeros(len(queues), np.uint8)  # least common prefix since a queue's last tuple
        self.fresh = np.ones(len(queues), bool)

    def deal(self, at: np.ndarray, lcp: np.ndarray, take) -> None:
        """lcp[i]: common prefix of source i and the source scanned before it. take(at): which neighbours belong."""
        before = at - 1
        chars = self.text[np.maximum(before, 0)]
        hit = np.flatnonzero((before >= 0) & take(before))
        order = hit[np.argsort(chars[hit].astype(self.small), kind="stable")]  # 16 bits are sorted by counting
        char = chars[order].astype(np.int64)
        low = lcp.min() if len(lcp) else CAP
        old = self.since.copy()
        np.minimum(self.since, low, out=self.since)
        if not len(order):
            return
        new = np.r_[True, char[1:] != char[:-1]]
        first = np.empty(len(order), np.int64)
        first[1:] = order[:-1] + 1
        first[new] = 0
        least = _range_minima(lcp, first, order)
        heads = np.flatnonzero(new)
        least[heads] = np.minimum(least[heads], old[char[heads]])
        out = np.minimum(least.astype(np.int64) + 1, CAP).astype(np.uint8)
        out[heads[self.fresh[char[heads]]]] = 0
        tails = np.r_[heads[1:] - 1, len(order) - 1]
        for h, t in zip(heads, tails):
            c = int(char[h])
            self.queues[c].push(before[order[h : t + 1]], out[h : t + 1])
            self.fresh[c] = False
            rest = lcp[order[t] + 1 :]
            self.since[c] = rest.min() if len(rest) else CAP


def _run(text: np.ndarray, at: int) -> int:
    part = text[at : at + CAP]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, alphabet: int, folder: str, hold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes in falling order, some at a time: (positions, common prefix with the next smaller one).

    seeds: S* positions in order, within each first character at least; types: True where S.
    """
    lows = [Queue(folder, hold) for _ in range(alphabet)]
    edges = np.searchsorted(text[seeds], np.arange(alphabet + 1))
    out = _Sources(text, lows)
    is_low = lambda at: ~types[at]
    for c in range(alphabet):
        link = 0  # common prefix with the source before, where a bucket begins
        for part in lows[c].forward():
            out.deal(part["at"], part["lcp"], is_low)
        a, b = edges[c], edges[c + 1]
        if a < b:
            if lows[c].size:
                link = min(_run(text, lows[c].last()), _run(text, int(seeds[a])))
            lcp = seed_lcp[a:b].copy()
            lcp[0] = link
            for k in range(0, b - a, CHUNK):
                out.deal(seeds[a + k : min(a + k + CHUNK, b)], lcp[k : k + CHUNK], is_low)
    highs = [Queue(folder, hold) for _ in range(alphabet)]
    out = _Sources(text, highs)
    is_high = lambda at: types[at]
    try:
        for c in range(alphabet - 1, -1, -1):
            held = None  # a tuple whose common prefix with the next smaller suffix isn't known yet
            for part in highs[c].forward():
                out.deal(part["at"], part["lcp"], is_high)
                at, lcp = part["at"], part["lcp"]
                if held is not None:
                    yield np.array([held]), lcp[:1]
                yield at[:-1], lcp[1:]
                held = int(at[-1])
            link = min(_run(text, held), _run(text, lows[c].last())) if held is not None and lows[c].size else 0
            if held is not None:
                yield np.array([held]), np.array([link], np.uint8)
            # in the falling scan a tuple's common prefix is with the larger one scanned before it
            for part in lows[c].backward():
                at, down = part["at"], part["lcp"]
                up = np.r_[np.uint8(link), down[:-1]]
                out.deal(at, up, is_high)
                link = int(down[-1])
                yield at, down
        yield np.array([len(text) - 1]), np.zeros(1, np.uint8)  # the end mark, which no suffix induces
    finally:
        for q in (*lows, *highs):
            q.close()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one, the end mark, is S."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    types = np.empty(n, bool)
    types[-1] = True
    rises = text[differs] < text[differs + 1]
    ends = np.r_[differs, n - 1]
    values = np.r_[rises, True]
    types[:] = np.repeat(values, np.diff(np.r_[-1, ends]))
    return types


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by doubling."""
    rank = names.astype(np.int64)
    n, step = len(rank), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.r_[0, key[order][1:] != key[order][:-1]].cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def packed(text: np.ndarray, alphabet: int) -> tuple[np.ndarray, int]:
    """(the next few characters at each place as one number, how many they are); zeros follow the text."""
    bits = max(int(alphabet - 1).bit_length(), 1)
    per = 63 // bits
    padded = np.zeros(len(text) + CAP + 2 * per, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text) + CAP + per, np.uint64)
    for k in range(per):
        out <<= np.uint64(bits)
        out |= padded[k : k + len(out)]
    return out, per


def common_prefixes(text: np.ndarray, at: np.ndarray, alphabet: int) -> np.ndarray:
    """Common prefix, up to CAP, of each suffix and the one before it in the list; the first has 0."""
    words, per = packed(text, alphabet)
    out = np.zeros(len(at), np.int64)
    live, odd = np.arange(1, len(at)), []
    for k in range(0, CAP, per):
        if not len(live):
            break
        same = words[at[live] + k] == words[at[live - 1] + k]
        odd.append(live[~same])
        live = live[same]
        out[live] = k + per
    live = np.concatenate(odd) if odd else live[:0]
    for _ in range(per - 1):  # within the word that differs
        i, j = at[live] + out[live], at[live - 1] + out[live]
        ok = np.maximum(i, j) < len(text)
        ok[ok] = text[i[ok]] == text[j[ok]]
        live = live[ok]
        out[live] += 1
    return np.minimum(out, CAP).astype(np.uint8)


def sort_suffixes(text: np.ndarray, alphabet: int, folder: str | None = None, hold: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefix with the next smaller suffix) of all suffixes, in falling order.

    text: integers below alphabet that end with a 0 found nowhere else.
    """
    types = suffix_types(text)
    stars = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    if len(stars) == 0:
        yield from induce(text, types, np.array([len(text) - 1]), np.zeros(1, np.uint8), alphabet, folder, hold)
        return
    rough = stars[np.argsort(text[stars], kind="stable")]
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    parts = [at[is_star[at]] for at, _ in induce(text, types, rough, np.zeros(len(rough), np.uint8), alphabet, folder, hold)]
    by_substring = np.concatenate(parts)[::-1]
    stop = np.empty(len(text), np.int64)
    stop[stars] = np.r_[stars[1:] + 1, len(text)]
    size = stop[by_substring] - by_substring
    same = size[1:] == size[:-1]
    same[same] = same_spans(text, by_substring[1:][same], by_substring[:-1][same], size[1:][same])
    name = np.r_[0, ~same].cumsum()
    named = np.empty(len(text), np.int64)
    named[by_substring] = name
    reduced = named[stars]
    if name[-1] == len(stars) - 1:
        order = by_substring
    elif name[-1] < BYTE_LIKE:
        order = stars[np.concatenate([at for at, _ in sort_suffixes(reduced, int(name[-1]) + 1, folder, hold)])[::-1]]
    else:
        order = stars[_doubled(reduced)]
    yield from induce(text, types, order, common_prefixes(text, order, alphabet), alphabet, folder, hold)
