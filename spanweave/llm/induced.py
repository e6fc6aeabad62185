"""Suffix order and common prefixes of one shard by external induced sorting.

The shard's suffixes are typed L or S; the leftmost S suffixes (S*) are ordered by naming the substrings
between them and recursing on the shorter string of names. From them the L suffixes are induced in
ascending symbol order and from those all S suffixes in descending order. Both inductions run on
disk-backed priority queues keyed by a suffix's first symbol: a tuple is a suffix's place and the length
of the prefix it shares with the tuple before it. Whole batches of equal keys are popped at a time, so
the work is array work; a queue above its memory budget moves its tuples to a scratch file, which is
removed with the queue.

Orders and lengths are exact up to `depth` symbols; suffixes equal that far may stand in any order.
"""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

BUDGET = 64 << 20
IN_MEMORY = 1 << 20  # names; longer strings of names are ordered by recursion


class DiskQueue:
    """A priority queue of (place, prefix) tuples by integer key; equal keys leave in the order they came."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.held, self.file = budget, 0, None
        self.memory: dict[int, list] = defaultdict(list)
        self.spilled: dict[int, list] = defaultdict(list)
        self.heap: list[int] = []
        self.known: set[int] = set()

    def push(self, keys: np.ndarray, places: np.ndarray, prefixes: np.ndarray) -> None:
        """keys in ascending order."""
        if not len(keys):
            return
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        begin = [0, *cut.tolist()]
        for a, b, key in zip(begin, [*begin[1:], len(keys)], keys[begin].tolist(), strict=True):
            self.memory[key].append((places[a:b], prefixes[a:b]))
            if key not in self.known:
                self.known.add(key)
                heapq.heappush(self.heap, key)
        self.held += len(keys) * 9
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.seek(0, 2)
        for key, parts in self.memory.items():
            at, n = self.file.tell(), sum(len(p) for p, _ in parts)
            for p, _ in parts:
                self.file.write(p.astype(np.int64).tobytes())
            for _, c in parts:
                self.file.write(c.astype(np.uint8).tobytes())
            self.spilled[key].append((at, n))
        self.memory.clear()
        self.held = 0

    def least(self) -> int | None:
        return self.heap[0] if self.heap else None

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of this key so far."""
        parts = []
        for at, n in self.spilled.pop(key, ()):
            self.file.seek(at)
            parts.append((np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)))
        more = self.memory.pop(key, [])
        self.held -= sum(len(p) for p, _ in more) * 9
        parts += more
        if key in self.known:
            self.known.discard(key)
            self.heap.remove(key) if self.heap[0] != key else heapq.heappop(self.heap)
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Range minima over one batch of prefix lengths."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo:hi] for each pair; every range holds something."""
        level = np.log2(hi - lo).astype(np.int64)
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            t = self.levels[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        return out


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S: smaller than the suffix behind it. The end counts as smaller than every symbol."""
    n = len(text)
    if not n:
        return np.empty(0, bool)
    turn = np.append(text[:-1] != text[1:], True)
    nearest = np.minimum.accumulate(np.where(turn, np.arange(n), n)[::-1])[::-1]
    less = np.append(text[:-1] < text[1:], False)
    return less[nearest]


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by key; a rank is the number of items in earlier groups. Returns those
    of `active` that still share their rank."""
    order = np.lexsort((key, rank[active]))
    a = active[order]
    r, k = rank[a], key[order]
    new_group = np.append(True, r[1:] != r[:-1])
    new_part = new_group.copy()
    new_part[1:] |= k[1:] != k[:-1]
    at = np.arange(len(a))
    group = np.maximum.accumulate(np.where(new_group, at, 0))
    part = np.maximum.accumulate(np.where(new_part, at, 0))
    rank[a] = r + part - group
    alone = new_part & np.append(new_part[1:], True)
    return a[~alone]


def _names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """For each S* substring the number of smaller ones; equal substrings get equal names."""
    symbols = (text.astype(np.int64) + 1) * 2 + is_s
    bits = max(1, int(symbols.max()).bit_length())
    each = max(1, 63 // bits)
    lengths = np.append(stars[1:] + 1, len(text)) - stars
    rank = np.zeros(len(stars), np.int64)
    active, offset = np.arange(len(stars)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for j in range(each):
            at = stars[active] + offset + j
            inside = offset + j < lengths[active]
            key = (key << bits) | np.where(inside, symbols[np.minimum(at, len(text) - 1)], 0)
        active = _refine(rank, active, key)
        offset += each
        active = active[lengths[active] > offset]
    return rank


def star_order(text: np.ndarray, is_s: np.ndarray, depth: int, budget: int = BUDGET, in_memory: int = IN_MEMORY) -> np.ndarray:
    """The S* suffixes in order."""
    stars = np.flatnonzero(is_s & ~np.append(True, is_s[:-1]))
    if not len(stars):
        return stars
    rank = _names(text, is_s, stars)
    found = np.unique(rank)
    if len(found) < len(stars):
        names = np.searchsorted(found, rank)
        if len(names) <= in_memory:
            order = np.argsort(rank, kind="stable")
            same = rank[order][1:] == rank[order][:-1]
            active = order[np.append(False, same) | np.append(same, False)]
            h = 1
            while len(active) and h < depth:  # each name stands for two symbols at least
                behind = np.where(active + h < len(rank), rank[np.minimum(active + h, len(rank) - 1)], -1)
                active = _refine(rank, active, behind)
                h *= 2
        else:
            parts = [p for p, _ in induced_order(names, depth, budget, in_memory, prefixes=False)]
            rank[np.concatenate(parts)[::-1]] = np.arange(len(rank))
    return stars[np.argsort(rank, kind="stable")]


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros behind the end), the first one lowest."""
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j : len(text) + j] << np.uint64(8 * j)
    return out


def shared_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at a and b share, at most depth."""
    n = len(words)
    out = np.full(len(a), depth, np.int64)
    active = np.arange(len(a))
    for at in range(0, depth, 8):
        x, y = a[active] + at, b[active] + at
        inside = (x < n) & (y < n)
        differ = np.where(inside, words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)], np.uint64(1))
        off = np.flatnonzero(differ)
        if len(off):
            low = differ[off] & (~differ[off] + np.uint64(1))
            out[active[off]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        active = active[differ == 0]
        if not len(active):
            break
    reach = np.minimum(n - a, n - b)
    return np.minimum(np.minimum(out, reach), depth)


class _Induction:
    """One pass: popped batches in stream order, their predecessors of the wanted type pushed on."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, sign: int, depth: int, budget: int, prefixes: bool):
        self.text, self.wanted, self.sign, self.depth, self.prefixes = text, wanted, sign, depth, prefixes
        self.queue = DiskQueue(budget)
        top = int(text.max()) + 1
        self.seen = np.zeros(top, bool)
        self.since = np.full(top, depth if prefixes else 0, np.uint8)  # least shared prefix since a key's last push

    def feed(self, places: np.ndarray, shared: np.ndarray) -> None:
        before = places - 1
        at = np.flatnonzero((places > 0) & self.wanted[before])
        if len(at):
            keys = self.text[before[at]]
            order = np.argsort(keys if self.sign > 0 else -keys.astype(np.int64), kind="stable")
            keys, at = keys[order], at[order]
        if not self.prefixes:
            if len(at):
                self.queue.push(self.sign * keys.astype(np.int64), before[at], np.zeros(len(at), np.uint8))
            return
        if not len(at):
            np.minimum(self.since, shared.min(initial=255), out=self.since)
            return
        minima = _Minima(shared)
        first = np.append(True, keys[1:] != keys[:-1])
        lo = np.where(first, 0, np.append(0, at[:-1] + 1))
        common = minima.over(lo, at + 1)
        heads = keys[first]
        common[first] = np.minimum(common[first], self.since[heads])
        grown = np.minimum(common.astype(np.int64) + 1, self.depth)
        grown[np.flatnonzero(first)[~self.seen[heads]]] = 0  # nothing of this key before it
        self.seen[heads] = True
        np.minimum(self.since, shared.min(), out=self.since)
        last = at[np.append(first[1:], True)]
        rest = np.full(len(last), self.depth, np.uint8)
        more = last + 1 < len(shared)
        rest[more] = minima.over(last[more] + 1, np.full(int(more.sum()), len(shared)))
        self.since[heads] = rest
        self.queue.push(self.sign * keys.astype(np.int64), before[at], grown.astype(np.uint8))


def induced_order(text: np.ndarray, depth: int, budget: int = BUDGET, in_memory: int = IN_MEMORY, prefixes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in batches (places, shared): shared[i] is the length, up to depth,
    of the prefix that places[i] shares with the suffix before it in this order. With prefixes, text is bytes."""
    if not len(text):
        return
    if depth > 255:
        raise ValueError("depth must fit a byte")
    is_s = suffix_types(text)
    stars = star_order(text, is_s, depth, budget, in_memory)
    none = np.zeros(len(stars), np.uint8)
    words = words_of(text) if prefixes else None
    if prefixes and len(stars):
        none[1:] = shared_prefix(words, stars[:-1], stars[1:], depth)
    star_keys = text[stars]

    def border(a: np.ndarray, b: np.ndarray) -> int:
        return int(shared_prefix(words, a[-1:], b[:1], depth)[0]) if prefixes and len(a) and len(b) else 0

    ascending = _Induction(text, ~is_s, 1, depth, budget, prefixes)
    larger = DiskQueue(budget)  # the L suffixes by symbol, in order
    ascending.queue.push(text[-1:].astype(np.int64), np.array([len(text) - 1]), np.zeros(1, np.uint8))
    ascending.seen[text[-1]] = True
    ascending.since[text[-1]] = 0
    done = 0
    while True:
        symbols = [s for s in (ascending.queue.least(), int(star_keys[done]) if done < len(stars) else None) if s is not None]
        if not symbols:
            break
        c = min(symbols)
        tail = np.empty(0, np.int64)
        while ascending.queue.least() == c:
            places, shared = ascending.queue.pop(c)
            larger.push(np.full(len(places), c), places, shared)
            ascending.feed(places, shared)
            tail = places
        end = int(np.searchsorted(star_keys, c, side="right"))
        if end > done:
            shared = none[done:end].copy()
            shared[0] = border(tail, stars[done:end])
            ascending.feed(stars[done:end], shared)
            done = end
    ascending.queue.close()

    descending = _Induction(text, is_s, -1, depth, budget, prefixes)
    for c in np.unique(text)[::-1].tolist():
        tail = np.empty(0, np.int64)
        while descending.queue.least() == -c:
            places, shared = descending.queue.pop(-c)
            descending.feed(places, shared)
            yield places, shared
            tail = places
        places, shared = larger.pop(c)
        if len(places):
            places, shared = places[::-1], np.append(np.uint8(0), shared[:0:-1])
            shared[0] = border(tail, places)
            descending.feed(places, shared)
            yield places, shared
    descending.queue.close()
    larger.close()


def repeated(text: np.ndarray, depth: int, budget: int = BUDGET, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Whether the depth bytes from each place on also start at another place."""
    out = np.zeros(len(text), bool)
    last = -1
    for places, shared in induced_order(text, depth, budget, in_memory):
        full = shared >= depth
        out[places[full]] = True
        before = np.append(last, places[:-1])[full]
        out[before[before >= 0]] = True
        last = places[-1]
    return out
