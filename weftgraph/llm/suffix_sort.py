"""Suffix order and common-prefix lengths by external induced sorting.

The suffixes at local minima (LMS) are sorted first; the order of all others is induced from theirs in
two scans.  The scans read queues by leading character: each suffix, when its turn comes,
pushes its predecessor in the text, with the length of the prefix that it has in common with the suffix
pushed to that character before it.  Pushes arrive in order, so a character's part of the
priority queue is a sequence: it grows at its end, in memory up to a budget and then in a file.
Elements are processed in chunks of ``CHUNK`` by numpy.

LMS suffixes are sorted through names of LMS substrings: a first induction sorts the substrings, equal
ones get equal names, and the string of names (a third of the text at most) is sorted in
turn.  Its alphabet is too large for queues by character, so that level is sorted by
prefix doubling instead.

Common-prefix lengths are capped: what is asked is whether they reach a width.

Arrays of a text's length lie in memory-mapped files for texts beyond ``LARGE``; the folder goes when the
sort is done.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np

from weftgraph.llm.kernel import BYTE_VALUE, mix

CHUNK = 1 << 16
LARGE = 3 << 19  # a shard and a half
ITEM = np.dtype([("at", "<i4"), ("lcp", "<i4")])


class Store:
    """Makes arrays: in memory, or mapped to files of a folder that lasts as long as the store is open."""

    def __init__(self, n: int):
        self.folder = tempfile.TemporaryDirectory(prefix="suffixes-") if n > LARGE else None
        self.made = 0

    def array(self, n: int, kind: np.dtype | type) -> np.ndarray:
        if self.folder is None or not n:
            return np.empty(n, kind)
        self.made += 1
        return np.memmap(os.path.join(self.folder.name, str(self.made)), kind, "w+", shape=(n,))

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        if self.folder:
            self.folder.cleanup()


class SliceHash:
    """Hashes of slices of a text: h(i + 1) = h(i) * P + value, so a slice's is h(end) - h(start) * P ** length."""

    BASE, BITS = 0x9E3779B97F4A7C15, 14

    def __init__(self, text: np.ndarray, values: np.ndarray, store: Store):
        size = 1 << self.BITS
        base = np.uint64(self.BASE)
        self.low = np.cumprod(np.append(np.uint64(1), np.full(size, base)), dtype=np.uint64)
        self.high = np.cumprod(np.append(np.uint64(1), np.full(len(text) // size + 1, self.low[size])), dtype=np.uint64)
        inverse = np.cumprod(np.append(np.uint64(1), np.full(size, pow(self.BASE, -1, 2**64), np.uint64)), dtype=np.uint64)
        self.sums = store.array(len(text) + 1, np.uint64)
        self.sums[0] = last = np.uint64(0)
        for at in range(0, len(text), size):
            part = values[text[at : at + size]]
            n = len(part)
            run = np.cumsum(part * inverse[1 : n + 1], dtype=np.uint64)
            self.sums[at + 1 : at + n + 1] = (run + last) * self.low[1 : n + 1]
            last = self.sums[at + n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        power = self.low[length & ((1 << self.BITS) - 1)] * self.high[length >> self.BITS]
        return mix(self.sums[end] - self.sums[start] * power)


class CharacterQueue:
    """A priority queue of (character, order of arrival) with elements (position, lcp), on disk beyond ``budget`` elements."""

    def __init__(self, alphabet: int, budget: int):
        self.memory: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
        self.files: dict[int, tuple[str, int]] = {}  # and how much of each was read
        self.folder: str | None = None
        self.held, self.budget = 0, budget

    def push(self, char: int, items: np.ndarray) -> None:
        self.memory[char].append(items)
        self.held += len(items)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="suffixes-")
        for char, parts in enumerate(self.memory):
            if parts:
                name, _ = self.files.setdefault(char, (os.path.join(self.folder, str(char)), 0))
                with open(name, "ab") as f:
                    for p in parts:
                        f.write(p.tobytes())
                parts.clear()
        self.held = 0

    def pop(self, char: int) -> np.ndarray | None:
        """Next elements of ``char`` (a chunk's worth from disk, or all that memory holds), or None."""
        if char in self.files:  # what was spilled came before what memory holds
            name, read = self.files[char]
            out = np.fromfile(name, ITEM, CHUNK, offset=read * ITEM.itemsize)
            self.files[char] = name, read + len(out)
            if (read + len(out)) * ITEM.itemsize >= os.path.getsize(name):
                del self.files[char]
                os.unlink(name)
            return out
        parts = self.memory[char]
        if not parts:
            return None
        out = parts[0] if len(parts) == 1 else np.concatenate(parts)
        self.held -= len(out)
        self.memory[char] = []
        return out

    def close(self) -> None:
        for name, _ in self.files.values():
            with contextlib.suppress(FileNotFoundError):
                os.unlink(name)
        if self.folder:
            os.rmdir(self.folder)


class Pusher:
    """Pushes predecessors, with common-prefix lengths: the least since the last push to the same character, plus one.

    Without ``carry`` the lengths aren't asked for and stay 0.
    """

    def __init__(self, queue: CharacterQueue, alphabet: int, cap: int, carry: bool = True):
        self.queue, self.cap, self.carry = queue, cap, carry
        self.least = np.full(alphabet, cap, np.int32)  # since the last push to a character
        self.least[:] = 0  # nothing was pushed: the first has no neighbour

    def scan(self, lcp: np.ndarray, source: np.ndarray, target: np.ndarray, at: np.ndarray) -> None:
        """``lcp``: of the scanned elements, each with the one before; ``source``: which of them push; to ``target``, the position ``at``."""
        for begin in range(0, len(lcp), CHUNK):
            end = min(begin + CHUNK, len(lcp))
            a, b = np.searchsorted(source, (begin, end))
            self._chunk(lcp[begin:end], source[a:b] - begin, target[a:b], at[a:b])

    def _chunk(self, lcp: np.ndarray, source: np.ndarray, target: np.ndarray, at: np.ndarray) -> None:
        if not self.carry:
            if len(source):
                order = np.argsort(target.astype(np.int16), kind="stable")
                self._push(target[order], at[order], np.zeros(len(at), np.int32))
            return
        if not len(source):
            np.minimum(self.least, lcp.min(initial=self.cap), out=self.least)
            return
        table = [lcp]
        while 2 << (len(table) - 1) <= len(lcp):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        order = np.argsort(target.astype(np.int16), kind="stable")
        source, target, at = source[order], target[order], at[order]
        first = np.append(True, target[1:] != target[:-1])
        low = np.where(first, 0, np.append(0, source[:-1]) + 1)  # after the last push to the character
        low_least = self._range(table, low, source + 1)
        value = np.where(first, np.minimum(self.least[target], low_least), low_least)
        value = np.minimum(value + 1, self.cap).astype(np.int32)
        started = first & (self.least[target] < 0)
        value[started] = 0
        whole = lcp.min()
        np.minimum(self.least, whole, out=self.least)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(target)) - 1
        rest = np.full(len(tails), self.cap, np.int32)
        some = source[tails] + 1 < len(lcp)
        rest[some] = self._range(table, source[tails][some] + 1, np.full(some.sum(), len(lcp)))
        self.least[target[tails]] = rest
        self._push(target, at, value)

    def _push(self, target: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Elements in order of ``target``."""
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        items = np.empty(len(at), ITEM)
        items["at"], items["lcp"] = at, value
        for h, t in zip(heads.tolist(), [*heads[1:].tolist(), len(target)], strict=True):
            self.queue.push(int(target[h]), items[h:t])

    @staticmethod
    def _range(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
        level = np.where((1 << (level + 1)) <= high - low, level + 1, level)
        out = np.zeros(len(low), np.int32)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << k)])
        return out


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the suffix smaller than the next one's, length of the run of equal characters from here)."""
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1).astype(np.int32)  # last place of each run
    size = np.diff(change, prepend=np.int32(-1))
    after = np.append(text, text.dtype.type(0))[change + 1]
    small = np.repeat(text[change] < after, size)
    small[n - int(size[-1]) :] = True
    return small, np.repeat(change, size) - np.arange(n, dtype=np.int32) + np.int32(1)


def _induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray, alphabet: int, cap: int, budget: int, store: Store, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and (with ``carry``) each one's common prefix with the one before, from the LMS suffixes' (grouped by character)."""
    n = len(text)
    heads = np.searchsorted(text[lms], np.arange(alphabet + 1))
    queue = CharacterQueue(alphabet, budget)
    larges, ends = store.array(n, ITEM), [0]
    try:
        pusher = Pusher(queue, alphabet, cap, carry)
        pusher.least[:] = -1
        for c in range(alphabet):
            filled, last = ends[-1], None
            while (batch := queue.pop(c)) is not None:
                if last is None:
                    batch["lcp"][0] = 0
                at = batch["at"]
                before = at - 1
                source = np.flatnonzero(before >= 0)
                target = text[before[source]]
                keep = (target > c) | ((target == c))
                keep &= ~small[before[source]]
                source = source[keep]
                pusher.scan(batch["lcp"], source, text[before[source]].astype(np.int64), before[source])
                larges[filled : filled + len(batch)] = batch
                filled += len(batch)
                last = at[-1]
            ends.append(filled)
            mine = slice(heads[c], heads[c + 1])
            if heads[c + 1] > heads[c]:
                at, lcp = lms[mine], lms_lcp[mine].copy()
                lcp[0] = 0 if last is None else min(run[last], run[at[0]], cap)
                source = np.flatnonzero(at > 0)
                before = at[source] - 1
                pusher.scan(lcp, source, text[before].astype(np.int64), before)
    finally:
        queue.close()
    queue = CharacterQueue(alphabet, budget)
    order, lcps, free = store.array(n, np.int32), store.array(n, np.int32), n
    try:
        pusher = Pusher(queue, alphabet, cap, carry)
        pusher.least[:] = -1
        for c in range(alphabet - 1, -1, -1):
            smalls: list[np.ndarray] = []
            last = None
            while (batch := queue.pop(c)) is not None:
                if last is None:
                    batch["lcp"][0] = 0
                at = batch["at"]
                source = np.flatnonzero(at > 0)
                before = at[source] - 1
                keep = small[before] & (text[before] <= c)
                pusher.scan(batch["lcp"], source[keep], text[before[keep]].astype(np.int64), before[keep])
                smalls.append(batch)
                last = at[-1]
            large = np.asarray(larges[ends[c] : ends[c + 1]])
            if len(large):
                at = large["at"][::-1]
                lcp = np.append(0, large["lcp"][:0:-1]).astype(np.int32)
                if last is not None:
                    lcp[0] = min(run[last], run[at[0]], cap)
                source = np.flatnonzero(at > 0)
                before = at[source] - 1
                keep = small[before] & (text[before] <= c)
                pusher.scan(lcp, source[keep], text[before[keep]].astype(np.int64), before[keep])
            up = np.concatenate(smalls)[::-1] if smalls else np.empty(0, ITEM)
            at = np.concatenate([large["at"], up["at"]])
            lcp = np.concatenate([large["lcp"], np.append(0, up["lcp"][:-1]).astype(np.int32) if len(up) else up["lcp"]])
            if len(up):
                lcp[len(large)] = min(run[large["at"][-1]], run[up["at"][0]], cap) if len(large) else 0
            if len(at):
                lcp[0] = 0
                order[free - len(at) : free], lcps[free - len(at) : free] = at, lcp
                free -= len(at)
    finally:
        queue.close()
    return order[free:], lcps[free:]  # all but the end, which nothing induces


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of small whole numbers, in order: prefix doubling."""
    n = len(names)
    rank = names.astype(np.int64) + 1
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:]
        key = rank * (max(int(rank.max()), n) + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(1, key[order][1:] != key[order][:-1]))
        if new[order[-1]] == n or width >= n:
            return order
        rank, width = new, width * 2


def _common(hashes: SliceHash, a: np.ndarray, b: np.ndarray, n: int, cap: int) -> np.ndarray:
    """Common prefix of suffixes a and b, by bisection over hashes of their prefixes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(cap, n - np.maximum(a, b))
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low.astype(np.int32)


def suffix_order(text: np.ndarray, cap: int, alphabet: int = 257, budget: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the suffixes in order, common prefix of each with the one before, ``cap`` at most).

    ``text``: small whole numbers below ``alphabet``; its end counts as smaller than any
    character.  ``budget``: queue elements held in memory.
    """
    plain = text
    alphabet, n = alphabet + 1, len(plain) + 1
    with Store(n) as store:
        text = store.array(n, np.int16)
        text[:-1] = plain
        text[:-1] += 1
        text[-1] = 0  # an end smaller than all
        small, run = _types(text)
        lms = np.flatnonzero(small & ~np.append(True, small[:-1])).astype(np.int32)
        if not len(lms) or lms[-1] != n - 1:
            lms = np.append(lms, np.int32(n - 1))
        order, lcp = lms, np.zeros(len(lms), np.int32)
        if len(lms) > 1:
            values = np.append(BYTE_VALUE, np.full(max(0, alphabet - 256), 0x1234567, np.uint64))
            hashes = SliceHash(text, values, store)
            order = _sorted_lms(text, small, run, lms, hashes, alphabet, cap, budget)
            for at in range(1, len(order), CHUNK):
                lcp[at : at + CHUNK] = _common(hashes, order[at - 1 : at - 1 + CHUNK][: len(order) - at], order[at : at + CHUNK], n, cap)
            del hashes
        order, lcp = _induce(text, small, run, order, lcp, alphabet, cap, budget, store)
        keep = order != n - 1
        return order[keep], lcp[keep]


def _sorted_lms(text: np.ndarray, small: np.ndarray, run: np.ndarray, lms: np.ndarray, hashes: SliceHash, alphabet: int, cap: int, budget: int) -> np.ndarray:
    """LMS suffixes in order."""
    n = len(text)
    grouped = lms[np.argsort(text[lms], kind="stable")]
    with Store(n) as store:
        order, _ = _induce(text, small, run, grouped, np.zeros(len(lms), np.int32), alphabet, cap, budget, store, carry=False)
        mark = np.zeros(n, bool)
        mark[lms] = True
        order = np.append(np.int32(n - 1), order[mark[order] & (order != n - 1)])
    place = np.searchsorted(lms, order)
    end = np.minimum(np.append(lms[1:], np.int32(n - 1))[place] + 1, n)
    h, size = hashes.of(order, end), end - order
    name = np.cumsum(np.append(0, (h[1:] != h[:-1]) | (size[1:] != size[:-1])))
    if name[-1] + 1 == len(lms):
        return order
    names = np.empty(len(lms), np.int64)
    names[place] = name
    return lms[_sort_names(names)]
