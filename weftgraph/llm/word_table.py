"""Token ids of words, looked up by numpy: a bounded open-addressing table that compares whole words.

A word of up to ``KEY`` bytes is its own key: its bytes, as three little-endian numbers, and its length.  So a hit
is certain, and a batch of words costs a few gathers.  Longer words are kept by their bytes in a dictionary.
What is new to the table is encoded once a batch; a table that grows too full begins anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weftgraph.llm.kernel import U64, mix

KEY = 24
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_STEPS = 12  # slots that a word may stand in

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]  # ids; each word's first of them, and how many


class WordTable:
    """Word -> ids.  ``encode`` gives the ids of words that aren't known yet; ``bits``: 2**bits slots."""

    def __init__(self, encode: Encode, bits: int = 20, most_ids: int = 1 << 23):
        self.encode, self.bits, self.most_ids = encode, bits, most_ids
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        n = 1 << self.bits
        self.keys = [np.zeros(n, U64) for _ in range(KEY // 8)]
        self.length = np.zeros(n, np.uint8)  # 0: free
        self.first, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = self.words = 0

    def _keep(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new words into the pool: where each word's begin, and how many there are."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, first, count = self.encode(words)
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need - len(self.pool), len(self.pool)), np.int32)])
        self.pool[self.used : need] = ids
        first = first + self.used
        self.used = need
        return first, count

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first id in ``pool``, number of ids) of the words ``data[start:end]``; valid until the next call."""
        if self.words > (1 << self.bits) * 6 // 10 or self.used > self.most_ids or len(self.long) > 1 << 16:
            self.clear()
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        length = ends - starts
        padded = np.concatenate([data, np.zeros(KEY, np.uint8)])
        at8 = np.ndarray((len(data) + KEY - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        short = np.flatnonzero(length <= KEY)
        size = length[short]
        keys = [at8[np.minimum(starts[short] + 8 * k, len(data))] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(KEY // 8)]
        home = mix(keys[0] ^ mix(keys[1] ^ mix(keys[2] ^ size.astype(U64)))) >> U64(64 - self.bits)
        slot = self._find(keys, size, home.astype(np.int64))
        known = slot >= 0
        first[short[known]], count[short[known]] = self.first[slot[known]], self.count[slot[known]]
        if not known.all():
            lost = np.flatnonzero(~known)
            order = np.lexsort((size[lost], *(k[lost] for k in keys)))
            lost = lost[order]
            columns = [*(k[lost] for k in keys), size[lost]]
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
            heads = lost[new]
            place, n = self._keep([data[a:b].tobytes() for a, b in zip(starts[short[heads]].tolist(), ends[short[heads]].tolist(), strict=True)])
            which = np.cumsum(new) - 1
            first[short[lost]], count[short[lost]] = place[which], n[which]
            self._insert([k[heads] for k in keys], size[heads], home[heads].astype(np.int64), place, n)
        many = np.flatnonzero(length > KEY)
        if len(many):
            words = [data[a:b].tobytes() for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True)]
            fresh = [w for w in dict.fromkeys(words) if w not in self.long]
            place, n = self._keep(fresh)
            own = dict(zip(fresh, zip(place.tolist(), n.tolist(), strict=True), strict=True))
            self.long.update((w, x) for w, x in own.items() if len(w) <= 256)
            found = [own.get(w) or self.long[w] for w in words]
            first[many], count[many] = [x for x, _ in found], [x for _, x in found]
        return first, count

    def _same(self, slot: np.ndarray, keys: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        return (self.length[slot] == size) & np.logical_and.reduce([mine[slot] == k for mine, k in zip(self.keys, keys, strict=True)])

    def _find(self, keys: list[np.ndarray], size: np.ndarray, home: np.ndarray) -> np.ndarray:
        slot = np.where(self._same(home, keys, size), home, -1)
        left = np.flatnonzero((slot < 0) & (self.length[home] > 0))
        for step in range(1, _STEPS):
            if not len(left):
                break
            at = (home[left] + step) & ((1 << self.bits) - 1)
            same = self._same(at, [k[left] for k in keys], size[left])
            slot[left[same]] = at[same]
            left = left[~same & (self.length[at] > 0)]
        return slot

    def _insert(self, keys: list[np.ndarray], size: np.ndarray, home: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Distinct new words, into the first free slot from home on; those that find none aren't kept."""
        left = np.arange(len(home))
        for step in range(_STEPS):
            at = (home[left] + step) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.length[at] == 0)
            _, one = np.unique(at[free], return_index=True)  # one word a slot
            mine = free[one]
            who, where = left[mine], at[mine]
            self.length[where], self.first[where], self.count[where] = size[who], first[who], count[who]
            for table, k in zip(self.keys, keys, strict=True):
                table[where] = k[who]
            self.words += len(who)
            left = np.delete(left, mine)
            if not len(left):
                break

    def ids(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """All words' ids, end to end."""
        end = np.cumsum(count)
        return self.pool[np.repeat(first - end + count, count) + np.arange(int(end[-1]) if len(end) else 0)]
