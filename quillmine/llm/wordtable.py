"""What a worker remembers of words, looked up for many words at once.

A word of up to 16 bytes, or of up to 64 in a second table, is its own key: its
bytes as 64-bit numbers, zero-filled (no word holds a zero byte). Keys stand in
open-addressing tables of fixed size, so a lookup compares whole words and is
exact. Longer words are learned each time they come. Both the number of words
and their bytes are bounded: when the memory is full, words that were not used
since it last was are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Zero bytes that must follow the text in a buffer.
PAD = 64


class _Table:
    def __init__(self, width: int, bits: int):
        self.width, self.bits = width, bits
        self.clear()

    def clear(self) -> None:
        self.words = np.zeros((self.width, 1 << self.bits), dtype=np.uint64)
        self.entry = np.full(1 << self.bits, -1, dtype=np.int32)
        self.filled = 0

    def room(self, n: int) -> bool:
        return 4 * (self.filled + n) <= 3 << self.bits

    def keys(self, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        return [eight[start + 8 * k] & _KEEP[np.clip(size - 8 * k, 0, 8)] for k in range(self.width)]

    def hashes(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * _MIX[0]
        for k in keys[1:]:
            h ^= h >> np.uint64(32)
            h = (h ^ k) * _MIX[1]
        return (h ^ (h >> np.uint64(29))) * _MIX[0]

    def _is(self, slot: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        same = self.words[0][slot] == keys[0]
        for w, k in zip(self.words[1:], keys[1:]):
            same &= w[slot] == k
        return same

    def find(self, keys: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.entry[slot]
        same = self._is(slot, keys)
        todo = np.flatnonzero(~same & (out >= 0))
        out[~same] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = slot[todo]
            same = self._is(at, [k[todo] for k in keys])
            out[todo[same]] = self.entry[at[same]]
            todo = todo[~same & (self.entry[at] >= 0)]
        return out

    def add(self, keys: list[np.ndarray], h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        self.filled += len(h)
        while len(todo):
            free = self.entry[slot[todo]] < 0
            some = todo[free]
            self.entry[slot[some]] = entry[some]  # of several for one place, one wins
            won = self.entry[slot[some]] == entry[some]
            for w, k in zip(self.words, keys):
                w[slot[some[won]]] = k[some[won]]
            todo = np.concatenate([todo[~free], some[~won]])
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def kept(self, entry: np.ndarray) -> None:
        """Only words with a new entry number stay."""
        at = np.flatnonzero(self.entry >= 0)
        new = entry[self.entry[at]]
        at, new = at[new >= 0], new[new >= 0]
        keys = [w[at] for w in self.words]
        self.clear()
        self.add(keys, self.hashes(keys), new.astype(np.int32))


class Words:
    """learn: words as bytes -> (values of all words, how many each has). An entry
    e has flat[begin[e] : begin[e] + count[e]]."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.int64, bits: int = 20):
        self.learn = learn
        self.tables = (_Table(2, bits), _Table(8, bits - 4))
        self.limits = (16, 64)
        self.most = 1 << (bits - 1)
        self.flat = np.empty(0, dtype)
        self.begin, self.count, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.n, self.n_flat, self.full = 0, 0, False

    def _grown(self, old: np.ndarray, n: int) -> np.ndarray:
        if n <= len(old):
            return old
        out = np.zeros(max(n, 2 * len(old), 1 << 16), dtype=old.dtype)
        out[: len(old)] = old
        return out

    def _new(self, words: list[bytes]) -> np.ndarray:
        values, counts = self.learn(words)
        n, m = self.n + len(words), self.n_flat + len(values)
        self.flat = self._grown(self.flat, m)
        self.begin, self.count, self.used = (self._grown(x, n) for x in (self.begin, self.count, self.used))
        self.flat[self.n_flat : m] = values
        self.begin[self.n : n] = self.n_flat + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        self.used[self.n : n] = True
        out = np.arange(self.n, n, dtype=np.int32)
        self.n, self.n_flat = n, m
        return out

    def _forget(self) -> None:
        """Keep the words used since the last time, if they are few enough."""
        stays = np.zeros(self.n, dtype=bool)
        for t in self.tables:
            at = t.entry[t.entry >= 0]
            at = at[self.used[at]]
            if 4 * len(at) <= 1 << t.bits:
                stays[at] = True
        old = np.flatnonzero(stays)
        new = np.full(self.n, -1, dtype=np.int64)
        new[old] = np.arange(len(old))
        for t in self.tables:
            t.kept(new)
        begin, count = self.begin[old], self.count[old]
        self.flat = self.values(old.astype(np.int32)) if len(self.flat) else self.flat
        self.begin, self.count, self.used = np.cumsum(count) - count, count, np.zeros(len(begin), bool)
        self.n, self.n_flat, self.full = len(old), len(self.flat), False

    def lookup(self, data: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each word; raw is data with PAD zero bytes after it. Entries
        hold until the next lookup."""
        if self.full or self.n > self.most:
            self._forget()
        size = end - start
        out = np.empty(len(start), dtype=np.int32)
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        low = 0
        for table, high in zip(self.tables, self.limits):
            at = np.flatnonzero((size > low) & (size <= high))
            low = high
            if not len(at):
                continue
            keys = table.keys(eight, start[at], size[at])
            h = table.hashes(keys)
            found = table.find(keys, h)
            miss = np.flatnonzero(found < 0)
            if len(miss):
                _, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
                if not all((k[miss] == k[miss[first]][which]).all() for k in keys):
                    first = which = np.arange(len(miss))  # two words with one hash: each on its own
                one = miss[first]
                words = [data[a:b] for a, b in zip(start[at[one]].tolist(), end[at[one]].tolist())]
                entry = self._new(words)
                if table.room(len(one)):
                    table.add([k[one] for k in keys], h[one], entry)
                else:  # known for this lookup only
                    self.full = True
                found[miss] = entry[which]
            out[at] = found
        at = np.flatnonzero(size > low)
        if len(at):
            words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            one = {w: i for i, w in enumerate(dict.fromkeys(words))}
            out[at] = self._new(list(one))[[one[w] for w in words]]
        self.used[out] = True
        return out

    def values(self, entry: np.ndarray) -> np.ndarray:
        """The values of the entries, one after the other."""
        count = self.count[entry]
        end = np.cumsum(count)
        return self.flat[np.repeat(self.begin[entry] - (end - count), count) + np.arange(end[-1] if len(end) else 0)]
