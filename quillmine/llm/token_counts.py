"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's symbols stand in a doubly linked list; a heap holds its adjacent
pairs by rank. The lowest rank, the leftmost among equals, is popped and merged
as long as it is still adjacent, and the pairs with the new neighbours are
pushed. The count is the initial symbols minus the merges; no ids are made.

Works for byte-level BPE vocabularies in the ``tokenizers`` format. Pre-tokens
are cut by the classes of their bytes, and repeat, so each worker keeps the
counts of those it has met in a bounded memory. Texts with characters whose
class takes more than two bytes to tell are cut by the pattern itself. Special
strings inside a text count as one token, as the library's default has it.

Cases: null text counts as empty; an empty text has no bytes and no tokens; long
texts are counted in parts that begin at white space, over which no pre-token
goes; of pairs with equal rank the leftmost is merged first; repeated rows are
counted each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .tokens import END, ODD, SPACE, classes, endings, padded, text_groups, text_parts
from .wordtable import Words

#: The byte-level splitting pattern that the vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The regex library also counts the separators U+001C to U+001F as white space.
_SPACE = r"\p{White_Space}"
#: Bits of a symbol's number.
_SYMBOL = 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is visible
    in Latin-1, else the next free code point from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in set(seen) else chr(next(free)) for b in range(256)}


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # symbols by number: bytes first, then what merges make
        number = {c: b for b, c in byte_symbols().items()}
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for i, (x, y) in enumerate(merges):
            a, b = (number.setdefault(z, len(number)) for z in (x, y))
            self.rank[a << _SYMBOL | b] = i
            self.joined.append(number.setdefault(x + y, len(number)))
        self.specials = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pattern = regex.compile(SPLIT.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s+", f"{_SPACE}+"))
        self.known = Words(self._learn)
        self.merged_short = lru_cache(maxsize=100_000)(self.merged)

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = count = len(word)
        if n < 2:
            return n
        rank, joined, push = self.rank.get, self.joined, heapq.heappush
        # symbol -1 stands at both ends, and where a symbol was merged away: it is in no pair
        parts = [*word, -1]
        left, right = list(range(-1, n)), list(range(1, n + 1))
        bits = n.bit_length()
        pairs = map(rank, [a << _SYMBOL | b for a, b in zip(word, word[1:])])
        heap = [r << bits | i for i, r in enumerate(pairs) if r is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            r, i = x >> bits, x & (1 << bits) - 1
            j = right[i]
            if rank(parts[i] << _SYMBOL | parts[j]) != r:  # one of the two has been merged since
                continue
            made = parts[i] = joined[r]
            parts[j] = -1
            right[i] = k = right[j]
            left[k] = i
            if (new := rank(made << _SYMBOL | parts[k])) is not None:
                push(heap, new << bits | i)
            h = left[i]
            if (new := rank(parts[h] << _SYMBOL | made)) is not None:
                push(heap, new << bits | h)
            count -= 1
        return count

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.empty(0, np.int64), np.fromiter(map(self.merged, words), dtype=np.int64, count=len(words))

    def _by_pattern(self, text: str) -> int:
        words = (w.encode("utf-8", "surrogatepass") for w in self.pattern.findall(text))
        return sum(self.merged_short(w) if len(w) <= 64 else self.merged(w) for w in words)

    def _slow(self, text: str) -> int:
        """Of any text."""
        if self.cut is None or not self.cut.search(text):
            return self._by_pattern(text)
        return sum(self._by_pattern(t) for t in self.cut.split(text) if t) + len(self.cut.findall(text))

    def _group(self, texts: list[str]) -> list[int]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\0".join(raws)
        raw = padded(data)
        limits = np.cumsum([0, *(len(r) + 1 for r in raws)])
        kind = classes(raw, each_digit=False)
        inside = np.ones(len(raw), dtype=bool)
        inside[limits[1:] - 1] = False
        inside[len(data) :] = False
        odd = np.flatnonzero(((kind == ODD) | (kind == END)) & inside)
        whole = set(np.unique(np.searchsorted(limits, odd, "right") - 1).tolist())
        for s in self.specials:
            if s.encode() in data:
                whole.update(i for i, t in enumerate(texts) if s in t)
        edge = np.empty(len(raw), dtype=bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        # white space before a word: its last character stands apart, or is the word's if it is a space
        at = np.flatnonzero(edge)
        before = np.flatnonzero((kind[at[:-1]] == SPACE) & (kind[at[1:]] != END))
        after = at[before + 1]
        edge[after - 1] = True
        edge[after[raw[after - 1] == 0x20]] = False
        endings(raw, kind, edge)
        at = np.flatnonzero(edge)
        real = kind[at[:-1]] != END
        start, end = at[:-1][real], at[1:][real]
        where = np.searchsorted(start, limits)
        if whole:
            stays = np.ones(len(start), dtype=bool)
            for t in whole:
                stays[where[t] : where[t + 1]] = False
            start, end = start[stays], end[stays]
            where = np.searchsorted(start, limits)
        entry = self.known.lookup(data, raw, start, end)
        total = np.concatenate([[0], np.cumsum(self.known.count[entry])])[where]
        return [self._slow(texts[i]) if i in whole else n for i, n in enumerate(np.diff(total).tolist())]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [[t] if any(s in t for s in self.specials) else list(text_parts(t)) for t in texts]
        flat = [p for some in parts for p in some]
        got = iter([n for a, b in text_groups(flat) for n in self._group(flat[a:b])])
        return [sum(next(got) for _ in some) for some in parts]


_loaded: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def count(batches):
        if tokenizer not in _loaded:
            _loaded[tokenizer] = MergeCounter(tokenizer)
        lib = _loaded[tokenizer]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [x for a, b in text_groups(texts) for x in lib.counts(texts[a:b])]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
