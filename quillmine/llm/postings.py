"""Segments of an inverted index: documents of some megabytes of text, their terms,
and for each term its postings in compressed blocks of fixed size.

A block keeps its last document and, for the greatest score that any posting in it
can reach, those pairs (times, words of the document) that no other pair of the
block outdoes; these hold for whatever average length the collection turns out to
have. Documents and times are packed apart, so a look at who is there unpacks no
times.

A term is a run of ASCII letters and digits and of all characters beyond ASCII,
with A to Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import words_of

#: Postings of a block.
BLOCK = 128
#: Bytes of text and documents of a segment; one longer text is a segment by itself.
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 1 << 16
#: Bytes of text that are cut into terms at once.
PIECE = 1 << 20
_ARRAYS = {
    "lengths": "<i4", "hashes": "<u8", "term_bytes": "u1", "term_ends": "<i4", "frequency": "<i4", "first_block": "<i4", "last_doc": "<i4", "doc_bytes": "u1", "doc_ends": "<i4", "times_bytes": "u1",
    "times_ends": "<i4", "best_times": "<i4", "best_lengths": "<i4", "best_ends": "<i4",
}
SCHEMA = "doc_ids array<long>, n_docs long, n_terms long, " + ", ".join(f"{name} binary" for name in _ARRAYS)
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *((name, pa.binary()) for name in _ARRAYS)])


def terms_of(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lowered bytes, start, end and hash of terms, and the number of each one's text,
    some texts at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        raw = b"\n".join(texts[at:end]).lower()
        start, stop, h = words_of(raw)
        limits = np.cumsum([len(t) + 1 for t in texts[at:end]])
        yield raw, start, stop, h, at + np.searchsorted(limits, start, side="right")
        at = end


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs, one after the other."""
    ends = np.cumsum(size)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _numbered(raw: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of distinct terms, an occurrence of each, and the number of each
    occurrence's term. Terms that share a hash are told apart by their bytes."""
    hashes, first, term = np.unique(h, return_index=True, return_inverse=True)
    differs = size != size[first][term]
    for at in range(0, len(start), 1 << 18):
        part = slice(at, at + (1 << 18))
        rows = np.flatnonzero(~differs[part]) + at
        n = size[rows]
        unlike = _gathered(raw, start[rows], n) != _gathered(raw, start[first][term[rows]], n)
        if unlike.any():
            differs[rows[np.searchsorted(np.cumsum(n), np.flatnonzero(unlike), side="right")]] = True
    if differs.any():
        named: dict[bytes, int] = {}
        number = np.array([named.setdefault(raw[s : s + n].tobytes(), len(named)) for s, n in zip(start, size)])
        first = np.unique(number, return_index=True)[1]
        order = np.argsort(h[first], kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return h[first][order], first[order], back[number]
    return hashes, first, term


def packed_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the last with its high bit clear, and
    where each number ends."""
    x = x.astype(np.int64)
    size = 1 + sum((x >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(x) else 0, dtype=np.uint8)
    for k in range(5):
        rows = np.flatnonzero(size > k)
        out[ends[rows] - size[rows] + k] = x[rows] >> 7 * k & 127 | np.where(size[rows] > k + 1, 128, 0)
    return out, ends


def unpacked_numbers(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw.astype(np.int64) & 127) << 7 * place, starts)


def segment_of(ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
    """One row: the index of these documents."""
    parts, held, offset = [], [], 0
    for raw, start, stop, h, doc in terms_of(texts):
        held.append(raw)
        parts.append((start + offset, stop - start, h, doc))
        offset += len(raw)
    raw = np.frombuffer(b"".join(held), np.uint8)
    start, size, h, doc = (np.concatenate(x) if parts else np.empty(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
    lengths = np.bincount(doc, minlength=len(ids))
    hashes, first, term = _numbered(raw, start, size, h)
    key, times = np.unique(term.astype(np.int64) * len(ids) + doc, return_counts=True)
    term, doc = (key // len(ids), key % len(ids)) if len(ids) else (key, key)
    frequency = np.bincount(term, minlength=len(hashes))
    begins = np.cumsum(frequency) - frequency
    blocks = -(-frequency // BLOCK)
    first_block = np.append(0, np.cumsum(blocks))
    rank = np.arange(len(key)) - begins[term]
    opens = rank % BLOCK == 0
    at = np.flatnonzero(opens)
    closes = np.append(at[1:], len(key)) - 1 if len(key) else at
    step = np.diff(doc, prepend=0) if len(key) else doc
    step[rank == 0] = doc[rank == 0] + 1
    doc_bytes, doc_ends = packed_numbers(step)
    times_bytes, times_ends = packed_numbers(times)
    # pairs that no pair of the block outdoes: by falling times, each shorter than all before
    block, long = np.cumsum(opens) - 1, lengths[doc]
    order = np.lexsort((long, -times, block))
    floor = long[order] - block[order] * (int(long.max(initial=0)) + 1)
    best = order[np.append(True, floor[1:] < np.minimum.accumulate(floor)[:-1])] if len(key) else order
    shown = _gathered(raw, start[first], size[first])
    made = {
        "lengths": lengths, "hashes": hashes, "term_bytes": shown, "term_ends": np.cumsum(size[first]), "frequency": frequency, "first_block": first_block, "last_doc": doc[closes], "doc_bytes": doc_bytes,
        "doc_ends": doc_ends[closes] if len(key) else at, "times_bytes": times_bytes, "times_ends": times_ends[closes] if len(key) else at, "best_times": times[best], "best_lengths": long[best],
        "best_ends": np.cumsum(np.bincount(block[best], minlength=len(at))),
    }
    plain = [[ids], [int((lengths > 0).sum())], [int(lengths.sum())]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*plain, *([made[n].astype(k).tobytes()] for n, k in _ARRAYS.items())], _ARROW)], schema=_ARROW)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text as bytes) -> segments."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py() or b""
            if texts and (size + len(raw) > SEGMENT_BYTES or len(texts) >= SEGMENT_DOCS):
                yield segment_of(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield segment_of(ids, texts)


@dataclass
class Segment:
    """A row of the index, to be searched."""

    doc_ids: list[int | None]
    arrays: dict[str, np.ndarray]

    @classmethod
    def of(cls, row: dict) -> Segment:
        return cls(row["doc_ids"], {name: np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items() if row.get(name) is not None})

    def find(self, names: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        a = self.arrays
        low, out = np.searchsorted(a["hashes"], hashes), np.full(len(names), -1)
        for i in np.flatnonzero(low < len(a["hashes"])):
            at = low[i]
            while at < len(a["hashes"]) and a["hashes"][at] == hashes[i]:
                begin = a["term_ends"][at - 1] if at else 0
                if a["term_bytes"][begin : a["term_ends"][at]].tobytes() == names[i]:
                    out[i] = at
                    break
                at += 1
        return out

    def docs(self, term: int, b0: int, b1: int) -> np.ndarray:
        """The documents of a term in its blocks from b0 to before b1."""
        a = self.arrays
        base = a["last_doc"][b0 - 1] if b0 > a["first_block"][term] else -1
        return base + np.cumsum(unpacked_numbers(a["doc_bytes"][a["doc_ends"][b0 - 1] if b0 else 0 : a["doc_ends"][b1 - 1]]))

    def times(self, b0: int, b1: int) -> np.ndarray:
        a = self.arrays
        return unpacked_numbers(a["times_bytes"][a["times_ends"][b0 - 1] if b0 else 0 : a["times_ends"][b1 - 1]])
