"""Words of texts as 64-bit hashes, a whole group of texts at a time.

A word is a run of letters and digits in lower case; every character outside
ASCII counts as a letter. Where asked for, each character of a script that is
written without spaces is a word of its own.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that are worked on at once.
PART = 8_000_000
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 20), base, np.uint64))])
    return _powers[name][:n]


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


#: Code points of scripts written without spaces (Thai, Lao,
#: Burmese, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_CJK_MARKS = (0x3000, 0x303F)


def _unspaced(code: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are of words, without marks like the ideographic full stop, and
    the places before and after each character of a script without spaces."""
    lead = np.flatnonzero(code >= 0xE0)
    four = code[lead] >= 0xF0
    size = np.where(four, 4, 3)
    whole = lead + size <= len(code)
    lead, four, size = lead[whole], four[whole], size[whole]
    c = [code[lead + k].astype(np.int64) & 0x3F for k in range(3)]
    point = np.where(four, (code[lead].astype(np.int64) & 7) << 18 | c[1] << 12 | c[2] << 6, (code[lead].astype(np.int64) & 15) << 12 | c[1] << 6 | c[2])
    marks = lead[(point >= _CJK_MARKS[0]) & (point <= _CJK_MARKS[1])]
    if len(marks):
        letter = letter.copy()
        letter[(marks[:, None] + np.arange(3)).ravel()] = False
    own = np.zeros(len(lead), dtype=bool)
    for low, high in UNSPACED:
        own |= (point >= low) & (point <= high)
    cut = np.zeros(len(code) + 1, dtype=bool)
    cut[lead[own]] = True
    cut[lead[own] + size[own]] = True
    return letter, cut


def words_of(raw: bytes, split: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and hash of each word of lower-cased UTF-8; split: characters of
    scripts without spaces are words. Long texts are worked on in parts that end at
    a space or the end of a line, where every word ends."""
    parts, at = [], 0
    while at < len(raw) or not parts:
        end = len(raw)
        if end - at > PART:
            cuts = [x for x in (raw.find(b" ", at + PART), raw.find(b"\n", at + PART)) if x >= 0]
            end = min(cuts, default=end)
        start, stop, h = _words_of_part(raw[at:end], split)
        parts.append((start + at, stop + at, h))
        at = end
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _words_of_part(raw: bytes, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.frombuffer(raw, np.uint8)
    letter = _WORD_BYTE[code]
    if split and len(code) and code.max() >= 0xE0:
        letter, cut = _unspaced(code, letter)
        here, before = np.append(letter, False), np.insert(letter, 0, False)
        start, end = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
    else:
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _power("up", len(code)), out=total[1:])
    h = (total[end] - total[start]) * _power("down", len(code) + 1)[start]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return start, end, h ^ (h >> np.uint64(29))


def words_of_texts(texts: list[str | None], split: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, start, end and hash of each word, and where the words of
    each text begin, and end, in those."""
    raws = [lowered(t) for t in texts]
    raw = b"\n".join(raws)
    start, end, h = words_of(raw, split)
    limits = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    return raw, start, end, h, limits
