"""A linear-chain conditional random field over shapes of words, in numpy.

Tokens are runs of letters and digits, and every other character but white space.
A token has one of some thousand types: what it is made of, case, length, digits,
whether white space stands before it, and which word or mark it is if the training
table has it often enough. A label's score at a token is a sum over the types of the
token and its neighbours, so a text's scores are look-ups in one small table.

Decoding is exact. Where no stretch of labels around a token could be worth as much
as "none", the token is "none" on the best path; Viterbi runs over what lies between
such tokens, many stretches of all texts at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

LABELS = ("none", "email", "ip", "card", "phone")
#: How far to either side neighbours count.
REACH = 3
_CASES, _DIGITS, _LENGTHS = 4, 21, 18
_PLAIN = 3 * _CASES * _DIGITS * _LENGTHS * 2
_MARKS = 128 * 2
#: Bytes of text that are cut into tokens at once, and tokens scored at once.
PIECE, CHUNK = 1 << 20, 1 << 18
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_SPACE = np.array([b <= 32 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LOW = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _cuts(raw: bytes) -> list[tuple[int, int]]:
    """Parts of about PIECE bytes that end before white space."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            found = [x for x in (raw.find(b" ", at + PIECE), raw.find(b"\n", at + PIECE)) if x >= 0]
            end = min(found, default=end)
        out.append((at, end))
        at = end
    return out


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray  # type without regard to the word
    case: np.ndarray
    space: np.ndarray
    key: np.ndarray  # up to eight lowered bytes as a number; 0 for longer words


def tokens_of(raw: bytes) -> Tokens:
    parts = [_tokens(raw, a, b) for a, b in _cuts(raw)] or [_tokens(b"", 0, 0)]
    return parts[0] if len(parts) == 1 else Tokens(*(np.concatenate([getattr(p, f) for p in parts]) for f in Tokens.__dataclass_fields__))


def _tokens(raw: bytes, begin: int, stop: int) -> Tokens:
    code = np.frombuffer(raw, np.uint8)[begin:stop]
    word, space = _WORD[code], _SPACE[code]
    before = np.concatenate([[False], word[:-1]])
    opens = word & ~before | ~word & ~space
    start = np.flatnonzero(opens)
    mark = ~word[start]
    end = start + 1
    end[~mark] = np.flatnonzero(np.concatenate([before[1:] & ~word[1:], word[-1:]])) + 1 if len(code) else end[~mark]
    sums = [np.concatenate([[0], np.cumsum(table[code], dtype=np.int32)]) for table in (_DIGIT, _UPPER)]
    digits, upper = (s[end] - s[start] for s in sums)
    length = end - start
    made = np.where(digits == 0, 0, np.where(digits == length, 1, 2))
    case = np.where(upper == 0, 0, np.where((upper == 1) & _UPPER[code[start]] & (length > 1), 1, np.where(upper + digits == length, 2, 3)))
    free = np.concatenate([[True], space[:-1]])[start] if len(code) else mark
    shape = (((made * _CASES + case) * _DIGITS + np.minimum(digits, _DIGITS - 1)) * _LENGTHS + np.minimum(length, _LENGTHS - 1)) * 2 + free
    shape = np.where(mark, _PLAIN + code[start].astype(np.int64) * 2 + free, shape)
    key = np.zeros(len(start), dtype=np.uint64)
    low = _LOW[code]
    for k in range(8):
        some = np.flatnonzero(length > k)
        key[some] |= low[start[some] + k].astype(np.uint64) << np.uint64(8 * k)
    key[(length > 8) | mark] = 0
    return Tokens(start + begin, end + begin, shape.astype(np.int32), case.astype(np.int8), free, key)


def _features(n_words: int) -> np.ndarray:
    """Six features of every type: shape, length, digits, word or mark, white space
    before it by kind, and mark with white space. The last type stands outside texts."""
    n = _PLAIN + _MARKS + n_words * _CASES * 2 + 1
    out = np.zeros((n, 6), dtype=np.int64)
    plain, rest = np.arange(_PLAIN), np.arange(_PLAIN) // 2
    length, rest = rest % _LENGTHS, rest // _LENGTHS
    digits, shape = rest % _DIGITS, rest // _DIGITS
    kind = shape // _CASES
    out[:_PLAIN] = np.stack([shape, length, np.where(kind == 1, digits, _DIGITS + digits), np.zeros(_PLAIN), kind * 2 + plain % 2, np.zeros(_PLAIN)], axis=1)
    mark = np.arange(_MARKS)
    out[_PLAIN : _PLAIN + _MARKS] = np.stack([mark * 0 + 12, mark * 0, mark * 0 + 2 * _DIGITS, 1 + mark // 2, 6 + mark % 2, 1 + mark], axis=1)
    word = np.arange(n_words * _CASES * 2)
    out[_PLAIN + _MARKS : -1] = np.stack([word // 2 % _CASES, word * 0, word * 0 + _DIGITS, 129 + word // (2 * _CASES), word % 2, word * 0], axis=1)
    out[-1] = [13, 0, 2 * _DIGITS, 129 + n_words, 8, 0]
    sizes = np.array([14, _LENGTHS, 2 * _DIGITS + 1, 130 + n_words, 9, 1 + _MARKS])
    return out + (np.cumsum(sizes) - sizes)


@dataclass
class Crf:
    words: np.ndarray  # sorted keys of the words that have types of their own
    links: np.ndarray  # (label, next label)
    scores: np.ndarray  # (distance, type, label)

    @property
    def outside(self) -> int:
        return self.scores.shape[1] - 1

    def types(self, t: Tokens) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, t.key), max(len(self.words) - 1, 0))
        known = (self.words[at] == t.key) & (t.key > 0) if len(self.words) else np.zeros(len(t.key), dtype=bool)
        return np.where(known, _PLAIN + _MARKS + (at * _CASES + t.case) * 2 + t.space, t.shape)

    def at(self, types: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores (place, label) of tokens at least REACH from either end of types."""
        return sum(self.scores[d][types[places + d - REACH]] for d in range(2 * REACH + 1))

    def open_places(self, types: np.ndarray) -> np.ndarray:
        """Tokens that may have a label on the best path. A stretch of labels is there
        only if it is worth at least as much as "none" throughout; the most that a
        stretch around a token can be worth is a greatest sum over stretches."""
        gain = np.full(len(types), -1e6)
        inner = self.links[1:, 1:].max() - self.links[0, 0]
        around = self.links[0, 1:].max() + self.links[1:, 0].max() - 2 * self.links[0, 0] - inner
        for a in range(REACH, len(types) - REACH, CHUNK):
            places = np.arange(a, min(a + CHUNK, len(types) - REACH))
            e = self.at(types, places)
            gain[places] = np.where(types[places] == self.outside, -1e6, e[:, 1:].max(axis=1) - e[:, 0] + inner)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        lowest, highest = np.minimum.accumulate(total[:-1]), np.maximum.accumulate(total[:0:-1])[::-1]
        return np.flatnonzero(highest - lowest + around > -1e-2)  # sums of single precision

    def decode(self, types: np.ndarray) -> np.ndarray:
        """The best path's labels. types: texts one after the other, each with REACH
        outside types before it, and as many at the end."""
        out = np.zeros(len(types), dtype=np.int8)
        places = self.open_places(types)
        if not len(places):
            return out
        first = np.flatnonzero(np.diff(places, prepend=-2) != 1)
        size = np.diff(np.append(first, len(places)))
        order = np.argsort(-size, kind="stable")  # longest first: at each step those still going are in front
        first, size = first[order], size[order]
        e = self.at(types, places)
        score = self.links[0] + e[first]
        back = []
        for step in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -step, side="left"))
            through = score[:n, :, None] + self.links
            back.append(through.argmax(axis=1).astype(np.int8))
            score[:n] = through.max(axis=1) + e[first[:n] + step]
        label = (score + self.links[:, 0]).argmax(axis=1)
        got = np.zeros(len(places), dtype=np.int8)
        got[first + size - 1] = label
        for step in range(len(back), 0, -1):
            n = len(back[step - 1])
            label[:n] = back[step - 1][np.arange(n), got[first[:n] + step]]
            got[first[:n] + step - 1] = label[:n]
        out[places] = got
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def fit(examples: list[tuple[bytes, list[tuple[str, int, int]]]], rounds: int = 100, rate: float = 0.15, ridge: float = 0.1, common: int = 4) -> Crf:
    """Maximum likelihood with a ridge, by adaptive steps over the whole table.
    examples: text and spans (label, start, end) in bytes. Words of up to eight bytes
    that stand in `common` examples or more have types of their own."""
    pairs_of = sorted(((tokens_of(raw), spans) for raw, spans in examples), key=lambda x: -len(x[0].start))  # longest first
    cut = [t for t, _ in pairs_of]
    held = Counter(int(k) for t in cut for k in np.unique(t.key[t.key > 0]))
    words = np.array(sorted(k for k, n in held.items() if n >= common), dtype=np.uint64)
    phi = _features(len(words))
    model = Crf(words, np.zeros((len(LABELS), len(LABELS))), np.zeros((2 * REACH + 1, len(phi), len(LABELS))))
    size = np.array([len(t.start) for t in cut])
    width, n = int(size.max(initial=1)), len(cut)
    types = np.full((n, width + 2 * REACH), model.outside)
    gold = np.zeros((n, width), dtype=np.int64)
    for i, (t, spans) in enumerate(pairs_of):
        types[i, REACH : REACH + len(t.start)] = model.types(t)
        for label, a, b in spans:
            gold[i, : len(t.start)][(t.start >= a) & (t.end <= b)] = LABELS.index(label)
    inside = np.arange(width) < size[:, None]
    going = [int((size > t).sum()) for t in range(width)]  # so many texts have a token here
    row, col = np.nonzero(inside)
    active = [phi[types[row, col + d]] for d in range(2 * REACH + 1)]
    weights = np.zeros((2 * REACH + 1, int(phi.max()) + 1, len(LABELS)))
    links = np.zeros_like(model.links)
    memory = [np.full_like(weights, 1e-6), np.full_like(links, 1e-6)]
    hot = np.eye(len(LABELS))[gold] * inside[:, :, None]
    bounds = np.concatenate([np.zeros((n, 1), np.int64), np.where(inside, gold, 0), np.zeros((n, 1), np.int64)], axis=1)
    pairs = np.zeros_like(links)
    for step in range(width + 1):
        use = step <= size
        np.add.at(pairs, (bounds[use, step], np.where(step == size, 0, bounds[:, step + 1])[use]), 1.0)
    for _ in range(rounds):
        e = np.zeros((n, width, len(LABELS)))
        e[row, col] = sum(weights[d][active[d]].sum(axis=1) for d in range(2 * REACH + 1))
        forward = np.zeros((n, width, len(LABELS)))
        forward[:, 0] = links[0] + e[:, 0]
        for t in range(1, width):
            m = going[t]
            forward[:m, t] = _log_sum(forward[:m, t - 1, :, None] + links, 1) + e[:m, t]
        backward = np.broadcast_to(links[:, 0], (n, width, len(LABELS))).copy()
        for t in range(width - 2, -1, -1):
            m = going[t + 1]
            backward[:m, t] = _log_sum(links + (e[:m, t + 1] + backward[:m, t + 1])[:, None, :], 2)
        last = np.arange(n), np.maximum(size - 1, 0)
        total = _log_sum(forward[last] + links[:, 0], 1)
        chance = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * inside[:, :, None]
        expected = np.zeros_like(links)
        expected[0] += chance[:, 0].sum(axis=0)
        expected[:, 0] += chance[last].sum(axis=0)
        for t in range(width - 1):
            m = going[t + 1]
            both = forward[:m, t, :, None] + links + (e[:m, t + 1] + backward[:m, t + 1])[:, None, :] - total[:m, None, None]
            expected += np.exp(np.minimum(both, 0)).sum(axis=0)
        off = (hot - chance)[row, col]
        slope = np.zeros_like(weights)
        for d in range(2 * REACH + 1):
            for k in range(phi.shape[1]):
                for y in range(len(LABELS)):
                    slope[d, :, y] += np.bincount(active[d][:, k], off[:, y], minlength=slope.shape[1])
        for x, g, m in ((weights, slope - ridge * weights, memory[0]), (links, pairs - expected - ridge * links, memory[1])):
            m += g * g
            x += rate * g / np.sqrt(m)
    model.links = links.astype(np.float32)
    model.scores = np.stack([weights[d][phi].sum(axis=1) for d in range(2 * REACH + 1)]).astype(np.float32)
    return model
