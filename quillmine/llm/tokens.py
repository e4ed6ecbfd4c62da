"""Exact token ids, a group of texts at a time.

A tokenizer that lower-cases, drops white space and never joins letters with
other characters gives a word the same ids wherever it stands. So texts are cut
into pre-tokens by the classes of their bytes, and each worker keeps a bounded
memory of pre-tokens and their ids; only those new to it go to the library.
Texts with any character outside a range where normalisation is known to work
character by character, or that could hold a special token, go to the library
whole. Long texts are worked on in parts that begin at white space, over which
no token goes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .wordtable import PAD, Words

#: Classes of bytes: white space, letters, other visible characters, numbers, a
#: number's further bytes, what is not handled here, and the end of a text.
SPACE, LETTER, OTHER, DIGIT, REST, ODD, END = range(7)
#: The settings for which the pre-tokens are cut here.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The endings that an apostrophe takes along.
_ONE, _TWO = b"stmd", ("re", "ve", "ll")
#: Characters of a long text that are worked on at once.
PART = 4_000_000
_cut = re.compile(r"(?<=\S)[ \t\n]")


def _kind(c: str) -> int:
    category = unicodedata.category(c)
    return {"L": LETTER, "N": DIGIT, "Z": ODD, "C": ODD, "M": ODD}.get(category[0], OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and of characters U+0080 to U+00BF by their second byte."""
    one = np.full(256, ODD, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        one[b] = _kind(chr(b))
    one[[9, 10, 11, 12, 13, 32]] = SPACE
    one[0] = END
    one[0x80:0xC0] = LETTER  # of the two bytes of U+00C0 to U+02BF
    one[0xC3:0xCB] = LETTER
    one[0xC2] = one[0xE2] = OTHER
    two = np.full(256, ODD, dtype=np.uint8)
    for b in range(0x80, 0xC0):
        two[b] = _kind(chr(b))
    return one, two


_CLASS, _CLASS_C2 = _tables()
_LAST = np.zeros(256, dtype=np.int64)
_LAST[list(_ONE)] = 1


def classes(code: np.ndarray, each_digit: bool) -> np.ndarray:
    """The class of each byte of UTF-8, which PAD zero bytes follow."""
    out = _CLASS[code]
    at = np.flatnonzero(code == 0xC2)
    if len(at):
        kind = _CLASS_C2[code[at + 1]]
        out[at], out[at + 1] = kind, np.where((kind == DIGIT) & each_digit, REST, kind)
    at = np.flatnonzero(code == 0xC3)
    if len(at):  # the signs of multiplication and division
        at = at[(code[at + 1] == 0x97) | (code[at + 1] == 0xB7)]
        out[at] = out[at + 1] = OTHER
    at = np.flatnonzero(code == 0xE2)
    if len(at):  # dashes, quotation marks, bullets, per mille to angle quotation marks, the euro
        b, c = code[at + 1], code[at + 2]
        known = (b == 0x80) & ((c >= 0x90) & (c <= 0xA7) | (c >= 0xB0) & (c <= 0xBA)) | (b == 0x82) & (c == 0xAC)
        out[at] = np.where(known, OTHER, ODD)
        out[at + 1] = out[at + 2] = OTHER
    return out


def endings(code: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> None:
    """An apostrophe that begins a pre-token takes a known ending along: the edges
    are moved."""
    at = np.flatnonzero(code == 0x27)
    at = at[edge[at]]
    if not len(at):
        return
    size = _LAST[code[at + 1]]
    for pair in _TWO:
        size[(code[at + 1] == ord(pair[0])) & (code[at + 2] == ord(pair[1]))] = 2
    at, size = at[size > 0], size[size > 0]
    edge[at + 1] = False
    after = at + 1 + size
    edge[after[kind[after] == LETTER]] = True


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(PAD), dtype=np.uint8)


class TokenIds:
    """ids of whole texts as little-endian unsigned integers: 16 bits if the
    vocabulary allows it, else 32."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_piece = kinds == _NORMALIZERS and split.get("behavior") == "Removed" and split.get("invert") is True
        self.by_piece &= (split.get("pattern") or {}).get("Regex") == _PATTERN
        self.specials = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        end = spec["model"].get("end_of_word_suffix") or ""
        self.by_piece &= bool(end)
        if self.by_piece:
            # pre-tokens are normalised and apart already; each one's last id, and no other, ends a word
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True
            self.known = Words(self._learn, self.dtype)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for k in range(0, len(words), 256):
            some = words[k : k + 256]
            got = np.array(self.words.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) != len(some):
                raise AssertionError("pre-tokens were not kept apart")
            ids.append(got)
            counts.append(np.diff(last, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = b"\0".join(raws)
        raw = padded(data)
        code = raw[: len(data)]
        limits = np.cumsum([0, *(len(r) + 1 for r in raws)])
        kind = classes(raw, each_digit=True)
        kind[limits[1:-1] - 1] = SPACE
        kind[len(data) :] = SPACE
        edge = np.empty(len(raw), dtype=bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == DIGIT
        edge &= kind != REST
        endings(raw, kind, edge)
        whole = set(np.unique(np.searchsorted(limits, np.flatnonzero((kind == ODD) | (kind == END)), "right") - 1).tolist())
        for s in self.specials:
            at = data.find(s)
            while at >= 0:
                whole.add(int(np.searchsorted(limits, at, "right")) - 1)
                at = data.find(s, at + 1)
        at = np.flatnonzero(edge)
        inside = kind[at[:-1]] != SPACE
        start, end = at[:-1][inside], at[1:][inside]
        where = np.searchsorted(start, limits)
        if whole:
            stays = np.ones(len(start), dtype=bool)
            for t in whole:
                stays[where[t] : where[t + 1]] = False
            start, end = start[stays], end[stays]
            where = np.searchsorted(start, limits)
        entry = self.known.lookup(data, raw, start, end)
        ids = self.known.values(entry)
        last = np.concatenate([[0], np.cumsum(self.known.count[entry])])[where].tolist()
        return [self._library(texts[i]) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(last, last[1:]))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if not self.by_piece:
            return [self._library(t or "") for t in texts]
        parts = [list(text_parts(t or "")) for t in texts]
        flat = [p for some in parts for p in some]
        ids = iter([x for a, b in text_groups(flat) for x in self._group(flat[a:b])])
        return [np.concatenate([next(ids) for _ in some]) if len(some) > 1 else next(ids) for some in parts]


def text_parts(text: str, size: int = PART):
    """A text in parts of about so many characters; all but the first begin at the
    first white space after something else, where every pre-token ends."""
    at = 0
    while len(text) - at > size and (cut := _cut.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def with_end(ids: list[np.ndarray], end_id: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids, with the end id after each text's, and where each text begins; the
    last limit is the end."""
    limits = np.cumsum([0, *(len(x) + 1 for x in ids)])
    out = np.full(limits[-1], end_id, dtype=dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[limits[1:] - 1] = False
    if ids:
        out[inside] = np.concatenate(ids)
    return out, limits


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def text_groups(texts: list[str | None], chars: int = 1_000_000):
    """(start, end) of runs of texts of about so many characters."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
