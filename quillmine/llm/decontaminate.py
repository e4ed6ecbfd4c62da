"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A CGK walk over a word sequence copies the word it stands on at each step and
moves on or stays by a random bit of (step, word); sequences a few edits apart
fall back into step, so their edit distance becomes a small Hamming distance
between the walks. Each repetition has its own random bits and samples a few of
the walk's places; their hash is the key. Every word of every document starts a
window, and an item has keys for windows that begin at several of its words. A
common key proposes the item-sized window it implies, and the exact edit
distance in words to the best-fitting part in and around it decides.

The number of repetitions follows from the target recall, for each length of
item: items with edits at the limit are put between other words, and repetitions
are added until the target share of them meets one of its keys; all items have
keys in as many as the most demanding length needs. Lengths that do
not get there within ``MAX_REPETITIONS``, and items of fewer than ``MIN_WORDS``
words, are probed exhaustively instead: cut into one segment more than edits are
allowed, at least one segment is unharmed, so looking all segments up misses none.

Items are taken in blocks of bounded number and length, and only those reach the
executors; documents are never shuffled.

Cases: words are runs of letters and digits, lower-cased, so white space and
punctuation do not count; each character of a script without spaces is a word;
null or empty documents and items match nothing; items of few words take part
like any other, so one of a single common word is found wherever it stands; equal
items are reported under each of their ids; repeated documents are reported
each; of places in a document that fit an item equally well the first counts;
documents of any length are searched whole; an empty benchmark or table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import appended, bounded_batches, lean, unused
from .tokens import text_groups
from .words import lowered, words_of, words_of_texts

#: Words that a walk needs; shorter items are probed exhaustively.
MIN_WORDS = 8
#: Walks a document is given at least and at most, and trials a length of item.
MIN_REPETITIONS, MAX_REPETITIONS, TRIALS = 3, 4, 400
#: Steps of a walk, sampled places of it, words between an item's windows.
STEPS, SAMPLED, STRIDE = 14, 6, 1
#: Characters of the items of a block.
BLOCK_CHARS = 20_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Walks:
    """The random bits and sampled places of all repetitions."""

    moves: np.ndarray  # (repetition, symbol): a bit for each step
    places: np.ndarray  # (repetition, step): whether it is sampled

    @staticmethod
    def make(repetitions: int, seed: int = 7) -> Walks:
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 1 << STEPS, size=(repetitions, 1 << 16), dtype=np.uint16)
        places = np.zeros((repetitions, STEPS), dtype=bool)
        for k in range(repetitions):
            places[k, rng.choice(STEPS, SAMPLED, replace=False)] = True
        return Walks(moves, places)

    def keys(self, symbols: np.ndarray, k: int) -> np.ndarray:
        """The key of the window that begins at each symbol, in repetition k."""
        n = len(symbols)
        padded = np.concatenate([symbols, np.zeros(STEPS, np.uint16)])
        moves = np.concatenate([self.moves[k][symbols], np.zeros(STEPS, np.uint16)])
        at = np.arange(n, dtype=np.int32)
        key = np.full(n, k, dtype=np.uint64)
        last = int(np.flatnonzero(self.places[k])[-1])
        for step in range(last + 1):
            if self.places[k, step]:
                key = (key ^ padded[at]) * _MIX
                key ^= key >> np.uint64(29)
            if step < last:
                at += (moves[at] >> np.uint16(step)) & np.uint16(1)
        return key


def best_fit_distance(pattern: list, text: list) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where
    that part ends (Myers' bit vectors)."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass(frozen=True)
class Block:
    """The keys of a block of items, sorted, with the item and the word that each begins at."""

    walks: Walks
    repetitions: int
    segments: list  # the lengths of segments that are looked up
    keys: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    ids: list
    words: list
    n_words: np.ndarray
    maybe: np.ndarray  # a bit map over the upper bits of the keys


_MAP_BITS = 22


def _symbol(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.uint16)


def _words(text: str) -> tuple[np.ndarray, list[bytes]]:
    raw = lowered(text)
    start, end, h = words_of(raw, split=True)
    return h, [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]


def _offsets(n: int) -> range:
    return range(0, max(1, n - MIN_WORDS + 1), STRIDE)


def edited(symbols: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item with so many words replaced, dropped or followed by a new one,
    between random words as in a document."""
    out = [[s] for s in symbols.tolist()]
    for at in rng.choice(len(out), edits, replace=False):
        kind, new = rng.integers(0, 3), int(rng.integers(0, 1 << 16))
        out[at] = [[new], [], [out[at][0], new]][kind]
    around = rng.integers(0, 1 << 16, size=(2, 2 * STEPS)).tolist()
    return np.array([*around[0], *(x for part in out for x in part), *around[1]], np.uint16)


def repetitions_for(symbols: list[np.ndarray], rate: float, target: float, walks: Walks) -> int | None:
    """Repetitions by which the target share of trials with items of one length is
    found; None if the walks are too few."""
    rng, found = np.random.default_rng(11), np.zeros(TRIALS, dtype=bool)
    items = [symbols[t % len(symbols)] for t in range(TRIALS)]
    texts = [edited(s, int(rate * len(s)), rng) for s in items]
    for k in range(len(walks.places)):
        for parts in range(0, TRIALS, 50):
            some = range(parts, min(parts + 50, TRIALS))
            # zeros keep the walks of one trial out of the next
            gap = np.zeros(STEPS, np.uint16)
            own = walks.keys(np.concatenate([x for t in some for x in (items[t], gap)]), k)
            keys = walks.keys(np.concatenate([x for t in some for x in (texts[t], gap)]), k)
            a = b = 0
            for t in some:
                n, m = len(items[t]), len(texts[t])
                found[t] |= bool(np.isin(own[a : a + n][list(_offsets(n))], keys[b : b + m]).any())
                a, b = a + n + STEPS, b + m + STEPS
        if found.mean() >= target:
            return k + 1
    return None


def _length_class(n: int) -> int:
    """Items of like length share their trials: each length below 32, then steps of an eighth."""
    return n if n < 32 else int(32 + 8 * np.log2(n / 32))


def segments_of(n: int, edits: int) -> list[tuple[int, int]]:
    """(first word, words) of edits + 1 segments, one of which no edits can harm."""
    at = [i * n // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def segment_keys(h: np.ndarray, size: int) -> np.ndarray:
    """The key of the segment of so many words that begins at each word."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, MAX_REPETITIONS + size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def make_block(ids: list, texts: list, max_rate: float, target_recall: float) -> Block:
    rows = [(i, *_words(t or "")) for i, t in zip(ids, texts)]
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: len(r[1]))
    walks = Walks.make(MAX_REPETITIONS)
    keys, item, offset = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    segments: set[int] = set()
    classes = [list(group) for _, group in groupby(rows, key=lambda r: _length_class(len(r[1])))]
    enough = [repetitions_for([_symbol(r[1]) for r in c], max_rate, target_recall, walks) if len(c[0][1]) >= MIN_WORDS else None for c in classes]
    repetitions = max([MIN_REPETITIONS, *filter(None, enough)]) if any(enough) else 0
    n = -1
    for group, walked in zip(classes, enough):
        for _, h, _ in group:
            n += 1
            for k in range(repetitions if walked else 0):
                at = list(_offsets(len(h)))
                keys.append(walks.keys(_symbol(h), k)[at])
                item.append(np.full(len(at), n))
                offset.append(np.array(at))
            for at, size in segments_of(len(h), int(max_rate * len(h))) if not walked else ():
                segments.add(size)
                keys.append(segment_keys(h[at : at + size], size))
                item.append(np.array([n]))
                offset.append(np.array([at]))
    keys, item, offset = (np.concatenate(x) for x in (keys, item, offset))
    order = np.argsort(keys, kind="stable")
    maybe = np.zeros(1 << _MAP_BITS, dtype=bool)
    maybe[keys >> np.uint64(64 - _MAP_BITS)] = True
    lengths = np.array([len(r[1]) for r in rows])
    return Block(walks, repetitions, sorted(segments), keys[order], item[order], offset[order], [r[0] for r in rows], [r[2] for r in rows], lengths, maybe)


def search_group(block: Block, texts: list[str], max_rate: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edit distance, first word, words) of the best place of each item in each text."""
    raw, start, end, h, limits = words_of_texts(texts, split=True)
    if not len(h):
        return []
    symbols = _symbol(h)
    proposed = []

    def looked_up():
        for k in range(block.repetitions):
            yield block.walks.keys(symbols, k)
        for size in block.segments:
            yield segment_keys(h, size)

    for keys in looked_up():
        at = np.flatnonzero(block.maybe[keys >> np.uint64(64 - _MAP_BITS)])
        low, high = np.searchsorted(block.keys, keys[at], "left"), np.searchsorted(block.keys, keys[at], "right")
        times = high - low
        at, low, times = at[times > 0], low[times > 0], times[times > 0]
        if len(at):
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            proposed.append(np.stack([np.repeat(np.searchsorted(limits, at, "right") - 1, times), block.item[which], np.repeat(at, times) - block.offset[which]], axis=1))
    if not proposed:
        return []
    rows = np.unique(np.concatenate(proposed), axis=0)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: dict[tuple[int, int], int] = {}
    for text, item, first in rows.tolist():
        n, at = len(block.words[item]), (text, item)
        most = int(max_rate * n)
        margin = max(2, most)
        # windows of one item that begin close to each other lie in one another's margin
        if first <= seen.get(at, -(1 << 60)) + margin // 2 or best.get(at, (1,))[0] == 0:
            continue
        seen[at] = first
        a, b = max(first - margin, limits[text]), min(first + n + 2 * margin, limits[text + 1])
        place = [raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())]
        if len(set(block.words[item]) - set(place)) > most:
            continue  # each of the item's words that is missing here costs an edit
        distance, stop = best_fit_distance(block.words[item], place)
        if distance <= most and distance < best.get(at, (n + 1,))[0]:
            _, length = best_fit_distance(block.words[item][::-1], place[:stop][::-1])
            best[at] = (distance, int(a - limits[text]) + stop - length, length)
    return [(*at, *found) for at, found in sorted(best.items())]


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    max_rate: float = 0.2,
    target_recall: float = 0.99,
    block_items: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, edit_distance, first_word, n_words: each item found in a
    document at an edit distance, in words, of at most max_rate of the item's words."""
    bounded_batches(spark)
    schema = "doc_id long, item_id long, edit_distance int, first_word long, n_words long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def searched(block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # block_items items at most

        def search(batches):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_groups(texts, 1_000_000):
                    found = search_group(shared.value, texts[a:b], max_rate)
                    if found:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array([ids[a + f[0]] for f in found], pa.int64()),
                                "item_id": pa.array([shared.value.ids[f[1]] for f in found], pa.int64()),
                                "edit_distance": pa.array([f[2] for f in found], pa.int32()),
                                "first_word": pa.array([f[3] for f in found], pa.int64()),
                                "n_words": pa.array([f[4] for f in found], pa.int64()),
                            }
                        )

        return rows.mapInArrow(lean(search), schema)

    out = None
    for block in _blocks(benchmark, max_rate, target_recall, block_items, item_col, item_text_col):
        out = searched(block) if out is None else out.unionByName(searched(block))
    return spark.createDataFrame([], schema) if out is None else out


def _blocks(benchmark: DataFrame, max_rate: float, target_recall: float, block_items: int, item_col: str, item_text_col: str):
    """Blocks of at most block_items items and BLOCK_CHARS characters, or one longer item."""
    held, chars = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col)).toLocalIterator():
        size = len(row[1] or "")
        if held and (len(held) == block_items or chars + size > BLOCK_CHARS):
            yield make_block([r[0] for r in held], [r[1] for r in held], max_rate, target_recall)
            held, chars = [], 0
        held.append(row)
        chars += size
    yield make_block([r[0] for r in held], [r[1] for r in held], max_rate, target_recall)


def without_contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    max_rate: float = 0.2,
    target_recall: float = 0.99,
    block_items: int = 20_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs without those that hold an item."""

    def clean(docs: DataFrame, block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # block_items items at most

        def hit(texts):
            texts = texts.to_pylist()
            out = np.zeros(len(texts), dtype=bool)
            for a, b in text_groups(texts, 1_000_000):
                out[[a + f[0] for f in search_group(shared.value, texts[a:b], max_rate)]] = True
            return [out]

        (leaks,) = unused(docs.columns, "leaks")
        return appended(docs, [text_col], [(leaks, "boolean", pa.bool_())], hit).where(~F.col(leaks)).drop(leaks)

    for block in _blocks(benchmark, max_rate, target_recall, block_items, item_col, item_text_col):
        docs = clean(docs, block)
    return docs
