"""Ranked search by Block-Max WAND over segments of an inverted index.

Each task searches its segments for all items of a block, one segment after the
other, and keeps the k best of each item and thereby its threshold. In a segment
the documents are gone through in order, a window at a time:

* Shallow moves: the blocks that a window meets are known from their last documents,
  and the greatest impacts of these bound every score in it. A window below the
  threshold is left without unpacking anything.
* The pivot: terms are taken by rising bound as long as they cannot reach the
  threshold together. A document must hold one of the others, so only their
  documents are unpacked, and a document goes on only if the block maxima of those
  it holds and the bounds of the rest reach the threshold.
* For what is left the blocks of the remaining terms are looked at one document
  each, shallow again, and only then unpacked; times are unpacked last.

Nothing is shuffled but the k best that each task has of each item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, lean, written
from .postings import BLOCK, SCHEMA, Segment, segments, terms_of

#: Documents of a window.
WINDOW = 4096
#: Items, and bytes of their texts, that are searched for in one pass over the index.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 8 << 20
_HIT = "item int, doc_id long, score long"
_HIT_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


class Asked:
    """A block of items: their distinct terms, and for each item the numbers of its
    terms and how often it has each."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        hashes: list[int] = []
        counts: list[Counter] = [Counter() for _ in texts]
        for raw, start, stop, h, doc in terms_of(texts):
            for s, e, x, d in zip(start.tolist(), stop.tolist(), h.tolist(), doc.tolist()):
                name = raw[s:e]
                if name not in number:
                    number[name] = len(hashes)
                    hashes.append(x)
                counts[d][number[name]] += 1
        self.names, self.hashes = list(number), np.array(hashes, dtype=np.uint64)
        self.items = [(np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counts]


def impacts(times: np.ndarray, slow: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times.astype(np.int64) // (1000 * times.astype(np.int64) + 8 * slow)


def slowness(lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a document's length costs its terms. Products beyond a long are made of
    Python's numbers."""
    if len(lengths) and 75 * int(lengths.max()) * docs >= 1 << 63:
        return 25 + np.array([75 * int(n) * docs // terms for n in lengths], dtype=np.int64)
    return 25 + 75 * lengths.astype(np.int64) * docs // max(terms, 1)


class Run:
    """The blocks of a term that a window meets, each unpacked when it is asked for:
    its documents, and apart from them its times."""

    def __init__(self, segment: Segment, term: int, b0: int, b1: int):
        self.segment, self.term, self.b0, self.b1 = segment, term, b0, b1
        self.last = segment.arrays["last_doc"][b0:b1]
        self.short = b1 - b0 <= 2  # too few blocks to tell apart
        self.near: tuple[np.ndarray, np.ndarray] | None = None
        self.impacts: np.ndarray | None = None
        self.whole: dict[str, np.ndarray] = {}
        self.single: dict[tuple[str, int], np.ndarray] = {}

    def _unpack(self, kind: str, b0: int, b1: int) -> np.ndarray:
        return self.segment.docs(self.term, b0, b1) if kind == "docs" else self.segment.times(b0, b1)

    def all(self, kind: str = "docs") -> np.ndarray:
        if kind not in self.whole:
            self.whole[kind] = self._unpack(kind, self.b0, self.b1)
        return self.whole[kind]

    def _fetch(self, kind: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What these blocks hold, one after the other, and where each begins. Of a
        good part of the blocks all are unpacked, at once."""
        if kind in self.whole or 4 * len(blocks) >= self.b1 - self.b0:
            return self.all(kind), (blocks - self.b0) * BLOCK
        for b in blocks.tolist():
            if (kind, b) not in self.single:
                self.single[kind, b] = self._unpack(kind, b, b + 1)
        some = [self.single[kind, b] for b in blocks.tolist()]
        return np.concatenate(some), np.cumsum([0, *map(len, some)])[:-1]

    def unpacked(self) -> int:
        """How many blocks' documents have been."""
        return self.b1 - self.b0 if "docs" in self.whole else sum(kind == "docs" for kind, _ in self.single)

    def shallow(self, docs: np.ndarray) -> np.ndarray:
        """The block in which each document would be, b1 if it is behind the last."""
        return self.b0 + np.searchsorted(self.last, docs)

    def find(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the documents have the term, and for those the block and the place in it."""
        block = self.shallow(docs)
        some = np.unique(block[block < self.b1])
        if not len(some):
            return np.zeros(len(docs), dtype=bool), some, some
        held, starts = self._fetch("docs", some)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        hit = held[at] == docs
        return hit, block[hit], at[hit] - starts[np.searchsorted(some, block[hit])]

    def times(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents have the term, and how often."""
        hit, block, place = self.find(docs)
        some = np.unique(block)
        if not len(some):
            return hit, some
        held, starts = self._fetch("times", some)
        return hit, held[starts[np.searchsorted(some, block)] + place]


class Searched:
    """A segment as the items of a block see it: shallow bounds of every window, and
    what has been unpacked of it so far."""

    def __init__(self, segment: Segment, asked: Asked, docs: int, terms: int):
        a, self.segment = segment.arrays, segment
        self.slow = slowness(a["lengths"], docs, terms)
        self.size, self.term = len(a["lengths"]), segment.find(asked.names, asked.hashes)
        self.windows = -(-self.size // WINDOW)
        best = impacts(a["best_times"], slowness(a["best_lengths"], docs, terms))
        self.most = np.maximum.reduceat(best, np.append(0, a["best_ends"][:-1])) if len(best) else best
        here = np.flatnonzero(self.term >= 0)
        self.row = np.full(len(self.term), -1)
        self.row[here] = np.arange(len(here))
        self.known = self.term[here]
        low, high = a["first_block"][self.known].astype(np.int64), a["first_block"][self.known + 1].astype(np.int64)
        # blocks of the asked terms with one key each, so one search finds where a window begins in all of them
        n = high - low
        blocks = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.repeat(np.arange(len(here)), n) * (self.size + 1) + a["last_doc"][blocks]
        edge = np.minimum(np.arange(self.windows + 1) * WINDOW, self.size)
        ask = np.arange(len(here))[:, None] * (self.size + 1) + edge[None, :]
        offset = (np.cumsum(n) - n)[:, None]
        self.begin = low[:, None] + np.searchsorted(key, ask[:, :-1]) - offset
        self.end = np.minimum(low[:, None] + np.searchsorted(key, ask[:, 1:] - 1) - offset + 1, high[:, None])
        self.bound = np.zeros((len(here), self.windows), dtype=np.int64)
        for w in range(self.windows):
            some = np.flatnonzero(self.begin[:, w] < self.end[:, w])
            if len(some):
                runs = np.stack([self.begin[some, w], self.end[some, w]], axis=1).ravel()
                self.bound[some, w] = np.maximum.reduceat(np.append(self.most, 0), runs)[::2]
        self.held: dict[tuple[int, int], Run] = {}

    def run(self, row: int, w: int) -> Run:
        got = self.held.get((row, w))
        if got is None:
            got = self.held[row, w] = Run(self.segment, int(self.known[row]), int(self.begin[row, w]), int(self.end[row, w]))
        return got

    def near(self, row: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """A term's documents in a window, counted from its first, and the greatest
        impact of the block of each."""
        run = self.run(row, w)
        if run.near is None:
            docs = run.all()
            run.inside = slice(*np.searchsorted(docs, [w * WINDOW, (w + 1) * WINDOW]))
            run.near = docs[run.inside] - w * WINDOW, self.most[run.b0 : run.b1].repeat(BLOCK)[run.inside]
        return run.near

    def exact(self, row: int, w: int) -> np.ndarray:
        """The impacts of near()."""
        run, (docs, _) = self.run(row, w), self.near(row, w)
        if run.impacts is None:
            run.impacts = impacts(run.all("times")[run.inside], self.slow[docs + w * WINDOW])
        return run.impacts

    def window(self, rows: np.ndarray, weights: np.ndarray, w: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a window with a score of at least `least`, and the scores."""
        bound = weights * self.bound[rows, w]
        order = np.argsort(bound, kind="stable")
        total = np.cumsum(bound[order])
        pivot = int(np.searchsorted(total, least))
        rest, at = int(total[pivot - 1]) if pivot else 0, w * WINDOW
        reach = np.zeros(WINDOW, dtype=np.int64)
        for i in order[pivot:]:
            docs, most = self.near(int(rows[i]), w)
            reach[docs] += weights[i] * most
        found = np.flatnonzero((reach > 0) & (reach + rest >= least))
        for i in order[:pivot][::-1]:  # the greatest of the rest first
            rest -= int(bound[i])
            if not len(found):
                break
            run = self.run(int(rows[i]), w)
            if run.b0 == run.b1:
                continue
            shallow = weights[i] * np.append(self.most[run.b0 : run.b1], 0)[run.shallow(found + at) - run.b0]
            keep = reach[found] + shallow + rest >= least
            found, shallow = found[keep], shallow[keep]
            if len(found) and run.short:
                docs, most = self.near(int(rows[i]), w)
                reach[docs] += weights[i] * most
            elif len(found):
                hit, _, _ = run.find(found + at)
                reach[found[hit]] += shallow[hit]
            found = found[reach[found] + rest >= least]
        if not len(found):
            return found, found
        score = np.zeros(WINDOW, dtype=np.int64)
        for i in order:
            run = self.run(int(rows[i]), w)
            if run.b0 < run.b1 and run.short:
                score[self.near(int(rows[i]), w)[0]] += weights[i] * self.exact(int(rows[i]), w)
            elif run.b0 < run.b1:
                hit, times = run.times(found + at)
                score[found[hit]] += weights[i] * impacts(times, self.slow[found[hit] + at])
        score = score[found]
        found = found + at
        return found[score >= least], score[score >= least]


class Best:
    """The k best documents of an item: greatest score first, then smallest id, a
    missing id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        return self.rows[-1][0] if len(self.rows) >= self.k else 1

    def add(self, ids: list[int | None], scores: list[int]) -> None:
        rows = [*self.rows, *zip(scores, ids)]
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def search_segment(segment: Segment, asked: Asked, weights: np.ndarray, best: list[Best], docs: int, terms: int) -> Searched:
    seen = Searched(segment, asked, docs, terms)
    for (numbers, times), top in zip(asked.items, best):
        weight = weights[numbers] * times
        use = (seen.row[numbers] >= 0) & (weight > 0)
        rows, weight = seen.row[numbers[use]], weight[use]
        bounds = weight @ seen.bound[rows] if len(rows) else np.zeros(0, np.int64)
        for w in np.flatnonzero(bounds >= top.least()):
            least = top.least()
            if bounds[w] >= least:
                found, score = seen.window(rows, weight, int(w), least)
                if len(found):
                    top.add([segment.doc_ids[d] for d in found.tolist()], score.tolist())
    return seen


def build_index(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of segments in the shared folder; one pass, no shuffle. A null text has
    no terms; rows with equal ids are documents of their own; other columns are not
    asked."""
    bounded_batches(spark)
    at = [docs.columns.index(id), docs.columns.index(text)]
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(F.col(f"c{at[0]}").cast("long"), F.col(f"c{at[1]}").cast("binary"))
    return written(spark, plain.mapInArrow(lean(segments), SCHEMA), "blockmax", large_rows=True)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 1) -> Iterator[None]:
    """Segments, of some megabytes each, go to Python one at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    block, size = [], 0
    for r in items.toLocalIterator():
        raw = bytes(r.raw or b"")
        if block and (len(block) >= BLOCK_ITEMS or size + len(raw) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r.item_id, raw))
        size += len(raw)
    if block:
        yield block


def search(spark: SparkSession, index: DataFrame, items: DataFrame, k: int = 10, id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank int from 1, doc_id, score: the k documents of the index with the
    highest scores above 0 for each item; of equal scores the smaller id first.

    Items that are null or have no terms that a document has get no rows. Items equal
    in id and text are one; those that share an id only have ranks of their own. The
    items go to the tasks in blocks of bounded size, one pass over the index for each.
    """
    at = [items.columns.index(id), items.columns.index(text)]
    kind = items.schema[at[0]].dataType.simpleString()
    plain = items.toDF(*(f"c{i}" for i in range(len(items.columns)))).select(F.col(f"c{at[0]}").alias("item_id"), F.col(f"c{at[1]}").cast("binary").alias("raw")).distinct()
    whole = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    results = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
    with few_rows(spark):
        for block in _item_blocks(plain) if whole.docs else ():
            results.append(written(spark, _searched(spark, index, block, k, kind, whole.docs, whole.terms), "blockmax-found", slim=True))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _searched(spark: SparkSession, index: DataFrame, block: list, k: int, kind: str, n_docs: int, n_terms: int) -> DataFrame:
    asked = spark.sparkContext.broadcast(Asked([raw for _, raw in block]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes = asked.value.names, asked.value.hashes
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.of(row | {"doc_ids": None})
                at = segment.find(names, hashes)
                total[at >= 0] += segment.arrays["frequency"][at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "n"])

    slim = index.select("hashes", "term_bytes", "term_ends", "frequency")
    counts = slim.mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a number for each term of the block
    weights = np.zeros(len(asked.value.names), dtype=np.int64)
    for r in counts:
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.n + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked.value.items]
        for batch in batches:
            for i in range(batch.num_rows):
                search_segment(Segment.of(batch.slice(i, 1).to_pylist()[0]), asked.value, weights, best, n_docs, n_terms)
        rows = [(i, d, s) for i, top in enumerate(best) for s, d in top.rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 3, _HIT_ARROW)], schema=_HIT_ARROW)

    hits = index.mapInArrow(lean(run), _HIT)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over build_index() of the documents, after which the index goes."""
    index = build_index(spark, docs)
    found = search(spark, index, items, k)
    dropped(spark, index)
    return found
