"""Nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of several codebooks, all of
the vectors' full dimension. Codebooks begin as k-means on the residuals of
those before and are then refitted together by least squares. Vectors are
encoded by beam search over the codebooks, and the squared norm of each code's
sum is stored. A query scores all codes by lookup tables of its inner products
with the codewords; the ``shortlist`` best of all are reranked by the exact
distance.

Codebooks are trained on at most ``sample`` rows, those with the smallest id
hash; every row is encoded and searched. Equal vectors are one entry with their
k + 1 smallest ids, so thousands of copies do not crowd out others. Codes are not
shuffled: the queries come to them in blocks of ``block_queries``, and a task
keeps the best of the codes it reads. Vectors are fetched for the shortlists
alone.

Cases: vectors that are null, all zeros, or hold null or non-finite components
take no part, nor do those of another length than most of the sample, nor null
ids; ties go to the smaller id; rows equal in id and vector count once; of other
rows that share an id each is a query, with ranks from 1, and a candidate, but
never for its own id; components beyond a million times the sample's size are cut for
the codes alone, so they cost recall and not exactness; with no usable vector
there are no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, lean, new_path, written

#: Blocks of queries that are broadcast at once, and codes that a task scores at once.
BLOCKS, AT_ONCE = 16, 16384


@dataclass
class Quantizer:
    books: np.ndarray  # (codebooks, words, dimension)
    beam: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, codebooks) and squared norms of their sums."""
        m, k, _ = self.books.shape
        own = np.einsum("mkd,mkd->mk", self.books, self.books)
        codes = np.empty((len(x), m), dtype=np.int32)
        norms = np.empty(len(x), dtype=np.float32)
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            n, row = len(part), np.arange(len(part))
            # what each beam leaves over: |r - c|^2 = |r|^2 + |c|^2 - 2 r.c
            rest = part[:, None, :]
            cost = np.zeros((n, 1), dtype=np.float32)
            chosen = np.zeros((n, 1, 0), dtype=np.int32)
            for book, size in zip(self.books, own):
                step = (cost[:, :, None] + (size - 2 * (rest @ book.T))).reshape(n, -1)
                best = np.empty((n, min(self.beam, step.shape[1])), dtype=np.int64)
                cost = np.empty(best.shape, dtype=np.float32)
                for b in range(best.shape[1]):
                    best[:, b] = at = step.argmin(axis=1)
                    cost[:, b] = step[row, at]
                    step[row, at] = np.inf
                beam, word = best // k, best % k
                rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - book[word]
                chosen = np.concatenate([np.take_along_axis(chosen, beam[:, :, None], axis=1), word[:, :, None].astype(np.int32)], axis=2)
            codes[a : a + n] = chosen[:, 0]  # the cheapest beam is the first
            sums = part - rest[:, 0]
            norms[a : a + n] = np.einsum("ij,ij->i", sums, sums)
        return codes, norms


def train(x: np.ndarray, codebooks: int = 32, words: int = 256, beam: int = 4, rounds: int = 2, seed: int = 5) -> Quantizer:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    n, d = x.shape
    k = min(words, n)
    one_hot = np.eye(k, dtype=np.float32)

    def nearest_word(rest: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(axis=1) - 2 * rest @ centres.T, axis=1)

    books = np.zeros((codebooks, k, d), dtype=np.float32)
    rest = x.copy()
    for j in range(codebooks):
        centres = rest[rng.choice(n, k, replace=False)].copy()
        for _ in range(6):
            near = nearest_word(rest, centres)
            size = np.bincount(near, minlength=k)[:, None]
            centres = np.where(size > 0, one_hot[near].T @ rest / np.maximum(size, 1), centres).astype(np.float32)
        books[j] = centres
        rest -= centres[nearest_word(rest, centres)]
    for _ in range(rounds):
        codes, _ = Quantizer(books, beam).encode(x)
        rest = x - sum(books[j][codes[:, j]] for j in range(codebooks))
        # least squares for all codebooks together, a book at a time, until what is left over hardly
        # changes; words are pulled towards the present ones, so that unused ones stay put
        pull = 0.1
        start = books.copy()
        for _ in range(8):
            for j in range(codebooks):
                now = one_hot[codes[:, j]]
                size = now.sum(axis=0)[:, None]
                move = (now.T @ rest + pull * (start[j] - books[j])) / (size + pull)
                books[j] += move
                rest -= move[codes[:, j]]
    return Quantizer(books, beam)


def best_codes(q: Quantizer, codes: np.ndarray, norms: np.ndarray, queries: np.ndarray, held: tuple[np.ndarray, np.ndarray], first: int, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """The (score, number) of each query's shortlist, held until now, with the codes
    numbered from `first` on. Scores are squared distances less the query's own norm."""
    scores, numbers = held
    for a in range(0, len(queries), 256):
        some = slice(a, min(a + 256, len(queries)))
        table = 2 * np.einsum("qd,mkd->qmk", queries[some], q.books, optimize=True)
        for b in range(0, len(codes), 4096):
            part = codes[b : b + 4096]
            score = np.repeat(norms[b : b + 4096][None, :], table.shape[0], axis=0)
            for j in range(len(q.books)):
                score -= np.take(table[:, j], part[:, j], axis=1)
            both = np.concatenate([scores[some], score], axis=1)
            number = np.concatenate([numbers[some], np.broadcast_to(first + b + np.arange(len(part)), score.shape)], axis=1)
            keep = np.argpartition(both, shortlist - 1, axis=1)[:, :shortlist]
            scores[some], numbers[some] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(number, keep, axis=1)
    return scores, numbers


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    fine = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, d)


def nearest(
    spark: SparkSession,
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 8192,
    shortlist: int = 256,
    block_queries: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` picks, its k nearest."""
    schema = "query_id long, rank int, vec_id long, score double"
    bounded_batches(spark)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # the documented bound
    drawn = drawn.column("v").to_pylist()
    if not drawn:
        return spark.createDataFrame([], schema)
    d = int(np.bincount([len(v) for v in drawn]).argmax())
    drawn = np.array([v for v in drawn if len(v) == d])
    unit = float(np.median(np.abs(drawn).max(axis=1)))
    quantizer = spark.sparkContext.broadcast(train(_scaled(drawn, unit)))  # of fixed size
    shortlist = max(shortlist, k + 1)

    def encode(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype="<f8").reshape(-1, d)
            x[x == 0] = 0  # one zero
            codes, norms = quantizer.value.encode(_scaled(x, unit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes.astype("<i2")], pa.binary()), pa.array(norms)],
                names=["id", "asks", "v", "codes", "norm"],
            )

    coded = rows.where(F.size("v") == d).mapInArrow(lean(encode), "id long, asks boolean, v binary, codes binary, norm float")
    coded = written(spark, coded.withColumn("vkey", F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))), "ann-codes")

    # the k + 1 smallest ids of each vector; few of a hot one's rows are shuffled, as the limit is put before it
    place = F.row_number().over(Window.partitionBy("vkey").orderBy("id"))
    members = coded.groupBy("vkey", "id").agg(F.first("codes").alias("codes"), F.first("norm").alias("norm"))
    members = written(spark, members.withColumn("place", place).where(F.col("place") <= k + 1), "ann-members")
    entries = members.where("place = 1").select("vkey", "id", "codes", "norm")
    asked = written(spark, coded.where("asks").select("id", "vkey", "v").dropDuplicates(["id", "vkey"]), "ann-queries")

    found, parts, shared = new_path(spark, "ann-found"), [], []

    def search() -> None:
        """The parts' shortlists join the others; a few blocks of queries at a time are broadcast."""
        reduce(DataFrame.unionByName, parts).write.mode("append").parquet(found)
        for x in shared:
            x.destroy()
        parts.clear()
        shared.clear()

    for block in _blocks(asked, d, unit, block_queries):
        shared.append(spark.sparkContext.broadcast(block))  # block_queries vectors at most
        parts.append(_shortlists(entries, shared[-1], quantizer, shortlist))
        if len(parts) == BLOCKS:
            search()
    if parts:
        search()
    elif asked.isEmpty():
        return spark.createDataFrame([], schema)
    found = spark.read.parquet(found)

    query = ["query_id", "query_vkey"]
    best = F.row_number().over(Window.partitionBy(*query).orderBy("approximate", "vkey"))
    short = written(spark, found.withColumn("place", best).where(F.col("place") <= shortlist).select(*query, "vkey", "least"), "ann-shortlist")
    originals = coded.groupBy("vkey").agg(F.first("v").alias("v"))
    pairs = short.join(originals, "vkey").join(asked.select(F.col("id").alias("query_id"), F.col("vkey").alias("query_vkey"), F.col("v").alias("q")), query)

    def exact(batches):
        for batch in batches:
            # differences before squares: exact for the vectors as given
            score = np.sqrt(((_matrix(batch.column(4), d) - _matrix(batch.column(5), d)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], names=["query_id", "query_vkey", "vkey", "least", "score"])

    key = "struct<x: bigint, y: bigint>"
    scored = pairs.select(*query, "vkey", "least", "v", "q").mapInArrow(lean(exact), f"query_id long, query_vkey {key}, vkey {key}, least long, score double")
    # each of k + 1 entries gives a candidate, but for one whose only id is the query's
    nearest_entries = F.row_number().over(Window.partitionBy(*query).orderBy("score", "least"))
    scored = scored.withColumn("place", nearest_entries).where(F.col("place") <= k + 1).drop("place")
    final = scored.join(members.select("vkey", F.col("id").alias("vec_id")), "vkey").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy(*query).orderBy("score", "vec_id"))
    return final.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scaled(x: np.ndarray, unit: float) -> np.ndarray:
    """In units of the sample's size, so that squares stay within 32-bit floats."""
    with np.errstate(over="ignore"):
        return np.clip(x / unit, -1e6, 1e6).astype(np.float32)


def _blocks(asked: DataFrame, d: int, unit: float, block_queries: int):
    held = []
    for row in asked.select("id", "vkey.x", "vkey.y", "v").toLocalIterator():
        held.append(row)
        if len(held) == block_queries:
            yield _block(held, d, unit)
            held = []
    if held:
        yield _block(held, d, unit)


def _block(rows: list, d: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(id and vector key, scaled vectors) of a block of queries."""
    return np.array([r[:3] for r in rows], dtype=np.int64), _scaled(np.frombuffer(b"".join(bytes(r[3]) for r in rows), dtype="<f8").reshape(-1, d), unit)


def _shortlists(entries: DataFrame, shared, quantizer, shortlist: int) -> DataFrame:
    """query_id, query_vkey, vkey, least, approximate: the shortlists of a block of
    queries in each part of the entries."""

    def search(batches):
        names, queries = shared.value
        held = np.full((len(queries), shortlist), np.inf, np.float32), np.full((len(queries), shortlist), -1, np.int64)
        kept = [np.empty(0, np.int64)] * 3  # x, y and least id of the entries that are on a shortlist
        for some in _gathered(batches, AT_ONCE):
            codes = np.frombuffer(b"".join(some.column(3).to_pylist()), "<i2").reshape(some.num_rows, -1).astype(np.int64)
            new = [np.concatenate([x, some.column(i).to_numpy()]) for i, x in enumerate(kept)]
            held = best_codes(quantizer.value, codes, some.column(4).to_numpy(), queries, held, len(kept[0]), shortlist)
            used, where = np.unique(held[1], return_inverse=True)
            # numbers anew, without the entries that are on no list; -1 stays
            none = int(used[0] == -1)
            kept = [x[used[none:]] for x in new]
            held = held[0], where.reshape(held[1].shape) - none
        row, place = np.nonzero(held[1] >= 0)
        number, score = held[1][row, place], held[0][row, place]
        for a in range(0, len(row), 10_000):
            r, n = row[a : a + 10_000], number[a : a + 10_000]
            columns = [*(names[r, i] for i in range(3)), *(x[n] for x in kept), score[a : a + 10_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "qx", "qy", "x", "y", "least", "approximate"])

    slim = entries.select("vkey.x", "vkey.y", "id", "codes", "norm")
    found = slim.mapInArrow(lean(search), "query_id long, qx long, qy long, x long, y long, least long, approximate float")
    return found.select("query_id", F.struct(F.col("qx").alias("x"), F.col("qy").alias("y")).alias("query_vkey"), F.struct("x", "y").alias("vkey"), "least", "approximate")


def _gathered(batches, rows: int):
    """The batches as tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)
