"""Ball k-means over whole numbers, the same to the last digit wherever it runs.

A cluster is a ball: its centroid and the distance of its farthest member. Only
balls whose centroids are nearer than twice that distance are its neighbours.
Members nearer to their centroid than half the way to the nearest neighbour are
the stable core and stay without a comparison; the others lie in annuli, by how
many neighbours are within twice their own distance, and are compared with those
alone. All distances are whole numbers, so the result is that of comparing every
vector with every centroid.

A round is one pass over the vectors, which writes each with its new cluster and,
for every task, the counts, sums and farthest distance of the clusters; nothing is
shuffled but these, and nothing but them and the centroids comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, lean, written

#: The greatest long, which stands for every distance beyond it.
BEYOND = (1 << 63) - 1
#: Components from here on have no place in the arithmetic of longs.
LARGEST = 1 << 61
_STATE = "id long, place binary, cluster int, distance long, part int, n long, sums array<decimal(38,0)>, far long, total decimal(38,0)"
_ARROW = pa.schema(
    [("id", pa.int64()), ("place", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("part", pa.int32()), ("n", pa.int64()),
     ("sums", pa.list_(pa.decimal128(38, 0))), ("far", pa.int64()), ("total", pa.decimal128(38, 0))]
)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a point; BEYOND where no long holds it."""
    apart = x - centre
    rough = np.square(apart.astype(np.float64)).sum(axis=-1)
    return np.where(rough < 9.2e18, (apart * apart).sum(axis=-1), BEYOND)


@dataclass
class Balls:
    """Centroids with, for each, its neighbours from the nearest on and a quarter of
    their squared distance, rounded up: a member has as many neighbours to be
    compared with as have no more than its own squared distance."""

    centres: np.ndarray
    neighbours: list[np.ndarray] = field(default_factory=list)
    quarters: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, centres: np.ndarray, radii: list[int] | None) -> Balls:
        """radii: at least the distance of each ball's farthest member, rounded up;
        None if nobody knows them."""
        out = cls(centres)
        exact = [[int(v) for v in c] for c in centres]
        for i, own in enumerate(exact):
            apart = [(sum((a - b) ** 2 for a, b in zip(own, other)), j) for j, other in enumerate(exact) if j != i]
            near = sorted((d, j) for d, j in apart if radii is None or d <= 4 * radii[i] ** 2)
            out.neighbours.append(np.array([j for _, j in near], dtype=np.int64))
            out.quarters.append(np.array([min(BEYOND, -(-d // 4)) for d, _ in near], dtype=np.int64))
        return out

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, of equals the first, and its squared
        distance; cluster: where each is now."""
        new, distance = cluster.copy(), np.zeros(len(x), dtype=np.int64)
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            own = squared(x[rows], self.centres[i])
            annulus = np.searchsorted(self.quarters[i], own, side="right")  # 0 is the stable core
            best, at = own.copy(), np.full(len(rows), i)
            for k, j in enumerate(self.neighbours[i][: annulus.max(initial=0)]):
                some = np.flatnonzero(annulus > k)
                other = squared(x[rows[some]], self.centres[j])
                better = (other < best[some]) | (other == best[some]) & (j < at[some])
                best[some[better]], at[some[better]] = other[better], j
            new[rows], distance[rows] = at, best
        if (distance == BEYOND).any():
            raise OverflowError("a squared distance is beyond a long")
        return new, distance


def packed(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, four or eight for each number."""
    small = len(x) == 0 or int(np.abs(x).max(initial=0)) < 1 << 31
    raw = np.ascontiguousarray(x.astype("<i4" if small else "<i8")).view(np.uint8).reshape(len(x), x.shape[1] * (4 if small else 8))
    ends = np.arange(len(x) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(raw.ravel())])


def unpacked(places: pa.Array, size: int) -> np.ndarray:
    """What packed() was given; one batch may hold rows of both widths."""
    if not len(places):
        return np.empty((0, size), dtype=np.int64)
    at = np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1]
    raw, width = np.frombuffer(places.buffers()[2], np.uint8), np.diff(at)
    out = np.empty((len(places), size), dtype=np.int64)
    for bytes_each, kind in ((4, "<i4"), (8, "<i8")):
        rows = np.flatnonzero(width == bytes_each * size)
        out[rows] = raw[at[rows][:, None] + np.arange(bytes_each * size)].view(kind)
    return out


def whole_vectors(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of just so many finite components, and floor(scale *
    component) of those."""
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(n == size)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    good = np.isfinite(x).all(axis=1)  # a null is not a number either
    x = np.floor(x[good] * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise OverflowError("a component is beyond what whole-number distances can hold")
    return rows[good], x.astype(np.int64)


def _rows(id: pa.Array, place: pa.Array, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(id), f.type) for f in list(_ARROW)[4:]]
    return pa.RecordBatch.from_arrays([id, place, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), *none], schema=_ARROW)


def _sums(x: np.ndarray) -> list[int]:
    small = len(x) == 0 or int(np.abs(x).max(initial=0)) * len(x) < BEYOND
    return [int(v) for v in x.sum(axis=0)] if small else [sum(int(v) for v in column) for column in x.T]


@dataclass
class Totals:
    """Of each cluster: members, sums of the components, the farthest squared
    distance and the sum of the squared distances."""

    n: dict[int, int] = field(default_factory=dict)
    sums: dict[int, list[int]] = field(default_factory=dict)
    far: dict[int, int] = field(default_factory=dict)
    total: dict[int, int] = field(default_factory=dict)

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        for c in map(int, np.unique(cluster)):
            mine = cluster == c
            some = _sums(x[mine])
            self.n[c] = self.n.get(c, 0) + int(mine.sum())
            self.sums[c] = [a + b for a, b in zip(self.sums[c], some)] if c in self.sums else some
            self.far[c] = max(self.far.get(c, 0), int(distance[mine].max()))
            self.total[c] = self.total.get(c, 0) + _sums(distance[mine][:, None])[0]

    def rows(self) -> pa.RecordBatch:
        keys = sorted(self.n)
        got = [[by[c] for c in keys] for by in (self.n, self.sums, self.far, self.total)]
        none = [pa.nulls(len(keys), f.type) for f in list(_ARROW)[:4]]
        return pa.RecordBatch.from_arrays([*none, pa.array(keys, pa.int32()), *(pa.array(v, f.type) for v, f in zip(got, list(_ARROW)[5:]))], schema=_ARROW)


def _pass(state: DataFrame, balls: Balls, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        for batch in batches:
            id, place, cluster = batch.columns
            x = unpacked(place, size)
            new, distance = balls.assign(x, cluster.to_numpy())
            totals.add(x, new, distance)
            yield _rows(id, place, new, distance)
        yield totals.rows()

    return state.where("place is not null").select("id", "place", "cluster").mapInArrow(lean(run), _STATE)


def _totals(state: DataFrame) -> Totals:
    """What all tasks have summed up: k times as many numbers as a vector has."""
    numbers = F.concat(F.array(F.col("n").cast("decimal(38,0)"), F.col("total")), F.col("sums"))
    parts = state.where("part is not null").select("part", "far", F.posexplode(numbers))
    out: Totals = Totals()
    for r in parts.groupBy("part", "pos").agg(F.sum("col").alias("s"), F.max("far").alias("far")).orderBy("part", "pos").collect():
        if r.pos == 0:
            out.n[r.part], out.far[r.part], out.sums[r.part] = int(r.s), r.far, []
        elif r.pos == 1:
            out.total[r.part] = int(r.s)
        else:
            out.sums[r.part].append(int(r.s))
    return out


def ball_kmeans(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, cluster int, distance long (squared), cluster_inertia and inertia long,
    centroid_sha256, for each row whose vector has `size` components, none of them
    null, infinite or NaN; other rows are left out, and other columns are not asked.

    Vectors are floor(scale * component). The first centroids are the k vectors with
    the smallest hexadecimal sha256 of "seed:id"; of equal ids, the smallest vector;
    missing ids come last. With fewer than k vectors each is one. Of centroids that
    are equally near the first wins, so those equal to one before them stay empty and
    keep their place. Repeated rows count each; no rows give no rows. A distance or a
    sum that no long holds is an OverflowError.
    """
    at = [vectors.columns.index(id), vectors.columns.index(vector)]
    plain = vectors.toDF(*(f"c{i}" for i in range(len(vectors.columns)))).select(F.col(f"c{at[0]}").cast("long"), F.col(f"c{at[1]}").cast("array<double>"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole_vectors(batch.column(1), size, scale)
            zero = np.zeros(len(rows), dtype=np.int64)
            yield _rows(batch.column(0).take(pa.array(rows)), packed(x), zero, zero)

    state = written(spark, plain.mapInArrow(lean(whole), _STATE), "balls")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.select("place", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "place").limit(k).collect()
    centres, radii = unpacked(pa.array([bytes(r.place) for r in first], pa.binary()), size), None

    for left in range(rounds, -1, -1):
        new = written(spark, _pass(state, Balls.of(centres, radii), size), "balls")
        dropped(spark, state)
        state, totals = new, _totals(new)
        if not left:
            break
        moved = centres.copy()
        for c, n in totals.n.items():
            moved[c] = [s // n for s in totals.sums[c]]
        far = [isqrt(totals.far.get(c, 0)) + 1 for c in range(len(centres))]
        shift = [isqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(old, new))) + 1 for old, new in zip(centres, moved)]
        if (moved == centres).all():  # then every further round gives the same
            break
        centres, radii = moved, [a + b for a, b in zip(far, shift)]

    inertia = sum(totals.total.values())
    if inertia > BEYOND:
        raise OverflowError("the inertia is beyond a long")
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    clusters = spark.createDataFrame([(c, totals.total.get(c, 0), inertia, names[c]) for c in range(len(centres))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    members = state.where("place is not null").select(F.col("id").alias(id), "cluster", "distance")
    return members.join(F.broadcast(clusters), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
