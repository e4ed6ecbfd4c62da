"""Ball k-means against plain k-means in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest


def plain(rows, k, rounds, size, scale=1024):
    """(cluster, distance) of each row, in order, and the centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = ([v for _, v in named] + sorted(v for i, v in kept if i is None))[:k]
    for left in range(rounds, -1, -1):
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        at = [d.index(min(d)) for d in apart]
        if left:
            groups = [[v for (_, v), a in zip(kept, at) if a == j] for j in range(len(centres))]
            centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    return [(i, a, d[a]) for (i, _), a, d in zip(kept, at, apart)], centres


def clustered(spark, rows, kind="double", parts=3, **options):
    from quillmine.llm.ballmeans import ball_kmeans

    frame = spark.createDataFrame([(i, v, i, 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, distance long, cluster int").repartition(parts)
    return ball_kmeans(spark, frame, **options).collect()


@pytest.mark.parametrize("spread, k, size", [(0.05, 6, 8), (1.0, 9, 4), (3.0, 5, 2)])
def test_the_same_as_plain_k_means(spark, spread, k, size):
    rng = np.random.default_rng(int(spread * 100) + k)
    centres = rng.normal(size=(k, size))
    rows = [(i, (centres[rng.integers(k)] + spread * rng.normal(size=size)).tolist()) for i in range(900)]
    want, final = plain(rows, k, 6, size)
    got = clustered(spark, rows, k=k, rounds=6, size=size)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    by = {c: sum(d for _, a, d in want if a == c) for c in range(k)}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (by[r.cluster], sum(by.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


def test_ties_repeats_odd_vectors_and_empty_clusters(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3) / 1024, rng.randrange(3) / 1024]) for i in range(60)]  # a grid of nine places
    rows += rows[:25] + [(1000 + i, [0.0, 0.0]) for i in range(300)] + [(None, [2.0, -7.0])] * 2
    rows += [(2000, None), (2001, []), (2002, [1.0]), (2003, [1.0, None]), (2004, [float("nan"), 1.0]), (2005, [float("-inf"), 1.0]), (2006, [1.0, 2.0, 3.0])]
    want, _ = plain(rows, 8, 10, 2)
    got = clustered(spark, rows, k=8, rounds=10, size=2)
    key = lambda x: (x[0] is None, *map(int, (x[0] or 0, *x[1:])))
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert {r.vec_id for r in got}.isdisjoint(range(2000, 2007))


def test_few_none_and_far_vectors(spark):
    assert clustered(spark, [], size=2) == clustered(spark, [(1, [1.0])], size=2) == []
    two = clustered(spark, [(1, [0.5, -0.25]), (2, [8.0, 8.0])], size=2)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in two) == [(1, 0, 0), (2, 0, 0)] and len({r.cluster for r in two}) == 2
    rows = [(i, [x * 1e9, -x * 1e9]) for i, x in enumerate([1.0, 1.0001, -1.0, -1.00005, 0.25])]
    want, _ = plain(rows, 2, 3, 2)
    with pytest.raises(Exception, match="beyond"):
        clustered(spark, rows, k=2, rounds=3, size=2)
    rows = [(i, [v / 1e6 for v in vector]) for i, vector in rows]
    want, _ = plain(rows, 2, 3, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in clustered(spark, rows, k=2, rounds=3, size=2)) == sorted(want)


def test_the_core_is_not_compared():
    from quillmine.llm.ballmeans import Balls

    centres = np.array([[0, 0], [100, 0], [1000, 0], [0, 110]])
    balls = Balls.of(centres, [60, 10, 10, 10])
    assert balls.neighbours[0].tolist() == [1, 3] and balls.neighbours[2].tolist() == []
    x = np.array([[49, 0], [50, 0], [51, 0], [0, 56], [3, 4]])
    at, distance = balls.assign(x, np.zeros(5, np.int64))
    assert at.tolist() == [0, 0, 1, 3, 0] and distance.tolist() == [2401, 2500, 2401, 54 * 54, 25]


def test_widths_of_packed_vectors():
    import pyarrow as pa

    from quillmine.llm.ballmeans import packed, unpacked

    small, large = np.array([[1, -2], [3, 4]]), np.array([[1 << 40, -(1 << 50)]])
    both = pa.concat_arrays([packed(small), packed(large), packed(np.empty((0, 2), np.int64))])
    assert unpacked(both, 2).tolist() == [*small.tolist(), *large.tolist()]
    assert unpacked(both.slice(1), 2).tolist() == [[3, 4], *large.tolist()]
