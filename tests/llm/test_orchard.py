import hashlib
import math

import numpy as np
import pytest

from trialspark.llm import orchard

VEC = "vec_id long, embedding array<float>, cluster int"


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in map(float, v)]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(cents)]
    found = [(i, near(v)) for i, v in kept]
    cut = lambda x: min(x, 2**63 - 1)
    inertia = {}
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + cut(d)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, cut(d), cut(inertia[j]), cut(sum(inertia.values())), sha[j]) for i, (d, j) in found), key=str)


def got(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def rows(n, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64))
    return [(i, np.float32(centres[i % 6] * spread + rng.normal(size=64) * 0.4).tolist()) for i in range(n)]


BAD = [(1, None), (2, [0.5] * 63), (3, [0.5] * 65), (4, []), (5, [None] + [0.5] * 63), (6, [float("nan")] * 64), (7, [float("-inf")] * 64)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0) for i, v in data], VEC).repartition(4)


def test_clusters_equal_plain_rounds(spark):
    data = rows(300)
    data += [data[0]] * 40 + [(None, data[3][1]), (None, data[4][1]), (5, data[7][1])] + BAD
    assert got(orchard.cluster(frame(spark, data))) == plain(data)


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    data = rows(n) + BAD
    assert got(orchard.cluster(frame(spark, data))) == plain(data)


def test_ties_go_to_the_smaller_number(spark):
    data = [(i, [float(i % 2)] + [0.0] * 63) for i in range(40)]
    assert got(orchard.cluster(frame(spark, data))) == plain(data)


def test_huge_components_stay_exact(spark):
    data = rows(30) + [(100, [3e38] * 64), (101, [-3e38] + [0.0] * 63), (102, [2.0**30] * 64)]
    found = orchard.cluster(frame(spark, data))
    assert got(found) == plain([(i, np.float32(v).tolist()) for i, v in data])
    assert found.agg({"distance": "max"}).first()[0] <= 2**63 - 1


def test_search_compares_few_and_equals_brute_force():
    rng = np.random.default_rng(0)
    cents = rng.integers(-300, 300, size=(64, 8))
    x = cents[rng.integers(0, 64, 5000)] + rng.integers(-9, 9, size=(5000, 8))
    best, near, compared = orchard.Index.of(cents.tolist()).nearest(x)
    d = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (near == d.min(1)).all() and compared < 5000 * 64 * 0.75


def test_result_does_not_depend_on_partitions(spark):
    df = frame(spark, rows(200))
    assert got(orchard.cluster(df.repartition(1))) == got(orchard.cluster(df.repartition(9)))
