import math

import numpy as np
import pytest

from trialspark.llm import exact_topk, permutation_index

VEC = "vec_id long, embedding array<float>, rank int"


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def brute_topk(rows, k=10, every=100):
    vectors = {i: [math.floor(1024 * x) for x in map(float, v)] for i, v in rows}
    out = []
    for q in vectors:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out += [(q, n + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:200] = x[0]  # a common vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    return rows + [(1000, [float(a) for a in x[3]]), (-100, [1e30] * 24), (1100, []), (1200, []), (1300, [1.0, 2.0]), (1400, [0.0] * 24)]


BAD = [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 24), (2300, [float("inf")] * 24), (None, [1.0] * 24)]


def test_topk_equals_brute_force(spark, awkward):
    df = spark.createDataFrame([(i, v, 0) for i, v in awkward + BAD + awkward[:3]], VEC)
    assert rows_of(exact_topk.top_k(df)) == brute_topk([(i, np.float32(v).tolist()) for i, v in awkward])
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_topk_over_many_tiles(spark, awkward, monkeypatch):
    from trialspark.llm import vectors

    monkeypatch.setattr(vectors, "TILE_ROWS", 100)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    df = spark.createDataFrame([(i, v, 0) for i, v in awkward], VEC)
    assert rows_of(exact_topk.top_k(df)) == brute_topk([(i, np.float32(v).tolist()) for i, v in awkward])


@pytest.mark.parametrize("share", [0.25, 1.0])
def test_nearest_recall(spark, sf, share):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in permutation_index.nearest(df, share=share).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s[ids == i][0] - v) < 1e-12 for i, v in got[q].values())
        hits += len({ids[i] for i in want} & {i for i, _ in got[q].values()})
    recall = hits / (20 * (ids % 20 == 0).sum())
    assert recall == 1 if share == 1 else recall >= 0.9


def test_nearest_edge_rows(spark, awkward):
    df = spark.createDataFrame([(i, v, 0) for i, v in awkward[:300] + awkward[-6:] + BAD + awkward[:2]], VEC)
    got = permutation_index.nearest(df, share=1.0).collect()
    used = {r.vec_id for r in got} | {r.query_id for r in got}
    assert not used & {2000, 2100, 2200, 2300, 1400, 1100, 1200} and -100 in used
    first = {r["rank"]: r.vec_id for r in got if r.query_id == 100}
    assert all(r.vec_id != r.query_id for r in got)
    common = [i for i in first.values() if i == 0 or 100 < i < 200]
    assert common == sorted(common) and len(common) >= 19
    assert permutation_index.nearest(df.limit(0)).count() == 0


def recall_of(got, rows, k=20):
    """Hits over wanted, per vector length, against all inner products."""
    hits, wanted = {}, {}
    for dim in {len(v) for _, v in rows}:
        ids = np.array([i for i, v in rows if len(v) == dim])
        x = np.array([v for _, v in rows if len(v) == dim])
        for q in ids[ids % 20 == 0]:
            s = x @ x[ids == q][0]
            want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
            wanted[dim] = wanted.get(dim, 0) + len(want)
            hits[dim] = hits.get(dim, 0) + len({int(ids[i]) for i in want} & got.get(int(q), set()))
    return {dim: hits[dim] / n for dim, n in wanted.items() if n}


def test_every_length_has_its_own_pivots(spark):
    """A rare length beside a common one, one with too few rows for pivots, and lengths of other magnitudes."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(9000)]
    rows += [(i, (rng.normal(size=24) * 1e-3).tolist()) for i in range(20_000, 20_800)]
    rows += [(i, rng.normal(size=6).tolist()) for i in range(30_000, 30_050)]
    rows += [(i, (rng.normal(size=5) * 1e150).tolist()) for i in range(40_000, 40_400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in permutation_index.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = recall_of(got, rows)
    assert set(recall) == {16, 24, 6, 5} and min(recall.values()) >= 0.9 and recall[6] == 1


def test_lengths_beyond_the_pivots_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "ALL_PIVOTS", 150)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 + i % 3).tolist()) for i in range(900)]
    got = {}
    for r in permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(recall_of(got, rows).values()) == {1.0}


@pytest.mark.parametrize("scale", [1e-200, 1e200])
def test_lengths_whose_squares_leave_the_doubles(spark, scale):
    """Products out of range leave no order to find; every candidate is still there and nothing fails."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(200)]
    got = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 * 20
