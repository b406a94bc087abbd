import numpy as np
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import ann, impact, vectors


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, ids, x):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(ids, scores, queries, k):
    out = []
    for q in queries:
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-scores[q][j], ids[j]))[:k]
        out += [(int(ids[q]), r + 1, int(ids[j]), scores[q][j]) for r, j in enumerate(order)]
    return sorted(out)


def odd_rows():
    return [(10_000, None), (10_050, [None] * 8), (10_100, [float("nan")] * 8), (10_150, [float("inf")] * 8), (10_200, []), (10_250, [1.0, 0.5])]


@pytest.mark.parametrize(("block", "impacts"), [(1 << 22, 1024), (320, 8)])
def test_top_k_is_exact(spark, monkeypatch, block, impacts):
    monkeypatch.setattr(vectors, "SHARD", block)
    monkeypatch.setattr(impact, "IMPACTS", impacts)
    rng = np.random.default_rng(0)
    x = unit(rng, 300, 8)
    x[100:140] = x[50]  # ties
    x[7] = 0
    ids = rng.permutation(300)
    odd = odd_rows()
    df = frame(spark, [*ids, *[i for i, _ in odd], ids[3]], [*x, *[v for _, v in odd], x[3]])
    got = sorted(tuple(r) for r in impact.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    scores = whole @ whole.T
    assert got == brute(ids, scores, [i for i in range(300) if ids[i] % 50 == 0], 5)


def test_top_k_small(spark):
    df = frame(spark, [0, 1, 2], [[0.1, 0.2], [0.3, -0.1], [0.0, 0.0]])
    assert len(impact.top_k(df, F.col("vec_id") == 0, 5).collect()) == 2
    assert impact.top_k(df.filter("vec_id > 7"), F.col("vec_id") == 0, 5).collect() == []


def test_index_on_signed_and_sparse_vectors():
    rng = np.random.default_rng(4)
    for n, d in ((1, 3), (70, 3), (900, 16)):
        rows = rng.integers(-90, 90, (n, d))
        rows[:, 0] = 0
        index = impact.Index(np.arange(n) * 2, rows)
        for q in (rows[0], -rows[n // 2], np.zeros(d, np.int32)):
            ids, scores = index.search(0, q.astype(np.int64), 5)
            want = sorted(((-int(rows[j] @ q), 2 * j) for j in range(1, n)))[:5]
            assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


@pytest.mark.parametrize(("bits", "dims", "n"), [(24, 512, 300), (24, 5000, 60), (7, 5000, 200), (40, 64, 200), (61, 8, 100), (20, 16, 3000)])
def test_index_on_large_and_wide_vectors(bits, dims, n):
    rng = np.random.default_rng(bits)
    rows = rng.integers(-(1 << bits), 1 << bits, (n, dims))
    rows[5] = rows[6]
    index = impact.Index(np.arange(n), rows)
    end = (1 << 63) - 1
    for i in range(0, 40, 2):
        ids, scores = index.search(i, rows[i], 5)
        exact = rows.astype(object) @ rows[i].astype(object)
        want = sorted((-max(min(int(x), end), -end - 1), j) for j, x in enumerate(exact) if j != i)[:5]
        assert [(-int(s), int(j)) for j, s in zip(ids, scores, strict=True)] == want


def test_top_k_of_huge_components(spark):
    """Scores beyond a long become the nearest long; nothing wraps."""
    df = frame(spark, [0, 1, 2, 3], [[3e30, 1.0], [1e30, 0.5], [-2e30, 0.5], [0.0, 0.5]])
    got = [(r.vec_id, r.score) for r in impact.top_k(df, F.col("vec_id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (3, 256 * 128), (2, -(1 << 63))]


def test_only_queries_are_copied(spark):
    """Shuffled rows: each vector once, each query once a block."""
    x = unit(np.random.default_rng(9), 400, 4)
    plan = impact.top_k(frame(spark, range(400), x), F.col("vec_id") % 50 == 0, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join" not in plan


@pytest.mark.parametrize("part", [1 << 22, 4000])
def test_neighbours(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "SHARD", part)
    rng = np.random.default_rng(1)
    x = unit(rng, 2500, 32)
    x[500:620] = x[499]  # a group of copies
    ids = np.arange(2500)
    odd = odd_rows() + [(10_300, [0.0] * 32)]
    df = frame(spark, [*ids, *[i for i, _ in odd]], [*x, *[v for _, v in odd]])
    rows = ann.neighbours(df, F.col("vec_id") % 20 == 0, 20).collect()
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    queries = [i for i in ids if i % 20 == 0]
    want = brute(ids, np.round(scores, 12), queries, 20)
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == 20 * len(queries) and len(got) == len(rows)
    assert len(got & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9
    for r in rows:
        assert abs(r.score - scores[r.query_id, r.vec_id]) < 1e-12
    copies = sorted((r.rank, r.vec_id) for r in rows if r.query_id == 600)
    assert [v for _, v in copies] == list(range(499, 519))


def test_neighbours_with_few_vectors_are_all(spark):
    df = frame(spark, range(8), unit(np.random.default_rng(2), 8, 5))
    assert len(ann.neighbours(df, F.col("vec_id") == 0, 20).collect()) == 7
    assert ann.neighbours(df.filter("vec_id > 70"), F.col("vec_id") == 0, 20).collect() == []


def test_rotations_keep_lengths():
    x = unit(np.random.default_rng(3), 50, 24)
    y = ann.rotated(x, 0)
    norms = np.linalg.norm(y, axis=1)
    assert np.allclose(norms, norms[0]) and y.shape == (50, 32)
    assert (ann.axes(x, 1, 5)[:, :1] == ann.axes(x, 1, 1)).all()


@pytest.mark.parametrize(("dims", "n", "k"), [(64, 100_000, 20), (128, 20_000, 20), (256, 8_000, 20), (8, 20_000, 20), (64, 500, 20)])
def test_recall_of_fitted_probes(dims, n, k):
    """Unit vectors without structure, shard by shard as the search does: at least 0.9, and not by probing every axis."""
    rng = np.random.default_rng(dims)
    x = unit(rng, n, dims)
    probes = {dims: ann.probes_for(x[rng.permutation(n)[: ann.SAMPLE]], n, k)}
    if n >= 8000:
        assert probes[dims] < ann.every_axis(dims) / 2
    asked = np.arange(0, n, max(n // 60, 1))
    q, parts = x[asked].astype(np.float64), []
    for i in range(0, n, 65_536):
        parts += list(ann.Tables(np.arange(i, min(n, i + 65_536)), x[i : i + 65_536], probes).ask(asked, x[asked], k))
    query, vec, _ = vectors.best(*[np.concatenate(c) for c in zip(*parts, strict=True)], k)
    scores = q @ x.astype(np.float64).T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = {(int(a), int(v)) for a, row in zip(asked, np.argpartition(-scores, k - 1, axis=1)[:, :k], strict=True) for v in row}
    recall = len(want & set(zip(query.tolist(), vec.tolist(), strict=True))) / len(want)
    print(dims, n, probes, recall)
    assert recall >= 0.9
