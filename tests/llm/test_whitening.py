import math

import numpy as np
import pytest
from support import SMALL

from tabulark.llm import queries
from tabulark.llm import whitening as wh


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_eigenvectors(n):
    b = np.random.default_rng(n).normal(size=(n, 2 * n))
    a = b @ b.T
    values, vectors = wh.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() < 1e-13 * values[0] * n


@pytest.mark.parametrize("a", [np.zeros((4, 4)), np.ones((5, 5)), np.diag([3.0, 3.0, 1.0]), np.diag([1e-9, 1e9, 0.0])])
def test_eigenvalues_of_degenerate_matrices(a):
    values, vectors = wh.eigen(a)
    assert np.allclose(values, np.sort(np.diag(a) if a[0, -1] == 0 else [5, 0, 0, 0, 0])[::-1], atol=1e-12) and np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


def test_merged_parts_are_the_whole():
    x = np.random.default_rng(5).integers(999_900, 1_000_100, (400, 6)).astype(np.int64)
    whole, state = wh.Moments.of(x), None
    for part in (x[:1], x[1:7], x[7:300], x[300:]):
        state = wh.merge(state, wh.merge(None, wh.Moments.of(part)))
    exact = np.cov(x - 1_000_000, rowvar=False, bias=True)
    for m in (whole, state):
        assert m.n == 400 and (m.sums == x.sum(0)).all() and np.allclose(m.base + m.mean, x.mean(0), rtol=1e-15) and np.allclose(m.covariance, exact, rtol=1e-11, atol=1e-9)
    assert wh.Moments.of([]) is None


def brute(rows, most=16):
    """(n, sums, whitened up to sign, shares of the trace) by whole matrices in memory."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = ((fit * n - s) / n).T @ ((fit * n - s) / n) / n
    values, vectors = (z[..., ::-1] for z in np.linalg.eigh(v))
    return n, [sum(int(d) ** 2 for d in r) for r in x * n - s], ((x * n - s) / n) @ vectors[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def test_query_by_brute_force(spark):
    source = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = brute([r["embedding"] for r in source])
    got = queries.op13_whitening(spark, SMALL).toPandas()
    assert len(got) == 16 * len(source) and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in source]].to_numpy()
    assert np.abs(z * np.sign((z * whitened).sum(0)) - whitened).max() < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().loc[[r["vec_id"] for r in source]].tolist() == deviation


def test_rows_left_out_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    good = [[float(c) for c in rng.normal(size=3)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(good)] + [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (None, good[0]), (0, good[0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, doc string, n int")
    out = wh.whiten(df).collect()
    assert sorted(str(r["doc"]["vec_id"]) for r in out) == sorted(str(i) for i in [*range(40), None, 0]) and out[0]["doc"].asDict().keys() == {"vec_id", "embedding", "doc", "n"}
    n, deviation, whitened, _ = brute(good)
    assert {r["n"] for r in out} == {40} and len(out[0]["whitened"]) == 3
    z = {r["doc"]["vec_id"]: r for r in out}
    assert z[None]["whitened"] == z[0]["whitened"] and [z[i]["deviation"] for i in range(40)] == deviation


def test_a_vector_that_most_rows_have_counts_once(spark):
    rng = np.random.default_rng(4)
    some = [[float(c) for c in rng.normal(size=4)] for _ in range(30)]
    df = spark.createDataFrame([(i, some[min(i, 29)]) for i in range(3000)], "vec_id long, embedding array<float>")
    out = wh.whiten(df, carry=["vec_id"]).collect()
    assert len(out) == 3000 and out[0]["n"] == 30 and out[0]["identity_error"] < 1e-10


def test_components_without_variance_dont_exist(spark):
    flat = spark.createDataFrame([(i, [float(i % 5), float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {len(r["whitened"]) for r in wh.whiten(flat).collect()} == {1}
    one = flat.filter("vec_id = 3")
    assert wh.whiten(one).count() == 0 and wh.whiten(one.limit(0)).count() == 0


def test_huge_entries(spark):
    rows = [(i, [float(i), 1e300 if i == 0 else -float(i)]) for i in range(9)]
    out = {r["doc"]["vec_id"]: r for r in wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    bounded = [[a, min(b, wh.LARGEST)] for _, (a, b) in rows]
    assert {k: r["deviation"] for k, r in out.items()} == {i: d if d < 1 << 63 else None for i, d in enumerate(brute(bounded, 2)[1])}
    assert all(np.isfinite(r["whitened"]).all() for r in out.values())
