"""Whitening against numpy's eigenvectors of the exact covariance."""

import random

import numpy as np
import pytest

from lorestone.llm import whitening
from lorestone.llm.queries import QUERIES


def brute(vectors, most=16):
    """{row: (n, deviation, whitened, explained)}, and the eigenvalues."""
    x = {i: np.floor(np.array(v, np.float64) * 64).astype(np.int64) + 1_000_000 for i, v in vectors.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    trace = float((centred**2).sum() / n)
    return {i: (n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)), (v - sums / n) @ axes / np.sqrt(values), values / trace) for i, v in x.items()}


def check(rows, vectors, most=16):
    want = brute(vectors, most)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(want)
    sign = None
    for i, (n, deviation, whitened, explained) in want.items():
        own = [got[i][k] for k in sorted(got[i])]
        assert [r["component"] for r in own] == list(range(1, len(whitened) + 1))
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        ours = np.array([r["whitened"] for r in own])
        sign = np.sign(ours * whitened) if sign is None else sign
        assert np.allclose(ours, whitened * sign, atol=1e-7)
        assert np.allclose([r["explained"] for r in own], explained, rtol=1e-9)
        assert all(0 <= r["identity_error"] < 1e-9 for r in own)


def drawn(seed, n, dim):
    r = np.random.default_rng(seed)
    return {i: [float(c) for c in v.astype(np.float32)] for i, v in enumerate(r.standard_normal((n, dim)) * np.linspace(1, 4, dim))}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", [1]) for i, v in rows], "vec_id long, embedding array<float>, x string, part array<long>").repartition(4)


@pytest.mark.parametrize("n,dim", [(400, 24), (300, 5), (60, 120)])
def test_against_numpy(spark, n, dim):
    vectors = drawn(n, n, dim)
    most = min(16, dim)
    check(whitening.whiten(frame(spark, list(vectors.items()))).collect(), vectors, most)


def test_copies_weigh_as_one(spark):
    vectors = drawn(3, 200, 8)
    copies = {1000 + i: vectors[0] for i in range(400)}
    rows = whitening.whiten(frame(spark, list((vectors | copies).items()))).collect()
    check(rows, vectors | copies, 8)
    assert {r["n"] for r in rows} == {200}


def test_odd_rows(spark):
    vectors = drawn(4, 100, 4)
    odd = [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [float("nan")] * 4), (503, [1.0, float("inf"), 0.0, 0.0]), (504, [1e30, 0.0, 0.0, 0.0]), (505, [])]
    twice = [(7, vectors[7]), (7, vectors[7])]
    got = whitening.whiten(frame(spark, [*vectors.items(), *odd, *twice, (None, vectors[1])])).collect()
    assert len([r for r in got if r["vec_id"] == 7]) == 12 and len([r for r in got if r["vec_id"] is None]) == 4
    assert not {r["vec_id"] for r in got} & {i for i, _ in odd}
    once = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}
    check(once.values(), vectors, 4)


def test_lengths_are_apart_and_equal_vectors_have_no_components(spark):
    a, b = drawn(5, 50, 3), {i + 100: v for i, v in drawn(6, 60, 6).items()}
    same = {i + 300: [1.0] * 9 for i in range(5)}
    got = whitening.whiten(frame(spark, [*a.items(), *b.items(), *same.items()])).collect()
    check([r for r in got if r["vec_id"] < 100], a, 3)
    check([r for r in got if r["vec_id"] >= 100], b, 6)


def test_dimensions_without_variance_of_their_own(spark):
    """Of six dimensions two repeat others, and one never changes: three components are left."""
    r = random.Random(1)
    vectors = {i: [a := r.randint(-9, 9), b := r.randint(-9, 9), c := r.randint(-9, 9), a, b, 2.0] for i in range(80)}
    vectors = {i: [float(c) for c in v] for i, v in vectors.items()}
    got = whitening.whiten(frame(spark, list(vectors.items()))).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and all(r["identity_error"] < 1e-9 for r in got)
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-9


def test_deviations_beyond_a_long_are_null(spark):
    vectors = {i: [2.0**31 * (i % 7), float(i)] for i in range(2000)}
    got = whitening.whiten(frame(spark, list(vectors.items()))).collect()
    want = brute(vectors)
    assert {r["deviation"] for r in got if r["vec_id"] == 6} == {None} and want[6][1] >= 2**63


def test_query_and_no_rows(spark, tmp_path):
    vectors = drawn(8, 90, 20)
    frame(spark, list(vectors.items())).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    check(QUERIES["op13_whitening"](spark, str(tmp_path / "a")).collect(), vectors)
    frame(spark, []).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    assert QUERIES["op13_whitening"](spark, str(tmp_path / "b")).collect() == []
