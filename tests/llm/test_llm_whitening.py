from __future__ import annotations

import numpy as np
import pytest

from shelfmark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, dims string"


def table(spark, vectors, partitions=4):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", "b", "c") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def spd(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q * np.array(values, float) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [1.0, 2.0, 3.0], [1.0] * 6, [0.0, 0.0, 0.0, 4.0], [7.0, 7.0, 7.0, 2.0, 2.0, 0.0],
        list(np.linspace(1, 2, 64)), [1e12, 1e6, 1.0, 1e-6], [3.0, 3.0 + 1e-9, 1.0], list(1.5 ** np.arange(40)),
    ],
)
def test_eigenvectors(values):
    a = spd(values)
    e, v = whitening.eigenvectors(a)
    assert np.allclose(e, np.sort(values)[::-1], rtol=1e-12, atol=1e-13 * max(values))
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ v - v * e).max() <= 1e-13 * max(values) * len(values)


def test_only_the_first_components():
    values = list(np.random.default_rng(1).uniform(1, 50, 30))
    a = spd(values)
    e, v = whitening.eigenvectors(a, 8)
    w, u = np.linalg.eigh(a)
    assert v.shape == (30, 8) and np.allclose(e, w[::-1][:8])
    assert np.allclose(np.abs((u[:, ::-1][:, :8] * v).sum(axis=0)), 1, atol=1e-11)


def test_a_diagonal_shift_on_an_eigenvalue():
    e, v = whitening.eigenvectors(np.diag([1.0, 2.0, 3.0]))
    assert np.allclose(e, [3, 2, 1]) and np.allclose(np.abs(v), np.eye(3)[::-1].T, atol=1e-14)


def test_polar_factor():
    a = spd([3.0, 1e-7, -2.0, -1e-9, 5.0])
    u = whitening.polar(a)
    w, q = np.linalg.eigh(a)
    assert np.allclose(u, q * np.sign(w) @ q.T, atol=1e-6) and np.allclose(u @ u, np.eye(5), atol=1e-13)


def brute(vectors, most=8):
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    deviation = [sum(int(c) ** 2 for c in row) for row in y]
    c = y.astype(np.float64) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, deviation, c @ u / np.sqrt(e), e / np.trace(v), u


def test_whitened(spark):
    rnd = np.random.default_rng(2)
    good = rnd.standard_normal((500, 12)) * np.linspace(0.2, 2, 12) + rnd.standard_normal(12)
    vectors = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (None, good[8])] + [(900 + k, good[3]) for k in range(200)]
    bad = [(-1, None), (-2, [None] * 12), (-3, [float("nan")] + [0] * 11), (-4, [float("inf")] + [0] * 11),
           (-5, [0.5] * 11), (-6, []), (-7, [float("-inf")] * 12), (-8, [1e30] * 12)]
    got = whitening.whitened(table(spark, vectors + bad)).collect()
    n, deviation, want, explained, _ = brute(vectors)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    ids = [r.vec_id for r in got]
    assert set(ids) == {i for i, _ in vectors}
    of = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for k, (i, _) in enumerate(vectors):
        for c in range(8):
            r = of[i, c + 1]
            s = sign.setdefault(c, np.sign(r.whitened * want[k, c]))
            assert abs(r.whitened - s * want[k, c]) < 1e-8
            assert abs(r.explained / explained[c] - 1) < 1e-10 and r.identity_error < 1e-9
            assert r.deviation == deviation[k]
    again = whitening.whitened(table(spark, vectors + bad, 9)).collect()
    key = lambda r: (str(r.vec_id), r.component, round(r.whitened, 12), r.deviation)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_no_variance_and_no_rows(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    # One direction only: one component; entries of any size have an exact deviation or none.
    got = whitening.whitened(table(spark, [(1, [1, 2]), (2, [3, 4]), (3, [2.0**39, 2.0**39])], 2)).collect()
    assert {r.component for r in got} == {1} and len(got) == 3
    assert {r.vec_id: r.deviation is None for r in got} == {1: True, 2: True, 3: True}
    few = whitening.whitened(table(spark, [(1, [0.5, 2]), (2, [0.25, 4])])).collect()
    assert sorted(abs(round(r.whitened, 9)) for r in few) == [1, 1] and few[0].deviation == few[1].deviation


def test_very_common_vectors_and_lengths(spark):
    # As many of two lengths: the longer one counts.
    vectors = [(i, [i, 1]) for i in range(5)] + [(10 + i, [i, 2, i * i]) for i in range(5)]
    got = whitening.whitened(table(spark, vectors)).collect()
    assert {r.vec_id for r in got} == set(range(10, 15)) and {r.n for r in got} == {5}
