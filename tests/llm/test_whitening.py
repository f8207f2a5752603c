import math

import numpy as np
import pytest

from tablelore.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long, part int, slice int"


def table(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3, 4)
            for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors):
    """n, sums, components and eigenvalues of the distinct rounded vectors, by numpy."""
    x = sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors})
    n, sums = len(x), [sum(column) for column in zip(*x)]
    away = np.array(x, float) - np.array(sums) / n
    roots, basis = np.linalg.eigh(away.T @ away / n)
    return n, sums, roots[::-1], basis[:, ::-1]


def agrees(found, vectors, ids=None):
    n, sums, roots, basis = plain(vectors)
    live = [r for r in roots[:4] if r > 1e-9 * roots[0]]
    ids = list(range(len(vectors))) if ids is None else ids
    by_row = {}
    for r in found.collect():
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for ident, v in zip(ids, vectors):
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        rows = by_row[ident]
        assert sorted(rows) == list(range(1, min(4, len(sums)) + 1))
        for k, got in rows.items():
            r = got[0]
            assert r.n == n and int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            if k > len(live):
                assert r.whitened is None
                continue
            expected = float((np.array(x) - np.array(sums) / n) @ basis[:, k - 1] / math.sqrt(roots[k - 1]))
            if abs(expected) > 1e-6:
                signs.setdefault(k, math.copysign(1, expected) * math.copysign(1, r.whitened))
            assert r.whitened == pytest.approx(signs.get(k, 1) * expected, rel=1e-8, abs=1e-8)
            assert r.explained == pytest.approx(roots[k - 1] / roots.sum(), rel=1e-10)
            assert r.identity_error < 1e-8


def some(n, d, seed=0, spread=None):
    return np.random.default_rng(seed).normal(size=(n, d)) * (np.linspace(2, 0.5, d) if spread is None else spread)


def test_against_numpy_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "UPDATES", 7)
    monkeypatch.setattr(whitening, "FAN", 3)
    vectors = some(150, 12)
    agrees(whitening.whitened(table(spark, np.concatenate([vectors, vectors[:40]]), [*range(150), *range(40)])), vectors)


def test_degenerate_tables(spark):
    flat = some(60, 6, 2)
    flat[:, 2], flat[:, 4] = flat[:, 1], 0.25
    for vectors in (flat, some(20, 2, 3), some(4, 9, 4)):
        agrees(whitening.whitened(table(spark, vectors)), vectors)
    found = whitening.whitened(table(spark, [[1, 2], [1, 2]])).collect()
    assert len(found) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in found)


def test_unusable_rows_are_left_out(spark):
    odd = [None, [], [None, 1, 1], [float("nan"), 1, 1], [float("inf"), 1, 1], [1, 2], [1, 2, 3, 4]]
    good = some(30, 3, 5)
    found = whitening.whitened(table(spark, [*good, *odd]))
    assert {r.vec_id for r in found.select("vec_id").collect()} == set(range(30))
    agrees(found, good)
    assert whitening.whitened(table(spark, odd[:5])).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0


def test_large_entries_stay_exact(spark):
    vectors = [[1e15, -3.5, 2.0 ** 40], [7.0, 1e12, -1e14], [0.0, -0.0, 1e9], [5e14, 3.0, 8.0]]
    n, sums, _, _ = plain(vectors)
    expected = {(k, sum((n * math.floor(256 * float(np.float32(c))) - s) ** 2 for c, s in zip(v, sums))) for k, v in enumerate(vectors)}
    assert {(r.vec_id, int(r.deviation)) for r in whitening.whitened(table(spark, vectors)).collect()} == expected


@pytest.mark.parametrize("kind", ["spread", "equal columns", "one direction", "same vectors"])
def test_updates_and_joins_keep_the_spectrum(kind):
    x = np.floor(256 * some(200, 10, 7))
    if kind == "equal columns":
        x[:, 3:7] = x[:, 2:3]
    if kind == "one direction":
        x = np.outer(np.arange(200.0), np.ones(10))
    if kind == "same vectors":
        x[:] = x[0]

    def spectrum(rows):
        made = whitening.Spectrum(0, np.zeros(10), np.zeros(10), np.eye(10))
        for row in rows:
            made.add(row)
        return made
    away = x - x.mean(axis=0)
    scatter = away.T @ away
    for made in (spectrum(x), spectrum(x[:30]).join(spectrum(x[30:120])).join(spectrum(x[120:]))):
        assert made.n == 200 and np.allclose(made.mean, x.mean(axis=0))
        assert np.abs(made.basis.T @ made.basis - np.eye(10)).max() < 1e-11
        assert np.abs(made.basis * made.roots @ made.basis.T - scatter).max() <= 1e-11 * max(np.abs(scatter).max(), 1)


def test_secular_roots_are_roots():
    made = np.random.default_rng(8)
    for size in (1, 2, 3, 20):
        for _ in range(50):
            poles = np.sort(made.exponential(size=size)).cumsum()
            weights = made.exponential(size=size) ** 4 + 1e-12
            origin, way = whitening.secular_roots(poles, weights)
            roots = poles[origin] + way
            matrix = np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))
            assert np.allclose(roots, np.linalg.eigvalsh(matrix), rtol=1e-12, atol=1e-12 * roots[-1])
