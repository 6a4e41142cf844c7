import numpy as np
import pytest

from caseloom.llm import whitening

KIND = "vec_id long, embedding array<float>"


def close_to_eigh(a, k):
    values, vectors = whitening.leading(a, k)
    expected = np.linalg.eigvalsh(a)[::-1][:k]
    span = np.abs(expected).max() or 1.0
    assert np.allclose(values, expected, rtol=0, atol=1e-13 * span * len(a))
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * span * len(a)


@pytest.mark.parametrize("d", [1, 2, 3, 5, 17, 64, 130])
def test_leading_pairs_against_the_library(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d + 2, d)) * rng.uniform(0.1, 40, d)
    close_to_eigh(x.T @ x, min(8, d))
    # close, equal and zero eigenvalues; matrices that are diagonal, or fall into blocks
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spread = np.r_[np.full(min(d, 5), 3.0), 3 - 1e-9, 3 - 1e-6, np.zeros(d)][:d]
    a = (q * spread) @ q.T
    close_to_eigh((a + a.T) / 2, min(8, d))
    close_to_eigh(np.diag(spread), min(8, d))
    close_to_eigh(np.zeros((d, d)), min(8, d))
    close_to_eigh(np.kron(np.eye(2), x.T @ x), 8)


def test_sturm_count_is_the_number_of_smaller_eigenvalues():
    rng = np.random.default_rng(1)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29) * (rng.random(29) > 0.2)
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 101)
    assert np.array_equal(whitening.sturm_count(diagonal, off, at), (values[None, :] < at[:, None]).sum(axis=1))


def checked(rows, got, k):
    """Compare with a plain computation in whole numbers and numpy."""
    used = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    x = np.floor(1024 * np.array([np.float32(v) for _, v in used], float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    cov = np.cov(x.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (x - sums / n) @ vectors / np.sqrt(values)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    table = {}
    for r in got:
        table.setdefault(r.component, []).append(r)
    assert sorted(table) == list(range(1, k + 1)) and all(len(t) == n for t in table.values())
    key = lambda pair: (pair[0] is None, pair[0], pair[1])
    for c, some in table.items():
        mine = sorted([((r.vec_id, r.deviation), r.whitened) for r in some], key=lambda p: key(p[0]))
        other = sorted([((i, e), w) for (i, _), e, w in zip(used, exact, white[:, c - 1], strict=True)], key=lambda p: key(p[0]))
        assert [p[0] for p in mine] == [p[0] for p in other]
        a, b = (np.array([p[1] for p in side]) for side in (mine, other))
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
        assert all(r.n == n and abs(r.explained / (values[c - 1] / np.trace(cov)) - 1) < 1e-9 for r in some)
    assert 0 <= max(r.identity_error for r in got) < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((600, 20)) @ (rng.standard_normal((20, 20)) * 0.1)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(300)] + [(None, hot), (None, rows[4][1]), (5, rows[5][1])]
    nan, inf = float("nan"), float("inf")
    odd = [(-1, None), (-2, []), (-3, [nan] * 20), (-4, [inf, *[0.0] * 19]), (-5, [None, *[0.0] * 19])]
    vectors = spark.createDataFrame(rows + odd, KIND).selectExpr("*", "1 AS component", "'a' AS n", "2 AS whitened").repartition(5)
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    checked(rows, got, 8)


def test_few_dimensions_equal_rows_and_no_rows(spark):
    def run(rows):
        vectors = spark.createDataFrame(rows, KIND)
        return whitening.whiten(vectors, whitening.fit(vectors)).collect()

    rows = [(1, [0.0, 1.0, 0.5]), (2, [0.0, 3.0, 0.5]), (3, [0.0, -1.0, 0.25]), (4, [0.0, 1.5, 0.75])]
    checked([(i, v[1:]) for i, v in rows], run([(i, v[1:]) for i, v in rows]), 2)
    got = run(rows)  # a dimension without spread has no component
    assert sorted({r.component for r in got}) == [1, 2] and max(r.identity_error for r in got) < 1e-9
    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])] * 5) == []
    assert len(run(rows + [(9, [1.0])])) == len(run(rows + [(8, [3e9, 0.0, 0.0])])) == 8  # another length, too large


def test_deviations_that_need_more_than_a_double():
    n = 3_000_000
    x = np.array([[100_300, 99_700, 100_001], [100_000, 100_000, 2_000_000_000]])
    sums = np.array([100_000 * n + 7, 100_000 * n - 3, 100_000 * n + 1])
    model = whitening.Model(n, sums, np.ones(1), np.ones((1, 3)), 1.0)
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert exact[0] > 1 << 53 and model.deviations(x) == [exact[0], None]
