"""Whitening against numpy's eigenvectors, whole-number arithmetic and polynomials with known roots."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fieldlens.llm import whitening


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + more)


def plain(rows, count=4):
    """(V, eigenvalues, eigenvectors, n, S, x by row) by numpy over the distinct integer vectors."""
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    fit = np.array(sorted({x for _, x in xs}), np.float64)
    v = np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)
    e, u = np.linalg.eigh(v)
    return v, e[::-1][:count], u[:, ::-1][:, :count], len(fit), fit.sum(axis=0).astype(int), xs


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(11)
    x = (rng.standard_normal((300, 12)) * np.linspace(2, 0.3, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300 + i, rows[i][1]) for i in range(50)] + [(7, rows[7][1]), (None, rows[3][1])]
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    frame = table(spark, [(i, v, 1, "a", 2) for i, v in rows + bad], ", component string, x int")
    out = whitening.whiten(frame).toPandas()
    v, e, u, n, s, xs = plain(rows)
    assert len(out) == 4 * len(rows) and set(out.n) == {n} and out.identity_error.nunique() == 1
    assert out.identity_error.iloc[0] < 1e-9
    for k in range(4):
        got = out[out.component == k + 1].groupby(["vec_id"], dropna=False).whitened.first()
        assert abs(out[out.component == k + 1].explained - e[k] / np.trace(v)).max() < 1e-12
        want = {i: (np.array(x) - s / n) @ u[:, k] / math.sqrt(e[k]) for i, x in xs if i is not None}
        sign = np.sign(got[0] * want[0])
        assert max(abs(sign * got[i] - w) for i, w in want.items()) < 1e-9
    far = out.groupby("vec_id").deviation.first()
    for i, x in xs:
        if i is not None:
            assert int(far[i]) == sum((n * int(c) - int(t)) ** 2 for c, t in zip(x, s))


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.standard_normal((80, 6)))]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    assert out.count() == 320 and out.where("deviation is null").count() == 0


def test_no_variance_few_dimensions_and_no_rows(spark):
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.n, r.whitened, r.explained, r.identity_error, r.deviation) for r in same] == [(1, None, 0.0, 0.0, 0)] * 4
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(5)])).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component > 1].whitened.isna().all()
    assert set(line.component) == {1, 2, 3} and (line[line.component == 1].explained == 1).all()
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 0)])).count() == 0
    huge = whitening.whiten(table(spark, [(i, [1e38 * i, 1.0, -1e30 * i], 0) for i in range(3)])).collect()
    assert len(huge) == 9  # saturated, not failed


def test_equal_eigenvalues_give_orthogonal_components(spark):
    points = [[s * 1.0 if j == k else 0.0 for j in range(5)] for k in range(3) for s in (1, -1)]
    rows = table(spark, [(i, p, 0) for i, p in enumerate(points)])
    n, s, q = whitening.fit_sums(whitening.integer_vectors(rows).select("x").distinct(), 5)
    fit = whitening.fit_components(spark, n, s, q)
    assert abs(fit.components[:3] @ fit.components[:3].T - np.eye(3)).max() < 1e-14
    assert fit.eigenvalues[:3] == [fit.eigenvalues[0]] * 3 and fit.eigenvalues[3] == 0
    assert whitening.whiten(rows).first().identity_error < 1e-12


def test_nearly_equal_eigenvalues(spark):
    m = [[10 ** 12, 1, 0], [1, 10 ** 12 + 1, 0], [0, 0, 10 ** 12 + 1]]
    trace = sum(m[i][i] for i in range(3))
    poly = whitening.characteristic(spark, m)
    roots = whitening.largest_roots(poly, 3, trace, whitening.primes_for(trace, 3))
    assert [r.times for r in roots] == [1, 1, 1]
    vectors = [[float(c) for c in whitening.null_space(m, r, 1)[0]] for r in roots]
    golden = (1 + 5 ** 0.5) / 2
    norm = math.hypot(1, golden)
    want = [[1 / norm, golden / norm, 0], [0, 0, 1], [golden / norm, -1 / norm, 0]]
    assert np.allclose(np.abs(vectors), np.abs(want), atol=1e-15)


def determinant(m):
    m, out = [[Fraction(v) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        at = next((i for i in range(k, len(m)) if m[i][k]), None)
        if at is None:
            return Fraction(0)
        if at != k:
            m[k], m[at], out = m[at], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


@pytest.mark.parametrize("dim,rank", [(1, 1), (2, 1), (6, 6), (7, 3)])
def test_characteristic_polynomial_is_exact(spark, dim, rank):
    rng = np.random.default_rng(dim)
    b = rng.integers(-10 ** 6, 10 ** 6, (dim, rank)).astype(object)
    b[0, 0] = 0
    m = (b @ b.T).tolist()
    poly = whitening.characteristic(spark, m)
    assert poly[-1] == 1 and len(poly) == dim + 1
    for x in range(-2, dim + 1):
        assert whitening.value(poly, x) == determinant([[x * (i == j) - m[i][j] for j in range(dim)] for i in range(dim)])


def test_roots_and_multiplicities():
    def expand(roots):
        p = [1]
        for r in roots:
            p = [a - r * b for a, b in zip([0, *p], [*p, 0])]
        return p
    true = [0, 0, 3, 7, 7, 7, 10 ** 9, 10 ** 9 + 1, 10 ** 9 + 1]
    moduli = whitening.primes_for(sum(true), len(true))
    roots = whitening.largest_roots(expand(true), 6, sum(true), moduli)
    near = [(round((2 * r.low + 1) / 2 ** (r.bits + 1)), r.times) for r in roots]
    assert near == [(10 ** 9 + 1, 2), (10 ** 9, 1), (7, 3)]
    assert whitening.roots_above(expand(true), 7) == 3 and whitening.roots_above(expand(true), 6) == 6
    assert all(p % q for p in moduli for q in range(3, 2000, 2)) and len(set(moduli)) == len(moduli)
