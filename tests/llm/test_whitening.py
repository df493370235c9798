import numpy as np
import pytest

from cadenza.llm import whitening as w
from cadenza.tables import table
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, x string, v string, block string, n int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v],
                                   "x", "v", "b", 1) for i, v in zip(ids, vectors)], SCHEMA)


def exact(vectors):
    """Distinct integer vectors, and eigenvalues and vectors by numpy."""
    x = np.array([[np.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    c = (n * u - sums) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, n, sums, e[::-1], q[:, ::-1]


def held_against_numpy(spark, vectors, components=w.COMPONENTS, tolerance=1e-9):
    rows = w.whiten(frame(spark, vectors).repartition(3), components=components).collect()
    x, n, sums, e, q = exact(vectors)
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(rows) == len(vectors) * k
    got = np.zeros((len(vectors), k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    want = (n * x - sums) / n @ q[:, :k] / np.sqrt(e[:k])
    signs = np.sign((got * want).sum(0))
    return np.abs(got - want * signs).max(), got, e, k


@pytest.mark.parametrize("size,rows", [(3, 40), (24, 300), (40, 12)])
def test_against_numpy(spark, size, rows):
    """Also with fewer rows than dimensions."""
    rng = np.random.default_rng(size)
    vectors = rng.normal(size=(rows, size)) * np.linspace(3, 0.3, size)
    vectors = np.vstack([vectors, vectors[:5]])
    error, *_ = held_against_numpy(spark, vectors)
    assert error < 1e-8


def test_converges_before_all_dimensions(spark):
    """Few strong directions among many: the iteration may end early."""
    rng = np.random.default_rng(2)
    strong = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 60)) * 20
    vectors = strong + rng.normal(size=(400, 60)) * 0.05
    steps = []
    original = w._products
    w._products = lambda *a: steps.append(1) or original(*a)
    try:
        error, *_ = held_against_numpy(spark, vectors, components=3)
    finally:
        w._products = original
    assert error < 1e-7 and len(steps) < 60


def test_equal_eigenvalues_and_constant_entries(spark):
    """Equal eigenvalues end a direction early; constant entries have no
    component. The components span what they must."""
    corners = [[a, b, c, 5, 0] for a in (-1, 1) for b in (-1, 1) for c in (-2, 2)]
    rows = w.whiten(frame(spark, corners)).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    explained = {r.component: r.explained for r in rows}
    assert np.allclose([explained[i] for i in (1, 2, 3)], [4 / 6, 1 / 6, 1 / 6])
    z = np.zeros((8, 3))
    for r in rows:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(z.T @ z / 8, np.eye(3), atol=1e-9)


def test_awkward_rows(spark):
    """Nulls, non-finite entries, repeated rows and ids, several lengths,
    one distinct vector, and no rows at all."""
    good = [[0.1, 0.5], [0.7, -0.2], [0.4, 0.9]]
    bad = [None, [None, 0.1], [float("nan"), 0.1], [float("inf"), 0.1], [0.1, -float("inf")]]
    rows = w.whiten(frame(spark, good + bad + [good[0]], [0, 1, None, 3, 4, 5, 6, 7, 0])).collect()
    assert len(rows) == 8 and {r.vec_id for r in rows} == {0, 1, None} and {r.n for r in rows} == {3}
    mixed = w.whiten(frame(spark, [*good, [1, 2, 3], [3, 2, 1], []])).collect()
    assert {(r.vec_id, r.n) for r in mixed} == {(0, 3), (1, 3), (2, 3), (3, 2), (4, 2)}
    assert w.whiten(frame(spark, [[1, 2], [1, 2]])).count() == 0
    assert w.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                                  "identity_error"]
    assert w.whiten(frame(spark, [])).count() == 0


def test_given_vectors(spark):
    vectors = [r.embedding for r in table(spark, SF_SMALL, "embeddings").orderBy("vec_id").collect()]
    error, *_ = held_against_numpy(spark, vectors)
    assert error < 1e-8


def test_deviations_beyond_64_bits_of_numpy():
    m = np.array([[3, 4]], np.int64)
    with pytest.raises(OverflowError):
        w._deviations(m, 1 << 61, np.zeros(2, np.int64))
