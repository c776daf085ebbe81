import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from plumbob.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, place string, deviation string"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=16):
    """Components from the covariance, by the library."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if kept else 0
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in kept if len(v) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    if not n:
        return kept, n, [], np.zeros((0, 0)), np.zeros(0), 0
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    trace = values.sum()
    kept_components = [k for k in order if values[k] > 1e-18 * max(trace, 1e-300) and values[k] > 1e-9][:components]
    return kept, n, sums, vectors[:, kept_components], values[kept_components], trace


def check(df, rows, components=16, equal=False):
    kept, n, sums, vectors, values, trace = plain(rows, components)
    got = df.toPandas()
    assert list(got.columns) == NAMES
    assert len(got) == len(kept) * len(values)
    if not len(got):
        return
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8
    for k, value in enumerate(values):
        part = got[got.component == k + 1]
        assert np.allclose(part.explained, value / trace, rtol=1e-9)
        # Rows of one id are told apart by what they hold.
        mine = sorted(zip(part.vec_id.fillna(-1), map(int, part.deviation), part.whitened), key=lambda t: (t[0], t[1], abs(t[2])))
        theirs = []
        for i, x in kept:
            gap = [n * a - s for a, s in zip(x, sums)]
            y = np.array([float(g) / n for g in gap]) @ vectors[:, k] / math.sqrt(value)
            theirs.append((-1 if i is None else i, sum(g * g for g in gap), y))
        theirs.sort(key=lambda t: (t[0], t[1], abs(t[2])))
        assert [t[:2] for t in mine] == [t[:2] for t in theirs]
        if not equal:
            a, b = np.array([t[2] for t in mine]), np.array([t[2] for t in theirs])
            sign = np.sign(a @ b)
            assert np.allclose(a, sign * b, rtol=1e-7, atol=1e-8)


def cloud(rows, width, seed=0):
    rng = np.random.default_rng(seed)
    spread = rng.standard_normal((width, width)) * np.linspace(2, 0.2, width)
    return [(i, (rng.standard_normal(width) @ spread).tolist()) for i in range(rows)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0])],
        [(1, [1.0, 2.0])],
        [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [4.0, -2.0]), (3, [1.0])],
        cloud(40, 5) + [(7, cloud(1, 5)[0][1])] * 300 + [(None, cloud(1, 5)[0][1]), (-1, None), (8, [0.5] * 4)],
        cloud(200, 24, 3),
        [(i, v[:3] + v[:3] + [1.0]) for i, v in cloud(60, 3, 5)],
        [(1, [3e5, 0.0, 1.0]), (2, [-2e5, 1.0, 1.0]), (3, [5.0, 9.0, 2.0]), (4, [5.5, -9.0, 2.0])],
    ],
)
def test_small_tables(frame, rows):
    check(whitening.whiten(frame(rows, SCHEMA)), rows)


def test_equal_eigenvalues(frame):
    """One-hot vectors: all eigenvalues but one are equal, so single series end at once."""
    rows = [(i, [float(i == j) for j in range(6)]) for i in range(6)]
    fitted = whitening.Whitening(whitening.FitList(whitening.whole_vectors(frame(rows, SCHEMA))))
    assert len(fitted.deviations) == 5 and np.allclose(fitted.deviations, fitted.deviations[0])
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(5)) and fitted.identity_error < 1e-10
    check(whitening.whiten(frame(rows, SCHEMA)), rows, equal=True)


def test_components_of_spread_out_deviations(frame):
    """Deviations over more than four orders of magnitude."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** np.linspace(3.5, -1, 8)).tolist()) for i in range(400)]
    check(whitening.whiten(frame(rows, SCHEMA)), rows)


def test_huge_entries_do_not_end_the_query(frame):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [5.0, 9.0])]
    got = whitening.whiten(frame(rows, SCHEMA)).collect()
    assert len(got) in (3, 6) and all(r["n"] == 3 for r in got)


def test_query_over_the_table(spark, data):
    t = pq.read_table(f"{data}/embeddings.parquet").to_pylist()
    check(queries.op11_lanczos_whitening(spark, data), [(r["vec_id"], r["embedding"]) for r in t])
