import math
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbob.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, v string, score string"


def brute(rows, k, asks):
    rows = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (i, q) in enumerate(rows):
        if asks(i):
            found = [(-int(q @ c), j is None, j) for b, (j, c) in enumerate(rows) if a != b and len(c) == len(q)]
            out += [(i, n, j, -s) for n, (s, _, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(df, k=5, **kw):
    return sorted(map(tuple, topk.top_k(df, k, F.col("vec_id") % 5 == 0, **kw).collect()), key=str)


def random_rows(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_random(frame, monkeypatch, lists):
    rows = random_rows()
    assert run(frame(rows, SCHEMA), lists=lists) == brute(rows, 5, lambda i: i % 5 == 0)


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 4) + [(100, None), (105, []), (110, [1.0, nan, 0.0, 0.0]), (115, [1.0, None, 0.0, 0.0]), (120, [inf, 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (5, rows[5][1]), (5, [0.5, 0.5, 0.0, 0.0]), (130, [1.0, 2.0]), (131, [2.0, 1.0]), (135, [1.0])]
    rows += [(200 + i, [0.25, -0.5, 1.0, 2.0]) for i in range(40)] + [(300, [0.0] * 4), (305, [-1.0] * 4)]
    got = run(frame(rows, SCHEMA))
    assert got == brute(rows, 5, lambda i: i is not None and i % 5 == 0)


def test_small_blocks_and_lists(frame, monkeypatch):
    for name, n in (("CANDIDATES_PER_BLOCK", 16), ("QUERIES_PER_BLOCK", 4), ("DEPTH", 3)):
        monkeypatch.setattr(topk, name, n)
    rows = random_rows(200, 6, 3)
    assert run(frame(rows, SCHEMA)) == brute(rows, 5, lambda i: i % 5 == 0)


@pytest.mark.parametrize("rows", [[], [(5, [1.0, 2.0])], [(5, [1.0, 2.0]), (7, [3.0, 4.0])]])
def test_few(frame, rows):
    assert run(frame(rows, SCHEMA)) == brute(rows, 5, lambda i: i % 5 == 0)


def test_large_components(frame):
    rows = [(i, [float(1000 * i), 1e6 - i]) for i in range(30)]
    assert run(frame(rows, SCHEMA)) == brute(rows, 5, lambda i: i % 5 == 0)


def test_any_finite_component(frame):
    """Scores that no double holds are exact; scores beyond 64 bits count as the last number of 64 bits."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 8 if i < 60 else 36)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(200 + i, [3e38, -3e38, 1.0]) for i in range(8)] + [(300 + i, [1e7, 2e7, 3e7]) for i in range(8)]
    vectors = [(i, [math.floor(256 * c) for c in x]) for i, x in rows]
    want = []
    for a, (i, q) in enumerate(vectors):
        if i % 5 == 0:
            found = [(-min(max(sum(map(operator.mul, q, c)), -(1 << 63)), (1 << 63) - 1), j) for b, (j, c) in enumerate(vectors) if a != b]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:5], 1)]
    assert run(frame(rows, SCHEMA)) == sorted(want, key=str)


def test_lists_know_nothing_of_each_other(frame):
    """Every unit of the first two phases holds the components of one list."""
    rows = [(i, [float(10 * j + i) for j in range(6)]) for i in range(20)]
    vectors = topk.integer_vectors(frame(rows, SCHEMA), "vec_id", "embedding")
    blocks = topk._candidate_blocks(vectors, 3).collect()
    assert {b["list"] for b in blocks} == {0, 1, 2}
    assert all(len(b.c_matrix) == len(b.c_rows) // 8 * 2 * 4 for b in blocks)
