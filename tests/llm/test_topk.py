import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import topk
from seriesloom.llm.topk import SortedLists, top_k


def brute(ids, m, query_id, query, k):
    scores = m @ query
    rows = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != query_id)
    return [(-s, i) for s, i in rows[:k]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 6), st.integers(1, 12), st.sampled_from([3, 50, 10**9]))
def test_lists_match_brute_force(seed, n, dims, k, size):
    rng = np.random.default_rng(seed)
    m = rng.integers(-size, size + 1, (n, dims))
    ids = rng.permutation(n)
    lists = SortedLists(ids, m)
    for q in range(0, n, max(1, n // 3)):
        assert lists.top(int(ids[q]), m[q], k) == brute(ids, m, ids[q], m[q], k)


def clustered(rng, n, dims=64, centres=20):
    """Unit vectors near ``centres`` centres (row i near centre i modulo ``centres``), scaled to integers."""
    c = rng.normal(size=(centres, dims))
    m = c[np.arange(n) % centres] + 0.3 * rng.normal(size=(n, dims))
    return np.floor(1024 * m / np.linalg.norm(m, axis=1)[:, None]).astype(np.int64)


def test_stops_early_on_skewed_data():
    rng = np.random.default_rng(1)
    m = rng.integers(-10, 11, (4000, 2))
    m[:20] += 500
    lists = SortedLists(np.arange(4000), m)
    assert lists.top(-1, np.array([1, 1]), 5) == brute(np.arange(4000), m, -1, np.array([1, 1]), 5)
    assert lists.met < 100


def test_a_floor_stops_at_the_heads_and_keeps_ties():
    m = np.array([[5, 0], [3, 3], [6, 0], [0, 6]])
    lists = SortedLists(np.array([4, 3, 2, 1]), m)
    assert lists.top(-1, np.array([1, 1]), 2, floor=6) == [(6, 1), (6, 2)]
    assert lists.top(-1, np.array([1, 1]), 2, floor=13) == [] and lists.met == 0


def test_blocks_of_other_cells_are_left_at_their_heads():
    """64 dimensions with clusters: with the floor of the own cluster few vectors of others are met."""
    m = clustered(np.random.default_rng(7), 6000)
    ids = np.arange(len(m))
    own = SortedLists(ids[::20], m[::20]).top(0, m[0], 10)
    assert own == brute(ids, m, 0, m[0], 10)
    met = 0
    for cell in range(1, 20):
        away = SortedLists(ids[cell::20], m[cell::20])
        assert away.top(0, m[0], 10, own[-1][0]) == []
        met += away.met
    assert met == 0


@pytest.mark.parametrize("size", [2**20, 2**31, 2**40])
def test_scores_beyond_floats_are_exact(size):
    rng = np.random.default_rng(3)
    m = rng.integers(-size, size + 1, (40, 5))
    lists = SortedLists(np.arange(40), m)
    want = sorted((-sum(int(a) * int(b) for a, b in zip(m[i], m[0], strict=True)), i) for i in range(1, 40))[:4]
    assert lists.top(0, m[0], 4) == [(-s, i) for s, i in want]


@pytest.mark.parametrize("block, batch", [(4096, 4096), (7, 4096), (16, 2)])
def test_query_over_a_table(spark, monkeypatch, block, batch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "BATCH_ROWS", batch)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(60)]
    rows += [(70, [], 0), (80, [], 0), (60, None, 0), (61, [1.0, None, 2.0, 0.0], 0), (62, [math.nan, 0.0, 0.0, 0.0], 0), (63, [math.inf, 0.0, 0.0, 0.0], 0), (64, [], 0), (65, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (5, rows[5][1], 0), (59, rows[58][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), 10).collect())
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and len(v) == 4 and None not in v and all(map(math.isfinite, v))]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    want = []
    for i, v in good:
        if i % 20 == 0:
            want += [(i, r + 1, j, s) for r, (s, j) in enumerate(brute(ids, m, i, v, 10))]
    want += [(80, 1, 64, 0), (80, 2, 70, 0)]
    assert got == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, none).count() == 0


def test_clusters_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    m = clustered(np.random.default_rng(5), 900, 8, 6)
    m[100:400] = m[100]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 100 = 0"), 10).collect())
    ids = np.arange(len(m))
    assert got == sorted((q, r + 1, j, s) for q in range(0, 900, 100) for r, (s, j) in enumerate(brute(ids, m, q, m[q], 10)))


def test_a_component_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        top_k(df, df).collect()
