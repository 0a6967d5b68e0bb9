import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsift.functions import blocks

MASKS = st.tuples(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1)).map(lambda t: np.random.default_rng(t[2]).random(t[:2]) < 0.5)


@given(MASKS)
@settings(max_examples=60, deadline=None)
def test_rle_round_trip(m):
    r = blocks.rle_encode(m)
    assert (blocks.rle_decode(m.shape, r) == m).all() and sum(r) == m.size and (r[0] == 0) == bool(m.ravel()[0])


def test_rle_edges():
    assert blocks.rle_encode(np.zeros((0, 3))) == [] and blocks.rle_encode(np.ones((2, 2), bool)) == [0, 4]
    assert blocks.rle_encode(np.array([[0, 1, 1], [0, 0, 0]])) == [1, 2, 3]


@given(MASKS, st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_opening(m, k):
    o = blocks.open_mask(m, k)
    brute = np.zeros_like(m)
    for y in range(m.shape[0] - k + 1):
        for x in range(m.shape[1] - k + 1):
            if m[y : y + k, x : x + k].all():
                brute[y : y + k, x : x + k] = True
    inside = np.pad(m, k, constant_values=True)
    assert (o | ~m | True).all() and not (o & ~m).any() and (blocks.open_mask(o, k) == o).all()
    assert (o >= brute).all() and inside.shape[0] == m.shape[0] + 2 * k


def test_closing_fills_holes():
    m = np.ones((5, 5), bool)
    m[2, 2] = False
    assert blocks.close_mask(m, 1).all()
    lone = np.zeros((5, 5), bool)
    lone[2, 2] = True
    assert blocks.close_mask(lone, 1).sum() == 1


def test_box_smooth_is_the_mean_of_neighbours():
    g = np.random.default_rng(1).normal(size=(5, 7, 3))
    s = blocks.box_smooth(g)
    for y in range(5):
        for x in range(7):
            assert np.allclose(s[y, x], g[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].mean((0, 1)))
    assert np.allclose(blocks.box_smooth(np.ones((1, 1, 2))), 1)


def test_components_and_dbscan():
    cells = np.array([[0, 0], [1, 1], [1, 3], [4, 4], [4, 5]])
    assert blocks.link_cells(cells, 1.5).tolist() == [0, 0, 1, 2, 2] and blocks.link_cells(cells, 1.0).tolist() == [0, 1, 2, 3, 3]
    label = blocks.dbscan_cells(np.array([[0, 0], [0, 1], [1, 0], [5, 5]]), 1.5, 3)
    assert label.tolist() == [0, 0, 0, -1] and len(blocks.dbscan_cells(np.zeros((0, 2), int), 1, 1)) == 0


@pytest.mark.parametrize("method", ["single", "average", "complete"])
def test_linkage_against_a_naive_loop(method):
    x = np.random.default_rng(3).random((14, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = [[i] for i in range(14)]
    f = {"single": np.min, "average": np.mean, "complete": np.max}[method]
    while len(groups) > 4:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: f(d[np.ix_(groups[p[0]], groups[p[1]])]))
        groups[j] = groups[j] + groups.pop(i)
    label = blocks.linkage_labels(d, method, k=4)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == c).tolist()) for c in range(4)}


def test_k_centre_and_top_k():
    x = blocks.unit_rows(np.random.default_rng(4).normal(size=(30, 5)))
    c = blocks.k_centre(x, 6)
    assert len(set(c.tolist())) == 6 and (blocks.k_centre(x, 99) == np.arange(30)).all()
    s = np.array([[1.0, 3, 3, 2], [0, 0, 0, 0]])
    at, v = blocks.top_k(s, 3, np.array([9, 8, 7, 6]))
    assert at.tolist() == [[2, 1, 3], [3, 2, 1]] and v[0].tolist() == [3, 3, 2] and blocks.top_k(s, 9, np.arange(4))[0].shape == (2, 4)


def test_greedy_steps():
    iou = {(1, 2): 0.6, (2, 3): 0.5}
    assert blocks.greedy_keep(iou, [1, 2, 3], 0.5, True) == [1, 3] and blocks.greedy_keep(iou, [2, 3, 1], 0.5, False) == [2, 3]
    assert blocks.greedy_match([1, 2], [10, 11], {(1, 10): 0.5, (1, 11): 0.5, (2, 10): 0.9}, 0.5) == [(1, 10, 0.5)]
    assert blocks.greedy_match([], [1], {}, 0.5) == []


def test_resizing():
    g = np.arange(12.0).reshape(3, 4)
    assert np.allclose(blocks.resize_bilinear(g, 3, 4), g) and blocks.resize_bilinear(g, 6, 8).min() == 0
    assert (blocks.resize_nearest(g > 5, 6, 8) == np.repeat(np.repeat(g > 5, 2, 0), 2, 1)).all()
    assert blocks.mask_share(np.ones((4, 4), bool), 2, 2).tolist() == [[1, 1], [1, 1]]


def test_principal_directions():
    x = np.random.default_rng(5).normal(size=(200, 4)) * [5, 2, 1, 0.1]
    mean, v, var = blocks.principal(x, 2)
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(var, value[::-1][:2]) and np.allclose(np.abs(v @ vector[:, ::-1][:, :2]), np.eye(2), atol=1e-8) and (v[np.arange(2), np.abs(v).argmax(1)] > 0).all()


@pytest.mark.parametrize("k,rows", [(1, 4), (3, 7), (5, 1000), (60, 5)])
def test_nearest_rows_in_blocks_are_those_of_one_matrix(monkeypatch, k, rows):
    rng = np.random.default_rng(k)
    y = np.concatenate((rng.normal(size=(30, 5)), np.ones((20, 5))))[rng.permutation(50)]
    x, ids = np.concatenate((rng.normal(size=(9, 5)), np.ones((2, 5)))), np.sort(rng.permutation(500)[:50])
    at, want = blocks.top_k(np.round(x @ y.T, 12), k, ids)
    monkeypatch.setattr(blocks, "BANK_ROWS", rows)
    found, value = blocks.nearest_rows(x, y, ids, k)
    assert (found == ids[at]).all() and (value == want).all()


def test_nearest_rows_hold_no_row_of_a_whole_bank():
    import tracemalloc

    x, y = np.ones((512, 2)), np.random.default_rng(0).normal(size=(60_000, 2))
    tracemalloc.start()
    blocks.nearest_rows(x, y, np.arange(len(y)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20  # all products alone are 245 MB
