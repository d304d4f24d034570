"""The search inside a block: few candidates by one matrix product, results as of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from rarefy.operators import neighbours


def _block(kind, n=512, d=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    if kind == "mixed":
        x[:, 4:] = x[:, 4:] > 0.5
    elif kind == "ties":
        x = np.round(x)
    elif kind == "copies":
        x = np.repeat(x[:n // 32], 32, axis=0)
    elif kind == "far":  # the matrix product loses the small gaps
        x = 1e7 + x * 1e-3
    ids = [None if i % 9 == 0 else int(v) for i, v in enumerate(rng.integers(0, n, n))]
    return x, ids


def _all_pairs(x, ids, k):
    order = sorted(range(len(x)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    x, out = x[order], {}
    for a in range(len(x)):
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            gap = x[a, j] - x[:, j]
            d += gap * gap
        d[a] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        out[order[a]] = [(float(d[b]), ids[order[b]], order[b]) for b in near]
    return out


@pytest.mark.parametrize("kind", ["normal", "mixed", "ties", "copies", "far"])
@pytest.mark.parametrize("n", [1, 2, 5, 17, 512])
def test_block_search_equals_all_pairs(kind, n):
    x, ids = _block(kind)
    x, ids = x[:n], ids[:n]
    table = pa.table({"_row": pa.array(range(n), pa.int64()), "id": pa.array(ids, pa.int64()),
                      "y": pa.array([1] * n, pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    for k in (1, 3, 5):
        found = {r["_row"]: [(p["d"], p["id"], p["row"]) for p in r["near"]]
                 for r in neighbours._search(table, k).to_pylist()}
        assert found == _all_pairs(x, ids, k)


def test_few_pairs_are_measured():
    x, _ = _block("normal")
    row, to = neighbours._candidates(x, 0, 512, 3)
    assert (row != to).all() and (np.bincount(row, minlength=512) >= 3).all() and len(row) < 512 * 24


def test_distances_beyond_doubles_measure_all_pairs():
    x, _ = _block("normal", 40)
    row, to = neighbours._candidates(x * 1e200, 0, 40, 3)
    assert len(row) == 40 * 39 and (row != to).all()


@pytest.mark.parametrize("skip", [1, -1, 0])
def test_skipped_class_is_a_neighbour_and_not_searched(skip):
    x, ids = _block("mixed", 130)
    y = [None if i % 11 == 0 else 1 if i % 5 == 0 else -1 for i in range(130)]
    table = pa.table({"_row": pa.array(range(130), pa.int64()), "id": pa.array(ids, pa.int64()),
                      "y": pa.array(y, pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    whole = {r["_row"]: r["near"] for r in neighbours._search(table, 4).to_pylist()}
    found = {r["_row"]: r["near"] for r in neighbours._search(table, 4, skip).to_pylist()}
    assert found == {i: near for i, near in whole.items() if y[i] != skip}


def test_a_block_of_one_skipped_class_gives_no_row():
    x, ids = _block("normal", 9)
    table = pa.table({"_row": pa.array(range(9), pa.int64()), "id": pa.array(ids, pa.int64()),
                      "y": pa.array([1] * 9, pa.int32()), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    assert neighbours._search(table, 3, 1).num_rows == 0
