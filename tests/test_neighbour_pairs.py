"""Pairs of neighbouring cells equal brute force, in one direction or both."""

from __future__ import annotations

import numpy as np
import pytest

from wardlight.operators.cells import AXES, CELL, REACH, Grid, near_by_chord, neighbour_pairs


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_pairs_of_neighbouring_cells(spark, keys):
    rng = np.random.default_rng(2)
    rows = [
        (i, float(10 + rng.normal(0, 0.004)), float(20 + rng.normal(0, 0.004)), "ab"[i % 2]) for i in range(300)
    ]
    grid = Grid(100.0, near_by_chord(100.0), keys)
    points = grid.place(spark.createDataFrame(rows, "ord long, lat double, lng double, k string"))
    cells = grid.summarise(points)
    held = [r.asDict() for r in cells.collect()]
    limit = grid.chord + 1e-14

    def close(a, b):
        gaps = [max(0.0, a[f"lo_{x}"] - b[f"hi_{x}"], b[f"lo_{x}"] - a[f"hi_{x}"]) for x in AXES]
        return all(abs(a[c] - b[c]) <= REACH for c in CELL) and sum(g * g for g in gaps) <= limit**2

    def of(pairs):
        return sorted((r.a_node, r.b_node) for r in pairs.select("a_node", "b_node").collect())

    both = [
        (a, b) for a in held for b in held
        if a is not b and all(a[k] == b[k] for k in keys) and close(a, b)
    ]
    assert len(both) > 100
    assert of(neighbour_pairs(grid, cells, cells)) == sorted((a["node"], b["node"]) for a, b in both)
    first = [(a["node"], b["node"]) for a, b in both if [a[c] for c in CELL] < [b[c] for c in CELL]]
    assert of(neighbour_pairs(grid, cells, cells, once=True)) == sorted(first) and 2 * len(first) == len(both)
