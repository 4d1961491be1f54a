"""Components of cells within tiles, against the same on cells."""

import random

import pytest
from test_masks import drawn, frame, grouped

from quirefold.operators import graph, joins, masks


def test_cells_with_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(masks, "TILE", 4)
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), rnd.randrange(-12, 30), rnd.randrange(-12, 30)) for _ in range(900)]
    odd = [(1, None, 3), (None, 2, 2), (None, 2, 2)]
    got = [tuple(r) for r in joins.cell_components(frame(spark, rows + odd), "page").collect()]
    assert len(got) == len(set(rows)) + 2 and {r for r in got if None in r[:3]} == {(1, None, 3, None), (None, 2, 2, None)}
    for p in range(3):
        groups = grouped({(y, x) for q, y, x in rows if q == p})
        least = {}
        for c, g in groups.items():
            least[g] = min(least.get(g, c), c)
        for q, y, x, c in got:
            if q == p and y is not None:
                a, b = least[groups[y, x]]
                assert c == p * (1 << 40) + a * (1 << 20) + b


def test_pages_of_one_tile_leave_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "materialise", lambda df, label: pytest.fail(label))
    rows = drawn(51, pages=5)
    assert joins.cell_components(frame(spark, rows), "page").count() == len(set(rows))
