"""Clusters within tiles, against the same on cells, and what they leave to the components."""

import math
import random

import pytest
from test_masks import drawn, frame, grouped

from quirefold.operators import graph, masks


@pytest.mark.parametrize("gap", [0, 1, 6])
def test_clusters_over_many_tiles(spark, monkeypatch, gap):
    monkeypatch.setattr(masks, "TILE", 16)
    monkeypatch.setattr(masks, "CHUNK", 40)
    rnd = random.Random(gap)
    rows = drawn(gap + 30) + [(1, 40, x) for x in range(3, 85)] + [(2, y, 31) for y in range(10, 60)]
    rows = list({(p, y - 35, x - 40) for p, y, x in rows + [(0, rnd.randrange(70), rnd.randrange(90)) for _ in range(60)]})
    got = masks.clusters(masks.runs(frame(spark, rows), "page"), "page", gap).collect()
    found = {(r["page"], r["y"], x): r["component"] for r in got for x in range(r["x1"], r["x2"] + 1)}
    assert found.keys() == set(rows)
    wide = {dy: round(math.sqrt(gap * gap - dy * dy)) for dy in range(-gap, gap + 1)}
    for p in {r[0] for r in rows}:
        own = {(y, x) for q, y, x in rows if q == p}
        groups = grouped({(y + dy, x + dx) for y, x in own for dy, w in wide.items() for dx in range(-w, w + 1)})
        least = {}
        for c in own:
            least[groups[c]] = min(least.get(groups[c], c), c)
        for y, x in own:
            a, b = least[groups[y, x]]
            assert found[p, y, x] == p * (1 << 40) + a * (1 << 20) + b


def test_pages_of_one_tile_leave_nothing_to_the_components(spark, monkeypatch):
    written = []
    plain = masks.materialise

    def counted(df, label):
        out = plain(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(masks, "materialise", counted)
    monkeypatch.setattr(graph, "materialise", lambda df, label: pytest.fail(label))
    rows = frame(spark, drawn(51, pages=5))
    n = masks.runs(rows, "page").count()
    assert masks.clusters(masks.runs(rows, "page"), "page", 12).count() > 0 and sum(written) <= 2 * n
