"""Partners and common areas summed without going through the pairs, against the pairs."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.functions import block_pairs as bp, stairs
from canopy.functions.stairs import partners
from canopy.operators import block_join as BJ
from canopy.operators.spatial_join import pair_count, spatial_join
from shapes import layer, poly, rect
from test_block_join import _rows, sides  # noqa: F401


def _ring(x, y, w, h, kind):
    if kind == 0:
        return [(x, y), (x + w, y), (x + w, y + h // 2), (x + w // 2, y + h // 2), (x + w // 2, y + h), (x, y + h)], w * h * 3 / 4
    if kind == 1 and min(w, h) >= 4:
        return [(x, y), (x + w, y), (x + w, y + 1), (x + w - 1, y + 1), (x + w - 1, y + 2), (x + 1, y + 2), (x + 1, y + h), (x, y + h)], w + (w - 1) + (h - 2)
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)], w * h


def _shapes(rings):
    out = []
    for pts, area in rings:
        xs, ys = zip(*pts)
        edges = [dict(ax=float(a[0]), ay=float(a[1]), bx=float(b[0]), by=float(b[1])) for a, b in zip(pts, pts[1:] + pts[:1])]
        out.append(dict(x0=float(min(xs)), y0=float(min(ys)), x1=float(max(xs)), y1=float(max(ys)), area=float(area), own=True, edges=edges))
    return bp.Shapes(pa.Table.from_pylist(out))


def _stairs(rng, n, size):
    """Stairs of one to three steps whose rings begin anywhere."""
    rings = []
    for _ in range(n):
        pts, area = _ring(rng.randint(-20, 20), rng.randint(-20, 20), 2 * rng.randint(1, size), 2 * rng.randint(1, size), rng.randint(0, 2))
        r = rng.randint(0, len(pts) - 1)
        rings.append((pts[r:] + pts[:r], area))
    return _shapes(rings)


@pytest.mark.parametrize("seed", range(8))
def test_partners_over_the_cells_are_the_pairs(seed):
    rng = random.Random(seed)
    a, b, size = _stairs(rng, 60, 8), _stairs(rng, 40, 12), 8.0
    assert a.stairs.ok.all() and b.stairs.ok.all()
    group, count, area = np.arange(60) % 3, np.zeros((3, 40), int), np.zeros((3, 40))
    for x in np.arange(-5, 8) * size:
        for y in np.arange(-5, 8) * size:
            l, r = (np.flatnonzero((s.x0 < x + size) & (s.x1 >= x) & (s.y0 < y + size) & (s.y1 >= y)) for s in (a, b))
            if len(l) and len(r):
                n, shared = partners(a, b, l, r, group[l], 3, x, y)
                count[:, r] += n
                area[:, r] += shared
    i, j, shared, _ = bp.hits(a, b, np.repeat(np.arange(60), 40), np.tile(np.arange(40), 60), "intersects")
    want, total = np.zeros((3, 40), int), np.zeros((3, 40))
    np.add.at(want, (group[i], j), 1)
    np.add.at(total, (group[i], j), shared)
    assert (count == want).all() and (area == total).all()


@pytest.mark.parametrize("blocks", [1, 3, 1024])
@pytest.mark.parametrize("sides", [("left", "left"), ("right", "left"), ("left", "right"), ("right", "right")])
def test_sums_over_what_comes_before(monkeypatch, blocks, sides):
    """Many sources and targets at the same places, and targets before and after all sources."""
    monkeypatch.setattr(stairs, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(stairs, "STEP_WORTH", 1)
    monkeypatch.setattr(stairs, "AT_ONCE", 64)
    rng = np.random.default_rng(4)
    (x, y), (tx, ty), w = rng.integers(0, 12, (2, 300)).astype(float), rng.integers(-2, 15, (2, 200)).astype(float), rng.integers(-9, 9, (300, 3)).astype(float)
    before = [np.less if s == "left" else np.less_equal for s in sides]
    want = (before[0](x, tx[:, None]) & before[1](y, ty[:, None])) @ w
    assert (stairs._Before(x, y, w, 200).sums(tx, ty, *sides) == want).all()
    assert stairs._Before(x[:1], y[:1], w[:1], 200).sums(tx, ty).shape == (200, 3)


def test_groups_are_summed_in_one_pass(monkeypatch):
    """Seven years took seven times the steps of one; with less room they come in portions."""
    a, b, built = _stairs(random.Random(3), 300, 8), _stairs(random.Random(4), 200, 12), []

    class Counted(stairs._Before):
        def __init__(self, *args):
            built.append(1)
            super().__init__(*args)
    monkeypatch.setattr(stairs, "_Before", Counted)
    run = lambda group: partners(a, b, np.arange(300), np.arange(200), group, int(group.max()) + 1, 0.0, 0.0)
    n, area = run(np.zeros(300, int))
    one = len(built)
    some = run(np.arange(300) % 7)
    assert len(built) == 2 * one and (some[0].sum(axis=0) == n).all() and (some[1].sum(axis=0) == area).all()
    monkeypatch.setattr(stairs, "MOST_WEIGHTS", 1)
    few = run(np.arange(300) % 7)
    assert (few[0] == some[0]).all() and (few[1] == some[1]).all()


def test_totals_take_larger_cells_and_blocks(spark, monkeypatch):
    """Shapes of several classes met a row a level and cell each; totals need few, and give the same."""
    left = layer(spark, [(i, poly(rect(7 * i % 50, 11 * i % 50, 3, 3))) for i in range(60)])
    right = layer(spark, [(i, poly(rect(13 * i % 50, 5 * i % 50, 4 + i % 9, 4 + i % 9))) for i in range(60)], "rid")
    held, units = [], BJ._units
    monkeypatch.setattr(BJ, "_units", lambda *args: held.append(units(*args)) or held[-1])
    run = lambda **by: spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks", **by)
    pairs, totals = run(), run(totals_by=["id", "rid"])
    assert _rows(totals.groupBy("id", "rid").agg(F.sum("inter_area"))) == _rows(pairs)
    assert 2 * held[1].count() < held[0].count()
    assert held[1].select("lvl").distinct().count() == 1 < held[0].select("lvl").distinct().count()
    crowd = held[1].groupBy("lvl", "cx", "cy", "is_left").count().where("is_left").agg(F.max("count")).first()[0]
    monkeypatch.setattr(BJ, "BLOCK_ROWS", 1)
    run(totals_by=["id", "rid"])
    assert 1 < held[2].agg(F.max("lb")).first()[0] + 1 <= -(-crowd // BJ.WIDER)


@pytest.mark.parametrize("ask", [{}, {"least": 5.0}, {"distance": 3.0}])
def test_pairs_by_boxes_are_the_pairs(ask):
    rng, far = random.Random(9), ask.get("distance", 0.0)
    a, b, size = _stairs(rng, 80, 8), _stairs(rng, 70, 12), 8.0
    a.x0, a.y0, a.x1, a.y1 = a.x0 - far, a.y0 - far, a.x1 + far, a.y1 + far
    cells = [(x, y, *(np.flatnonzero((s.x0 < x + size) & (s.x1 >= x) & (s.y0 < y + size) & (s.y1 >= y)) for s in (a, b)))
             for x in np.arange(-5, 8) * size for y in np.arange(-5, 8) * size]
    got = [p for x, y, l, r in cells if len(l) and len(r) for p in stairs.pairs(a, b, l, r, x, y, **ask)]
    if far:
        want = bp.near(a, b, np.repeat(np.arange(80), 70), np.tile(np.arange(70), 80), far)
    else:
        want = bp.hits(a, b, np.repeat(np.arange(80), 70), np.tile(np.arange(70), 80), "intersects", ask.get("least"))
    assert sorted(zip(*(np.concatenate(v).tolist() for v in zip(*got)))) == sorted(zip(*(v.tolist() for v in want[:3])))


def test_many_pairs_of_stairs_are_not_overlaid_edge_by_edge(monkeypatch):
    a, b = _stairs(random.Random(1), 400, 30), _stairs(random.Random(2), 400, 30)
    monkeypatch.setattr(bp, "areas", None)
    one = lambda v: np.array([v])
    assert sum(len(p[0]) for p in bp.found(a, b, (one(0), one(400), one(0), one(400), one(-1e3), one(-1e3)), "intersects")) > 50_000


def test_what_is_no_stair():
    x = [([(0, 0), (4, 0), (4, 4), (0, 4)], 16), ([(0, 0), (4, 0), (2, 4)], 8), ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2)], 12),
         ([(0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4)], 20), ([(0, 0), (0, 4), (4, 4), (4, 0)], 16)]
    assert _shapes(x).stairs.ok.tolist() == [True, False, False, False, False]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("by", [["k"], ["id"], ["k", "rid"], ["id", "k", "rid"]])
def test_totals_of_crowded_units(spark, sides, monkeypatch, how, by):  # noqa: F811
    """Every unit taken for crowded; shapes that are no stairs stay with the pairs."""
    left, right = sides
    pairs = spatial_join(left, right, left_id="id", right_id="rid", how=how, left_cols=[], right_cols=["k"])
    want = pairs.groupBy(*by).agg(F.count("*"), F.sum("inter_area"))
    monkeypatch.setattr(BJ, "CROWDED", 1)
    t = spatial_join(left, right, left_id="id", right_id="rid", how=how, left_cols=[], right_cols=["k"], kernel="blocks", totals_by=by)
    assert _rows(t.groupBy(*by).agg(pair_count(), F.sum("inter_area"))) == _rows(want)


def test_a_crowd_is_summed_without_its_pairs(spark):
    """1.6 billion pairs in one place; gone through one by one they take many minutes."""
    left = layer(spark, [(0, poly(rect(0, 0, 8, 8))), (1, poly(rect(4, 4, 8, 8)))])
    left = left.crossJoin(spark.range(20_000).select(F.col("id").alias("copy")))
    right = layer(spark, [(0, poly(rect(2, 2, 8, 8))), (1, poly(rect(8, 0, 4, 4)))], "rid").crossJoin(spark.range(20_000).select(F.col("id").alias("copy2")))
    t = spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks", totals_by=["id", "rid"])
    n = 20_000 ** 2
    assert _rows(t.groupBy("id", "rid").agg(pair_count(), F.sum("inter_area"))) == \
        [(0, 0, n, 36.0 * n), (0, 1, n, 0.0), (1, 0, n, 36.0 * n), (1, 1, n, 0.0)]


def test_no_areas_where_none_are_asked_for(monkeypatch):
    """A left join without areas took them all, for its pairs and again for the rows that have one."""
    a, b = _stairs(random.Random(11), 300, 12), _stairs(random.Random(12), 200, 8)
    l, r, group = np.arange(300), np.arange(200), np.arange(300) % 3
    met = lambda **ask: sorted((i, j) for p in stairs.pairs(a, b, l, r, 2.0, -3.0, **ask) for i, j in zip(p[0].tolist(), p[1].tolist()))
    want, n = met(), partners(a, b, l, r, group, 3, 2.0, -3.0)[0]
    assert len(want) == n.sum() > 1000
    monkeypatch.setattr(stairs, "_add_shared", None)
    assert (partners(a, b, l, r, group, 3, 2.0, -3.0, with_area=False)[0] == n).all()
    assert met(with_area=False) == want and all(np.isnan(p[2]).all() for p in stairs.pairs(a, b, l, r, 2.0, -3.0, with_area=False))


@pytest.mark.parametrize("swap", [False, True])
def test_tiles_of_neighbours_on_either_side(monkeypatch, swap):
    """Many tiles and portions, of the left or of the right: the same pairs, with a left row's pairs in runs."""
    a, b = _stairs(random.Random(13), 300, 3), _stairs(random.Random(14), 200, 14)
    a, b = (b, a) if swap else (a, b)
    l, r = np.arange(len(a.n)), np.arange(len(b.n))
    got = lambda: sorted(zip(*(np.concatenate(v).tolist() for v in zip(*stairs.pairs(a, b, l, r, 0.0, 0.0)))))
    want = got()
    monkeypatch.setattr(stairs, "TILE", 7)
    monkeypatch.setattr(stairs, "TILE_PAIRS", 7 * 5)
    assert got() == want and len(set(p[:2] for p in want)) == len(want) > 1000
