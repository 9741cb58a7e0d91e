"""X02's outline: unions of boxes against a painted grid, slanted shapes against their areas, and the stitching by itself."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import validity as V
from canopy.functions.geometry import with_shape
from canopy.operators import outline as O
from canopy.operators.dissolve import coded_shapes, dissolve_area


def layer(spark, rows):
    """Rows (key, [rings as point lists; the first is the shell])."""
    data = [(k, [(0, n > 0, [(float(x), float(y)) for x, y in [*r, r[0]]]) for n, r in enumerate(rings)]) for k, rings in rows]
    df = spark.createDataFrame(data, "k string, rings array<struct<part: int, hole: boolean, pts: array<struct<x: double, y: double>>>>")
    return with_shape(df.repartition(3), "rings")


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def painted(boxes):
    """(area, perimeter, corners, shells - holes) of a union of boxes: corners with the area's wedges at a point counted apart."""
    xs, ys = (sorted({b[k] for b in boxes} | {b[k + 2] for b in boxes}) for k in (0, 1))
    full = np.zeros((len(xs) + 1, len(ys) + 1), bool)  # a free cell all round
    for x0, y0, x1, y1 in boxes:
        full[xs.index(x0) + 1:xs.index(x1) + 1, ys.index(y0) + 1:ys.index(y1) + 1] = True
    w, h = np.diff(xs), np.diff(ys)
    area = float((full[1:-1, 1:-1] * w[:, None] * h[None]).sum())
    perimeter = float(((full[1:, 1:-1] != full[:-1, 1:-1]) * h[None]).sum() + ((full[1:-1, 1:] != full[1:-1, :-1]) * w[:, None]).sum())
    four = [full[:-1, :-1], full[1:, :-1], full[:-1, 1:], full[1:, 1:]]
    count = sum(f.astype(int) for f in four)
    cross = (count == 2) & (four[0] == four[3])
    convex, concave = int((count == 1).sum() + 2 * cross.sum()), int((count == 3).sum())
    return area, perimeter, convex + concave, (convex - concave) // 4


def measured(found):
    """(area, perimeter, corners, shells - holes, all valid) of polygon rows (rings)."""
    rows = found.withColumn("ok", V.is_valid("rings")).select("area", "rings", "ok").collect()
    length = sum(math.dist((p.x, p.y), (q.x, q.y)) for r in rows for ring in r.rings for p, q in zip(ring.pts, ring.pts[1:]))
    return (sum(r.area for r in rows), length, sum(len(ring.pts) - 1 for r in rows for ring in r.rings),
            sum(1 - 2 * ring.hole for r in rows for ring in r.rings), all(r.ok for r in rows))


@pytest.mark.parametrize("cells", [{"cell_size": 64.0, "max_cell_edges": 10_000}, {"cell_size": 8.0, "max_cell_edges": 4, "split": 2}])
def test_union_of_boxes(spark, cells):
    want = {}
    for seed, n in ((1, 3), (2, 25), (3, 60), (4, 120)):
        rng = random.Random(seed)
        want[str(n)] = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n))]
    found = O.dissolve_outline(layer(spark, [(k, box(*b)) for k, boxes in want.items() for b in boxes]), "k", **cells).persist()
    for k, boxes in want.items():
        assert measured(found.where(F.col("k") == k)) == (*painted(boxes), True)


def test_hand_cases(spark):
    """A ring of boxes round a hole with an island, corners that touch, a large box among small ones, a NULL key, an empty shape."""
    frame = [(0, 0, 10, 2), (0, 8, 10, 10), (0, 0, 2, 10), (8, 0, 10, 10), (4, 4, 6, 6)]
    corner = [(20, 0, 22, 2), (22, 2, 24, 4), (24, 0, 26, 2), (22, -2, 24, 0)]
    wide = [(100, 100, 1124, 1124)] + [(200 + 8 * i, 96, 204 + 8 * i, 110) for i in range(60)]
    rows = [(k, box(*b)) for k, bs in (("frame", frame), ("corner", corner), (None, wide)) for b in bs] + [("empty", [])]
    found = O.dissolve_outline(layer(spark, rows), "k", cell_size=16.0, max_cell_edges=20).persist()
    for k, bs in (("frame", frame), ("corner", corner), (None, wide)):
        assert measured(found.where(F.col("k").eqNullSafe(F.lit(k)))) == (*painted(bs), True)
    assert found.where("k = 'frame'").count() == 2 and found.where("k = 'corner'").count() == 4
    assert found.where("k = 'empty'").isEmpty()


def star(rng, cx, cy, size, n=9):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + math.cos(t) * (d := rng.uniform(0.4, 1) * size), cy + math.sin(t) * d) for t in turns]


def test_union_of_slanted_shapes(spark):
    """Cut into cells or not, the area is that of the dissolve, and the polygons are valid; far from the origin too."""
    rows = []
    for seed, shift in ((1, 0.0), (2, 0.0), (3, 9_000_000.0)):
        rng = random.Random(seed)
        rows += [(str(shift + seed), [star(rng, shift + rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(4, 20))]) for _ in range(40)]
    df = layer(spark, rows).persist()
    want = {r.k: r.union_area for r in dissolve_area(df, "k", cell_size=256.0).collect()}
    for cells in ({"cell_size": 256.0, "max_cell_edges": 100_000}, {"cell_size": 32.0, "max_cell_edges": 5}):
        found = O.dissolve_outline(df, "k", **cells).persist()
        for k, total in want.items():
            area, _, _, _, valid = measured(found.where(F.col("k") == k))
            assert valid and area == pytest.approx(total, rel=1e-7 if len(k) > 5 else 1e-9)


def odd_area(rings, step):
    """Even-odd area by counting points of a fine grid."""
    pts = [p for r in rings for p in r]
    xs, ys = (np.arange(min(p[c] for p in pts) + step / 2, max(p[c] for p in pts), step) for c in (0, 1))
    odd = np.zeros((len(xs), len(ys)), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            if ay != by:
                right = ax + (ys - ay) * (bx - ax) / (by - ay)
                odd ^= ((ay > ys) != (by > ys))[None] & (xs[:, None] < right[None])
    return odd.sum() * step * step


def test_even_odd_outline(spark):
    """Walks that cross themselves: the area an odd number of rings wind round, as the repair of one row gives it."""
    walks = {}
    for seed in range(3):
        rng = random.Random(seed)
        walks[str(seed)] = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(14)]
    df = layer(spark, [(k, [ring]) for k, ring in walks.items()])
    for cells in ({"cell_size": 64.0}, {"cell_size": 16.0, "max_cell_edges": 2}):
        found = O.outlined(coded_shapes(df, "k"), odd=True, **cells).persist()
        for k, ring in walks.items():
            fixed = V.repair([(0, False, *map(np.array, zip(*[*ring, ring[0]])))])
            area = sum(abs(V._ring_area2(xs, ys)) / 2 * (-1 if hole else 1) for _, hole, xs, ys in fixed)
            assert area == pytest.approx(odd_area([ring], 0.1), rel=0.02)
            got = measured(found.where(F.col("k") == "v" + k))
            assert got[4] and got[0] == pytest.approx(area, rel=1e-9)


def test_ranked_cycles(spark):
    """Cycles of every length: the smallest member, and the steps to it."""
    rng = random.Random(5)
    names = rng.sample(range(10_000), 400)
    rows, want, at = [], {}, 0
    for size in (1, 2, 3, 5, 64, 100, 225):
        own = names[at:at + size]
        at += size
        low = own.index(min(own))
        for i, c in enumerate(own):
            rows.append((c, own[(i + 1) % size]))
            want[c] = (min(own), (low - i) % size)
    got = O.ranked_cycles(spark.createDataFrame(rows, "chain long, next long").repartition(4)).collect()
    assert {r.chain: (r.ring, r.ahead) for r in got} == want


def test_containing_rings(spark):
    squares = [(0, 0, 0, 100), (1, 10, 10, 80), (2, 20, 20, 5), (3, 200, 0, 50)]
    around = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    edges = [("k", r, float(x + s * a), float(y + s * b), float(x + s * c), float(y + s * d)) for r, x, y, s in squares
             for (a, b), (c, d) in zip(around, around[1:])]
    points = [("k", i, x, y) for i, (x, y) in enumerate([(5.0, 5.0), (22.0, 22.0), (50.0, 50.0), (150.0, 20.0), (210.0, 20.0)])] + [("j", 9, 5.0, 5.0)]
    got = O.containing_rings(spark.createDataFrame(points, "k string, point int, x double, y double"),
                             spark.createDataFrame(edges, "k string, ring int, ax double, ay double, bx double, by double"))
    assert sorted((r.point, r.ring) for r in got.collect()) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (4, 3)]
