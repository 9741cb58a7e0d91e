"""Validity and repair spread over tasks: the same verdicts as in one task, for every known defect and for random ones, and large combs."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import validity as V
from canopy.functions.geometry import RINGS, area
from canopy.operators import large_shapes as G
from test_validity import CASES, area as plain_area, box, ring


def rows(spark, shapes):
    data = [(i, None if s is None else [(p, h, list(zip(xs.tolist(), ys.tolist()))) for p, h, xs, ys in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(data, f"shape long, rings {RINGS.simpleString()}").repartition(3)


def wild(rng):
    """A shape with a few rings on a small integer grid, so that they cross, touch, share sides and nest."""
    out = []
    for part in range(rng.randint(1, 3)):
        for k in range(rng.randint(1, 3)):
            x, y, s = rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 9)
            pts = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)] if rng.random() < 0.6 else [
                (x + rng.randint(0, 6), y + rng.randint(0, 6)) for _ in range(rng.randint(3, 6))]
            out.append(ring(pts, part=part, hole=k > 0))
    return out


def flowers(rng):
    """A large round shell with holes that touch it, each other, or lie free."""
    shell = [(100 * math.cos(t / 50 * math.pi), 100 * math.sin(t / 50 * math.pi)) for t in range(100)]
    out = [ring(shell)]
    for _ in range(rng.randint(1, 6)):
        x, y, s = rng.randint(-50, 50), rng.randint(-50, 50), rng.randint(1, 15)
        out.append(box(x, y, x + s, y + s, hole=True))
    if rng.random() < 0.5:
        a, b = shell[7], (20.0, 30.0)
        out.append(ring([a, b, (30.0, 20.0)], hole=True))
    if rng.random() < 0.3:
        out.append(box(200, 200, 201, 201, part=1, hole=True))
    return out


def test_same_verdicts_as_one_task(spark, monkeypatch):
    rng = random.Random(3)
    shapes = [c[1] for c in CASES] + [None, []] + [wild(rng) for _ in range(150)] + [flowers(rng) for _ in range(60)]
    got = {r.shape: (r.valid, r.reason, r.x, r.y) for r in G.large_validity(rows(spark, shapes)).collect()}
    want = {i: V.check(s) or (None,) * 4 for i, s in enumerate(shapes)}
    assert sum(w[0] is True for w in want.values()) > 20 and len({w[1] for w in want.values()}) >= 9
    for i, w in want.items():
        assert got[i] == w, (i, shapes[i])


def test_same_repair_as_one_task(spark):
    rng = random.Random(4)
    shapes = [c[1] for c in CASES] + [wild(rng) for _ in range(60)]
    found = G.even_odd(rows(spark, shapes)).withColumn("ok", V.is_valid("rings")).withColumn("told", area(F.col("rings")))
    got = {r.shape: r for r in found.collect()}
    for i, s in enumerate(shapes):
        want = plain_area(V.repair(s) if not V.check(s)[0] else s)
        assert (got[i].area if i in got else 0.0) == pytest.approx(want), (i, s)
        assert i not in got or (got[i].ok and got[i].told == pytest.approx(want)), (i, s)


def comb(teeth, turn=0.0, broken=False):
    """A bar with upright teeth; one tooth's top corners change places if ``broken``."""
    pts = [(0, 0), (3 * teeth, 0), (3 * teeth, 10)]
    for t in range(teeth - 1, -1, -1):
        top = [(3 * t + 1, 500), (3 * t, 500)]
        pts += [(3 * t + 1, 10), *(top[::-1] if broken and t == teeth // 2 else top), (3 * t, 10)]
    c, s = math.cos(turn), math.sin(turn)
    return ring([(x * c - y * s, x * s + y * c) for x, y in dict.fromkeys(pts)])


@pytest.mark.parametrize("turn", [0.0, math.pi / 2, 0.6])
def test_grid_keeps_meeting_edges_together(turn):
    """A comb's edges are dealt to few cells each, however it is turned, and edges that meet share one."""
    ax, ay, bx, by, rid, pos, n = V._segments([comb(5000, turn)])
    edge, cell = G.grid_cells(ax, ay, bx, by, per_cell=500)
    assert len(edge) <= 2.5 * len(ax) and np.bincount(cell).max() <= 2000
    cells = {}
    for e, c in zip(edge.tolist(), cell.tolist()):
        cells.setdefault(e, set()).add(c)
    assert all(cells[k] & cells[(k + 1) % len(ax)] for k in range(len(ax)))


def test_combs_in_and_over_the_limit(spark):
    """The layer's shapes take either path; the large ones are checked, repaired and valid again."""
    shapes = [[comb(6000)], [comb(6000, broken=True)], [comb(40)], [comb(40, broken=True)], None, [comb(300, 0.6, broken=True)]]
    df = rows(spark, shapes).withColumn("note", F.lit("x"))
    told = {r.shape: r.v for r in G.with_validity(df, name="v", max_points=1000).select("shape", "v").collect()}
    assert told[4] is None and [told[i].valid for i in (0, 1, 2, 3, 5)] == [True, False, True, False, False]
    assert (told[1].x, told[1].y) == (9000.5, 255.0) and told[1].reason == "Self-intersection"
    fixed = G.repaired(df, max_points=1000)
    assert fixed.columns == df.columns
    got = {r.shape: r for r in fixed.select("shape", area(F.col("rings")).alias("area"), F.col("rings").isNull().alias("none")).collect()}
    full = 3 * 6000 * 10 + 6000 * 490
    assert got[0].area == full and got[4].none
    assert got[1].area == pytest.approx(full - 245) and got[5].area == pytest.approx(3 * 300 * 10 + 300 * 490 - 245)
    assert G.with_validity(fixed.where("shape IN (1, 5)"), name="v", max_points=1000).where("v.valid").count() == 2


def test_pairs_stay_bounded():
    """Many long edges side by side: pairs come a bounded number at a time, and only those whose boxes meet."""
    c = comb(30_000)
    ax, ay, bx, by, *_ = V._segments([c])
    sizes = [len(i) for i, _ in V.pair_chunks(ax, ay, bx, by)]
    assert max(sizes) <= V.PAIRS and sum(sizes) < 10 * len(ax)
    assert V.check([c])[0] is True
