"""Validity and repair on defects whose answer is known, and the repair's promise on random rings."""
import random

import numpy as np
import pyarrow as pa
import pytest

from canopy.functions.validity import _checked, check, repair, simple_rows, _ring_area2
from canopy.functions.wkb import _rings_to_arrow, decode_batch, decode_rings, encode_rings

NAN = float("nan")


def ring(pts, part=0, hole=False):
    pts = list(pts) + [pts[0]]
    return (part, hole, np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float))


def box(x0, y0, x1, y1, **kw):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], **kw)


def area(rings):
    return sum((-1 if h else 1) * abs(_ring_area2(x, y)) / 2 for _p, h, x, y in rings)


SQUARE = box(0, 0, 10, 10)
CASES = [
    # name, rings, valid, reason, area after repair (even-odd)
    ("square", [SQUARE], True, None, 100),
    ("repeated vertex", [ring([(0, 0), (10, 0), (10, 0), (10, 10), (0, 10)])], True, None, 100),
    ("hole", [SQUARE, box(2, 2, 4, 4, hole=True)], True, None, 96),
    ("hole touches shell at a vertex", [SQUARE, ring([(0, 5), (5, 4), (5, 6)], hole=True)], True, None, 95),
    ("hole touches shell at a corner", [SQUARE, ring([(0, 0), (4, 2), (2, 4)], hole=True)], True, None, 94),
    ("two parts touch at a corner", [SQUARE, box(10, 10, 12, 12, part=1)], True, None, 104),
    ("island in a hole", [SQUARE, box(2, 2, 8, 8, hole=True), box(3, 3, 5, 5, part=1)], True, None, 68),
    ("bow-tie", [ring([(0, 0), (10, 10), (10, 0), (0, 10)])], False, "Self-intersection", 50),
    ("spike", [ring([(0, 0), (10, 0), (10, 10), (15, 10), (10, 10), (0, 10)])], False, "Self-intersection", 100),
    ("nested shells", [SQUARE, box(2, 2, 4, 4, part=1)], False, "Nested shells", 96),
    ("parts overlap", [SQUARE, box(5, 5, 15, 15, part=1)], False, "Self-intersection", 150),
    ("parts share an edge", [SQUARE, box(10, 0, 20, 10, part=1)], False, "Self-intersection", 200),
    ("wound twice", [ring([(0, 0), (10, 0), (10, 10), (0, 10)] * 2)], False, "Self-intersection", 0),
    ("hole crosses shell", [SQUARE, box(8, 2, 12, 4, hole=True)], False, "Self-intersection", 100),
    ("hole outside", [SQUARE, box(20, 20, 22, 22, hole=True)], False, "Hole lies outside shell", 104),
    ("hole in hole", [SQUARE, box(2, 2, 8, 8, hole=True), box(3, 3, 5, 5, hole=True)], False, "Holes are nested", 68),
    ("hole leaves through a vertex", [SQUARE, ring([(0, 0), (5, 0), (0, -5), (-5, 0)], hole=True)], False, None, None),
    ("hole cuts the interior", [SQUARE, ring([(0, 5), (5, 4), (10, 5), (5, 6)], hole=True)], False, "Interior is disconnected", 90),
    ("chain of holes cuts the interior", [SQUARE, ring([(0, 5), (3, 4), (5, 5), (3, 6)], hole=True),
                                          ring([(5, 5), (7, 4), (10, 5), (7, 6)], hole=True)], False, "Interior is disconnected", 90),
    ("ring touches itself", [ring([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)])], False, "Self-intersection", 50),
    ("not finite", [ring([(0, 0), (10, 0), (NAN, 10), (0, 10)])], False, "Invalid Coordinate", 50),
    ("two points", [ring([(0, 0), (10, 0)])], False, "Too few points", 0),
]


@pytest.mark.parametrize("name,rings,valid,reason,want", CASES, ids=[c[0] for c in CASES])
def test_known_cases(name, rings, valid, reason, want):
    got = check(rings)
    assert got[0] is valid
    if reason:
        assert got[1] == reason
    fixed = repair(rings)
    assert check(fixed)[0], check(fixed)
    if want is not None:
        assert area(fixed) == pytest.approx(want)


def covered(rings, x, y):
    """Even-odd membership of points."""
    inside = np.zeros(len(x), bool)
    for _p, _h, rx, ry in rings:
        for ax, ay, bx, by in zip(rx[:-1], ry[:-1], rx[1:], ry[1:]):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return inside


@pytest.mark.parametrize("seed", range(25))
def test_repair_always_gives_valid_even_odd_area(seed):
    rng = random.Random(seed)
    rings = []
    for part in range(rng.randint(1, 3)):
        pts = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(4, 12))]
        if len(set(pts)) > 2:
            rings.append(ring(pts, part=part, hole=bool(part and rng.random() < 0.3)))
    if not rings:
        return
    fixed = repair(rings)
    assert check(fixed)[0], (rings, check(fixed))
    if not check(rings)[0]:
        r = np.random.default_rng(seed)
        x, y = r.uniform(0, 12, 400) + 1e-4, r.uniform(0, 12, 400) + 1e-4
        assert (covered(rings, x, y) == covered(fixed, x, y)).all()


def test_batch_filter_agrees_with_the_checks():
    rng = random.Random(3)
    rows = [c[1] for c in CASES] + [None, []]
    for _ in range(300):
        n = rng.randint(3, 7)
        rows.append([ring([(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)])])
    arr = _rings_to_arrow(rows)
    plain = simple_rows(arr)
    assert plain.sum() > 20
    for p, r, got in zip(plain, rows, _checked(arr)):
        want = check(r)
        assert (got is None) == (want is None)
        assert got is None or got[:2] == want[:2]
        assert not p or want[0]


def test_mixed_batches_decode():
    """Polygons take the batch decoder, each other kind the row decoder; geometry without area gives no rings."""
    import struct
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    line = struct.pack("<BIIdddd", 1, 2, 2, 0, 0, 1, 1)
    square = encode_rings([SQUARE])
    multi = encode_rings([SQUARE, box(20, 20, 21, 21, part=1)])
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + struct.pack(">8d", 0, 0, 1, 0, 0, 1, 0, 0)
    empty = struct.pack("<BII", 1, 7, 0)
    both = struct.pack("<BII", 1, 7, 3) + point + square + multi
    rows = [square, None, point, multi, big, empty, line, both, square]
    got = decode_batch(pa.array(rows, pa.binary())).to_pylist()
    assert [None if g is None else len(g) for g in got] == [1, None, 0, 2, 1, 0, 0, 3, 1]
    assert [r["part"] for r in got[7]] == [0, 1, 2]
    assert decode_rings(point) == []
