"""Intersection area (G12), intersects (G13), within (G14) and the grid join."""
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators.spatial_join import plan_grid, spatial_join
from shapes import layer, multi, poly, rect

CASES = [
    # name, a, b, area, intersects
    ("overlap", poly(rect(0, 0, 4, 4)), poly(rect(2, 2, 4, 4)), 4.0, True),
    ("concave", poly([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]), poly(rect(2, 2, 6, 6)), 20.0, True),
    ("hole", poly(rect(0, 0, 10, 10), [(3, 3), (3, 7), (7, 7), (7, 3)]), poly(rect(2, 2, 4, 4)), 7.0, True),
    ("slanted", poly([(0, 0), (4, 0), (0, 4)]), poly(rect(0, 0, 2, 4)), 6.0, True),
    ("touch edge", poly(rect(0, 0, 4, 4)), poly(rect(4, 0, 4, 4)), 0.0, True),
    ("touch corner", poly(rect(0, 0, 4, 4)), poly(rect(4, 4, 4, 4)), 0.0, True),
    ("disjoint", poly(rect(0, 0, 4, 4)), poly(rect(100, 100, 4, 4)), None, False),
    ("large coords", poly(rect(4400000.25, 9100000.5, 100.5, 80.25)), poly(rect(4400050, 9100010, 500, 500)),
     3590.5625, True),
    ("contained", poly(rect(0, 0, 100, 100)), poly(rect(10, 10, 5, 5)), 25.0, True),
    ("inside hole", poly(rect(0, 0, 100, 100), [(20, 20), (20, 80), (80, 80), (80, 20)]),
     poly(rect(30, 30, 10, 10)), None, False),
    ("negative", poly(rect(-3, -3, 4, 4)), poly(rect(-1, -1, 4, 4)), 4.0, True),
    ("multipart", multi(poly(rect(0, 0, 2, 2)), poly(rect(10, 0, 2, 2))), poly(rect(1, 0, 10, 1)), 2.0, True),
]


@pytest.mark.parametrize("name,a,b,area,hit", CASES, ids=[c[0] for c in CASES])
def test_hand_cases(spark, name, a, b, area, hit):
    left = layer(spark, [(1, a)])
    right = layer(spark, [(2, b)], "rid")
    rows = spatial_join(left, right, left_id="id", right_id="rid").collect()
    assert (len(rows) == 1) == hit
    if hit:
        assert rows[0]["inter_area"] == pytest.approx(area, abs=1e-9)


def test_within_and_contains(spark):
    small = layer(spark, [(1, poly(rect(10, 10, 5, 5))), (2, poly(rect(95, 95, 10, 10))),
                          (3, poly(rect(30, 30, 5, 5)))])
    big = layer(spark, [(9, poly(rect(0, 0, 100, 100), [(20, 20), (20, 80), (80, 80), (80, 20)]))], "rid")
    got = {r["id"] for r in spatial_join(small, big, left_id="id", right_id="rid", predicate="within").collect()}
    assert got == {1}      # 2 crosses the edge, 3 lies in the hole
    got = {(r["bid"], r["sid"]) for r in spatial_join(
        big.withColumnRenamed("rid", "bid"), small.withColumnRenamed("id", "sid"),
        left_id="bid", right_id="sid", predicate="contains").collect()}
    assert got == {(9, 1)}


def _random_rects(seed, n, spread, size):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randint(-spread, spread), rnd.randint(-spread, spread)
        out.append((i, poly(rect(x, y, rnd.randint(1, size), rnd.randint(1, size)))))
    return out


def _brute(a, b):
    res = {}
    for i, ra in a:
        ax = [p["x"] for p in ra[0]["pts"]]
        ay = [p["y"] for p in ra[0]["pts"]]
        for j, rb in b:
            bx = [p["x"] for p in rb[0]["pts"]]
            by = [p["y"] for p in rb[0]["pts"]]
            if min(ax) <= max(bx) and min(bx) <= max(ax) and min(ay) <= max(by) and min(by) <= max(ay):
                res[(i, j)] = (max(0, min(max(ax), max(bx)) - max(min(ax), min(bx)))
                               * max(0, min(max(ay), max(by)) - max(min(ay), min(by))))
    return res


@pytest.mark.parametrize("seed,cell", [(1, None), (2, 4.0), (3, 64.0)])
def test_grid_join_equals_brute_force(spark, seed, cell):
    """J01 == brute-force pair list; independent of cell size; mixed sizes use several levels."""
    a = _random_rects(seed, 60, 50, 8) + [(1000, poly(rect(-60, -60, 120, 120)))]
    b = _random_rects(seed + 100, 60, 50, 20)
    got = spatial_join(layer(spark, a), layer(spark, b, "rid"), left_id="id", right_id="rid",
                       cell_size=cell).collect()
    got = {(r["id"], r["rid"]): r["inter_area"] for r in got}
    want = _brute(a, b)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_symmetry_and_self_area(spark):
    shapes = [(1, poly([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)])),
              (2, poly([(1, 1), (9, 2), (5, 9)])),
              (3, poly(rect(0, 0, 10, 10), [(3, 3), (3, 7), (7, 7), (7, 3)]))]
    L = layer(spark, shapes)
    R = L.withColumnRenamed("id", "rid")
    ab = {(r["id"], r["rid"]): r["inter_area"] for r in spatial_join(L, R, left_id="id", right_id="rid").collect()}
    areas = {r["id"]: r["area"] for r in L.collect()}
    for (i, j), v in ab.items():
        assert v == pytest.approx(ab[(j, i)])
        assert v <= min(areas[i], areas[j]) + 1e-9
    for i in areas:
        assert ab[(i, i)] == pytest.approx(areas[i])


def test_left_join_keeps_unmatched(spark):
    a = layer(spark, [(1, poly(rect(0, 0, 4, 4))), (2, poly(rect(50, 50, 1, 1)))])
    b = layer(spark, [(7, poly(rect(2, 2, 4, 4)))], "rid")
    rows = sorted((r["id"], r["rid"]) for r in
                  spatial_join(a, b, left_id="id", right_id="rid", how="left", with_area=False).collect())
    assert rows == [(1, 7), (2, None)]


def test_exploded_kernel_matches_batched(spark):
    a = _random_rects(7, 40, 30, 10)
    b = _random_rects(8, 40, 30, 10)
    la, lb = layer(spark, a), layer(spark, b, "rid")
    plan = plan_grid(la, lb)
    x = {(r["id"], r["rid"]): r["inter_area"] for r in
         spatial_join(la, lb, left_id="id", right_id="rid", plan=plan, kernel="batched").collect()}
    y = {(r["id"], r["rid"]): r["inter_area"] for r in
         spatial_join(la, lb, left_id="id", right_id="rid", plan=plan, kernel="exploded").collect()}
    assert x.keys() == y.keys()
    for k in x:
        assert x[k] == pytest.approx(y[k])


def test_salted_hot_cells_give_the_same_pairs(spark):
    """A third of the left shapes piled into one cell: salting splits that cell
    over several tasks and finds exactly the same pairs."""
    import canopy.operators.spatial_join as SJ
    hot = [(1000 + i, poly(rect(1, 1, 2, 2))) for i in range(60)]
    a = _random_rects(11, 120, 40, 6) + hot
    b = _random_rects(12, 80, 40, 6) + [(500, poly(rect(0, 0, 4, 4)))]
    la, lb = layer(spark, a), layer(spark, b, "rid")
    plan = plan_grid(la, lb, cell_size=8.0)
    old = SJ.BROADCAST_MAX_ROWS
    SJ.BROADCAST_MAX_ROWS = -1          # force the shuffle join, where salting applies
    try:
        plain = {(r["id"], r["rid"]): r["inter_area"] for r in
                 spatial_join(la, lb, left_id="id", right_id="rid", plan=plan).collect()}
        salted_df = spatial_join(la, lb, left_id="id", right_id="rid", plan=plan, salt_buckets=4, hot_cell_rows=20)
        salted = {(r["id"], r["rid"]): r["inter_area"] for r in salted_df.collect()}
    finally:
        SJ.BROADCAST_MAX_ROWS = old
    assert salted == plain
    assert set(plain) == set(_brute(a, b))


def test_dissolve_union_area_with_copies_and_hot_cells(spark):
    from canopy.operators.dissolve import dissolve_area
    rows = [(1, poly(rect(0, 0, 4, 4))), (2, poly(rect(2, 2, 4, 4))), (3, poly(rect(10, 10, 2, 2)))]
    rows += [(100 + i, poly(rect(1, 1, 2, 2))) for i in range(30)]        # copies inside shape 1
    rows += [(200 + i, poly(rect(0.1 * i, 0.1 * i, 1, 1))) for i in range(25)]  # many distinct overlaps
    df = layer(spark, rows).withColumn("k", F.when(F.col("id") == 3, "b").otherwise("a"))
    for kwargs in ({}, {"cell_size": 4.0, "max_group_rows": 5, "split": 4}):
        got = {r["k"]: (r["union_area"], r["n_shapes"]) for r in dissolve_area(df, "k", **kwargs).collect()}
        # a: the two 4x4 squares overlap by 4 -> 28; the copies and the diagonal
        # chain of unit squares (up to (2.4, 2.4)-(3.4, 3.4)) lie inside them
        assert got["b"] == (pytest.approx(4.0), 1)
        assert got["a"][1] == 57
        assert got["a"][0] == pytest.approx(28.0)


def test_duplicated_municipality_name_doubles_rows(spark):
    """The municipality only filters; a second municipality with the
    same name meeting the same polygon counts the polygon's area again."""
    from canopy.plans.yearly import car_in_municipality
    prodes = layer(spark, [(1, poly(rect(0, 0, 200, 100)))])
    car = layer(spark, [(10, poly(rect(0, 0, 100, 100))), (11, poly(rect(150, 0, 100, 100)))])
    car = car.withColumn("desc_subclass", F.lit("Cadastro Ambiental Rural")).withColumn(
        "geometry", F.lit(b"\x01"))
    one = layer(spark, [(5, poly(rect(-10, -10, 50, 50)))]).withColumn("NM_MUN", F.lit("Feijó"))
    two = layer(spark, [(5, poly(rect(-10, -10, 50, 50))), (6, poly(rect(190, 90, 50, 50)))]).withColumn(
        "NM_MUN", F.lit("Feijó"))
    other = layer(spark, [(7, poly(rect(-10, -10, 50, 50)))]).withColumn("NM_MUN", F.lit("Outro"))
    a1 = {r["id_malha"]: r["area_desmatada_ha"] for r in car_in_municipality(prodes, one, car).collect()}
    a2 = {r["id_malha"]: r["area_desmatada_ha"] for r in car_in_municipality(prodes, two, car).collect()}
    assert a1 == {10: 1.0, 11: 0.5}          # m2 / 10,000, not clipped to the municipality
    assert a2 == {10: 2.0, 11: 1.0}
    assert car_in_municipality(prodes, other, car).count() == 0


def test_within_distance_join_hand_cases(spark):
    from canopy.operators.proximity import within_distance_join
    a = layer(spark, [(1, poly(rect(0, 0, 4, 4)))])
    b = layer(spark, [(10, poly(rect(7, 0, 2, 2))),        # gap 3 along x
                      (11, poly(rect(7, 8, 2, 2))),        # corner gap (3, 4) -> 5
                      (12, poly(rect(2, 2, 1, 1))),        # inside -> 0
                      (13, poly(rect(4, 0, 1, 1))),        # touching -> 0
                      (14, poly([(10, 10), (20, 10), (10, 20)]))], "rid")
    got = {r["rid"]: r["distance"] for r in within_distance_join(a, b, 5.0, left_id="id", right_id="rid").collect()}
    assert got == {10: 3.0, 11: 5.0, 12: 0.0, 13: 0.0}
    got = {r["rid"] for r in within_distance_join(a, b, 4.9, left_id="id", right_id="rid").collect()}
    assert got == {10, 12, 13}


def test_describe_layer(spark):
    from canopy.operators.describe import describe_layer
    df = spark.createDataFrame([(float(v), None if v % 4 == 0 else v) for v in range(1, 101)], "a double, b long")
    rows = {r["column"]: r for r in describe_layer(df).collect()}
    assert rows["a"]["count"] == 100 and rows["a"]["nulls"] == 0
    assert rows["a"]["mean"] == pytest.approx(50.5) and rows["a"]["min"] == 1 and rows["a"]["max"] == 100
    assert (rows["a"]["q1"], rows["a"]["median"], rows["a"]["q3"]) == (25.0, 50.0, 75.0)
    assert rows["b"]["count"] == 75 and rows["b"]["nulls"] == 25
