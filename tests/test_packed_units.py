"""Cell rows of large layers: few of them, packed while they are dealt out."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import block_join as BJ
from canopy.operators.spatial_join import plan_grid, spatial_join, with_cells
from shapes import layer, poly, rect
from test_block_join import _rows, sides  # noqa: F401


@pytest.fixture
def packed(monkeypatch):
    """Every layer counts as large, cells are cut into blocks, packs are small."""
    for name, value in (("PACKED_SHAPES", 0), ("PACKED_PAIRS", 0), ("UNIT_PAIRS", 200), ("UNITS", 1 << 20), ("BLOCK_ROWS", 8), ("LEAST_PACK", 2), ("PACK_ROWS", 50), ("UNPACK_BYTES", 4000)):
        monkeypatch.setattr(BJ, name, value, raising=False)


@pytest.mark.parametrize("predicate", ["intersects", "within", "contains"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_packed_units_give_the_same_pairs(spark, sides, packed, predicate, how):  # noqa: F811
    left, right = sides
    left = left.withColumn("a", F.struct("id", F.lit("x").alias("t"))).withColumn("when", F.timestamp_seconds(F.col("id")))
    right = right.withColumn("b", F.when(F.col("rid") % 3 > 0, F.concat(F.lit("name "), "rid"))).withColumn("c", F.array("rid", F.lit(None)))
    run = lambda k: spatial_join(left, right, left_id="id", right_id="rid", left_cols=["a", "when"], right_cols=["k", "b", "c"],
                                 predicate=predicate, how=how, kernel=k)
    got, want = run("blocks"), run("batched")
    got = got.select(want.columns)
    assert got.dtypes == want.dtypes
    assert _rows(got) == _rows(want)


def _dense(spark):
    """Many shapes in a small place, of several classes of size."""
    rng = random.Random(5)
    some = lambda n, lo, hi: [(i, poly(rect(rng.randint(0, 4000), rng.randint(0, 4000), rng.randint(lo, hi), rng.randint(lo, hi)))) for i in range(n)]
    return layer(spark, some(4000, 200, 500)), layer(spark, some(600, 400, 1200), "rid")


def test_few_rows_are_dealt_out(spark, monkeypatch):
    """A shape went to a row for each level, cell and block, with its edges: 100 GB of shuffled rows at 360 times sf0.1."""
    held, units = [], BJ._units
    real, maps = type(spark.range(0)).mapInArrow, []
    for name, value in (("PACKED_SHAPES", 0), ("PACKED_PAIRS", 0), ("UNIT_PAIRS", 1 << 12), ("BLOCK_ROWS", 1 << 9)):
        monkeypatch.setattr(BJ, name, value, raising=False)
    monkeypatch.setattr(BJ, "_units", lambda *args: held.append(units(*args)) or held[-1])
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, *args, **more: maps.append(real(df, *args, **more)) or maps[-1])
    left, right = _dense(spark)
    spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks")
    rows = held[0].count()
    assert rows <= 8 * 4600
    dealt = [m.agg(F.sum(F.length("_rows"))).first()[0] for m in maps if "_rows" in m.columns]
    assert len(dealt) == 2 and sum(dealt) < 80 * rows


def test_blocks_of_a_cell_hold_a_bounded_share(spark, monkeypatch):
    """Everything in one spot is shared out, and found once."""
    for name, value in (("PACKED_SHAPES", 0), ("PACKED_PAIRS", 0), ("UNIT_PAIRS", 10_000), ("LEAST_PACK", 8)):
        monkeypatch.setattr(BJ, name, value, raising=False)
    left = layer(spark, [(i, poly(rect(0, 0, 4, 4))) for i in range(1000)]).repartition(4)
    right = layer(spark, [(i, poly(rect(1, 1, 4, 4))) for i in range(300)], "rid")
    plan = plan_grid(left, right, packed=True)
    got = BJ._units(left, right, "id", "rid", [], [], plan).groupBy(*BJ._UNIT).agg(F.count_if("is_left").alias("l"), F.count_if(~F.col("is_left")).alias("r"))
    assert got.agg(F.max(F.col("l") * F.col("r"))).first()[0] <= 2 * plan.unit_pairs
    assert spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks").count() == 300_000


def test_memory_of_a_unit_is_bounded():
    """However many pairs there are, no block takes more rows of a side than where pairs are only summed."""
    most = BJ.BLOCK_ROWS * BJ.WIDER
    for n, m, unit in ((1e9, 1e7, 1e13), (1e9, 10, 1e14), (5e4, 5e4, 2.0 ** 24), (10, 10, 2.0 ** 24)):
        lb, rb = max(1, BJ._cuts(n, m, unit)), max(1, BJ._cuts(m, n, unit))
        assert n / lb <= most and m / rb <= most and n / lb * m / rb <= 1.01 * unit


@pytest.mark.parametrize("span", [0, 1, 2, 3])
def test_cells_of_a_plan_with_a_span(spark, span):
    """Each shape is in the cells that its box covers, at its level and at those of the other side."""
    from dataclasses import replace
    rng = random.Random(span)
    shapes = [(i, poly(rect(rng.randint(-90, 90), rng.randint(-90, 90), rng.choice([1, 3, 8, 30, 64]), rng.choice([1, 7, 16, 50])))) for i in range(60)]
    df = layer(spark, shapes)
    plan = replace(plan_grid(df, df.limit(0), cell_size=8.0), span=span, left_levels=tuple(range(max(0, 3 - span) + 1)))
    got = sorted(tuple(r) for r in with_cells(df, plan, (1,)).select("id", "lvl", "cx", "cy").collect())
    want = []
    for r in df.collect():
        extent = max(r.x1 - r.x0, r.y1 - r.y0)
        own = max(0, int(np.ceil(np.log2(extent))) - 3 - span)
        for lvl in sorted({own} | ({1} if own <= 1 else set())):
            size = 8.0 * 2 ** lvl
            want += [(r.id, lvl, cx, cy) for cx in range(int(r.x0 // size), int(r.x1 // size) + 1) for cy in range(int(r.y0 // size), int(r.y1 // size) + 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("large", [False, True])
def test_a_left_join_deals_its_shapes_out_once(spark, sides, monkeypatch, large):  # noqa: F811
    """Pairs and left rows with a partner each had a shuffle of both layers, and the numbered left rows held columns nobody asked for."""
    from canopy.operators import spatial_join as SJ
    if large:
        monkeypatch.setattr(BJ, "PACKED_SHAPES", 0, raising=False)
        monkeypatch.setattr(BJ, "PACKED_PAIRS", 0, raising=False)
    left, right = sides
    held, real, numbered = [], BJ._units, SJ._numbered
    monkeypatch.setattr(BJ, "_units", lambda *args: held.append(real(*args)) or held[-1])
    files = []
    monkeypatch.setattr(SJ, "_numbered", lambda df, name: files.append(numbered(df, name)) or files[-1])
    run = lambda k: spatial_join(left.withColumn("note", F.lit("long")), right, left_id="id", right_id="rid", how="left", left_cols=["x0"],
                                 right_cols=[], with_area=False, kernel=k)
    got = run("blocks")
    rows = _rows(got)
    assert len(held) == 1 and "note" not in files[0].columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert rows == _rows(run("batched").select(got.columns))


def test_few_pairs_are_not_packed(spark, monkeypatch):
    """Packing costs time; where shapes have few partners there is little to save."""
    monkeypatch.setattr(BJ, "PACKED_SHAPES", 0)
    few = layer(spark, [(i, poly(rect(10 * i, 0, 6, 6))) for i in range(200)]), layer(spark, [(1, poly(rect(0, 0, 2000, 50)))], "rid")
    assert plan_grid(*few, packed=True) == plan_grid(*few)
    assert plan_grid(*_dense(spark), packed=True).unit_pairs > 0
