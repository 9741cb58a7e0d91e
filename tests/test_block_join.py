"""The grid join by blocks against the join that makes a row per candidate pair."""
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import block_join as BJ
from canopy.operators.proximity import within_distance_join
from canopy.operators.spatial_join import pair_count, spatial_join
from shapes import layer, multi, poly, rect
from test_scale import star


def _shapes(seed, n, far, size):
    """Rectangles, L shapes, slanted and many-edged shapes, holes and parts, on whole coordinates where they can be."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rng.randint(-far, far), rng.randint(-far, far), 2 * rng.randint(2, size), 2 * rng.randint(2, size)
        kind = i % 6
        if kind == 0:
            g = poly([(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h)])
        elif kind == 1:
            g = poly([(x, y), (x + w, y + 1), (x + 2, y + h)])
        elif kind == 2:
            g = poly(star(40, x, y, w, i))
        elif kind == 3:
            g = poly(rect(x, y, w, h), [(x + 1, y + 1), (x + 1, y + 2), (x + 2, y + 2), (x + 2, y + 1)])
        elif kind == 4:
            g = multi(poly(rect(x, y, w, h)), poly(rect(x + w + 2, y, 3, 3)))
        else:
            g = poly(rect(x, y, w, h))
        out.append((i % 50 if i % 11 else None, g))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    left = layer(spark, _shapes(1, 150, 60, 6) + [(900, poly(rect(-200, -200, 400, 400)))])
    right = layer(spark, _shapes(2, 120, 60, 12) + [(901, [])], "rid")
    return left, right.withColumn("k", F.when(F.col("rid") % 3 > 0, F.col("rid") % 3))


def _rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [None, 3])
@pytest.mark.parametrize("predicate", ["intersects", "within", "contains"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_blocks_give_the_same_pairs(spark, sides, monkeypatch, block_rows, predicate, how):
    left, right = sides
    if block_rows:
        monkeypatch.setattr(BJ, "BLOCK_ROWS", block_rows)
    run = lambda k: _rows(spatial_join(left, right, left_id="id", right_id="rid", right_cols=["k"], predicate=predicate, how=how, kernel=k))
    assert run("blocks") == run("batched")


def test_cut_shapes_by_blocks(spark, sides):
    left, right = sides
    run = lambda k, m: _rows(spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel=k, max_edges=m))
    assert run("blocks", 12) == run("batched", 12) == run("blocks", None)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_totals_are_those_of_the_pairs(spark, sides, how):
    left, right = sides
    pairs = spatial_join(left, right, left_id="id", right_id="rid", how=how, left_cols=[], right_cols=["k"])
    want = pairs.groupBy("k").agg(F.count("*"), F.count("id"), F.countDistinct("rid"), F.sum("inter_area"))
    t = spatial_join(left.withColumn("named", F.col("id").isNotNull()), right, left_id="id", right_id="rid", how=how, left_cols=["named"], right_cols=["k"],
                     kernel="blocks", totals_by=["rid", "k", "named"])
    got = t.groupBy("k").agg(pair_count(), pair_count("named"), F.countDistinct("rid"), F.sum("inter_area"))
    assert _rows(got) == _rows(want)
    if how == "inner":
        big = spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=["k"], kernel="blocks", totals_by=["k"], least_area=5.0)
        assert _rows(big.groupBy("k").agg(pair_count(), F.sum("inter_area"))) \
            == _rows(pairs.where("inter_area > 5").groupBy("k").agg(F.count("*"), F.sum("inter_area")))


def test_within_distance_by_blocks(spark):
    from canopy.functions import overlay as ov
    from canopy.functions.overlay_arrow import boundary_dist2_col, pair_overlay_col
    left, right = layer(spark, _shapes(3, 60, 40, 4)), layer(spark, _shapes(4, 60, 40, 4), "rid")
    cross = left.select("id", F.struct(*left.columns).alias("a")).crossJoin(right.select("rid", F.struct(*right.columns).alias("b")))
    o = cross.select("id", "rid", "a", "b", pair_overlay_col(F.col("a.edges"), F.col("b.edges"), F.least("a.y0", "b.y0")).alias("o"),
                     boundary_dist2_col(F.col("a.edges"), F.col("b.edges")).alias("d2"))
    hit = ov.intersects(F.col("o.edge_contact"), F.col("o.inter_area"), F.col("a.area"), F.col("b.area"))
    want = o.select("id", "rid", F.when(hit, 0.0).otherwise(F.sqrt("d2")).alias("distance")).where("distance <= 3")
    assert _rows(within_distance_join(left, right, 3.0, left_id="id", right_id="rid")) == _rows(want)


def test_a_crowded_cell_is_shared_out(spark, monkeypatch):
    """No unit holds more than about BLOCK_ROWS rows of a side, and pairs are found once."""
    monkeypatch.setattr(BJ, "BLOCK_ROWS", 100)
    left = layer(spark, [(i, poly(rect(0, 0, 4, 4))) for i in range(1000)]).repartition(4)
    right = layer(spark, [(i, poly(rect(1, 1, 4, 4))) for i in range(300)], "rid")
    from canopy.operators.spatial_join import plan_grid
    units = BJ._units(left, right, "id", "rid", [], [], plan_grid(left, right))
    largest = units.groupBy(*BJ._UNIT, "is_left").count().agg(F.max("count")).first()[0]
    assert largest <= 200
    assert spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks").count() == 300_000


def test_tasks_and_units_follow_the_pairs(spark, monkeypatch):
    """A task's pairs were as many as the tables' growth made them: units and tasks are cut by pairs too."""
    from canopy.operators.spatial_join import plan_grid
    left = layer(spark, [(i, poly(rect(i % 20, i // 20, 6, 6))) for i in range(400)])
    right = layer(spark, [(i, poly(rect(i % 20, i // 20, 5, 5))) for i in range(400)], "rid")
    run = lambda: _rows(spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[], kernel="blocks"))
    want, plan = run(), plan_grid(left, right)
    assert len(want) / 2 < plan.pairs < 2 * len(want)
    monkeypatch.setattr(BJ, "BLOCK_ROWS", 64)
    monkeypatch.setattr(BJ, "UNIT_PAIRS", 100)
    monkeypatch.setattr(BJ, "TASK_PAIRS", 400)
    units = BJ._units(left, right, "id", "rid", [], [], plan)
    assert units.rdd.getNumPartitions() == int(plan.pairs // 400) > 32
    most = units.groupBy(*BJ._UNIT).agg(F.count_if("is_left").alias("l"), F.count_if(~F.col("is_left")).alias("r")).agg(F.max(F.col("l") * F.col("r"))).first()[0]
    assert most <= 4 * 16 * 16
    assert run() == want


def test_pairs_leave_the_task_in_runs(spark, monkeypatch):
    """Spark read a row from Python for every pair; now one for a run of pairs of a left row, with the same pairs and kept values."""
    left = layer(spark, [(i if i % 5 else None, poly(rect(i % 20, i // 20, 6, 6))) for i in range(400)]).withColumn("a", F.struct("id", F.lit("x").alias("t")))
    right = layer(spark, [(i, poly(rect(i % 20, i // 20, 5, 5))) for i in range(400)], "rid")
    right = right.withColumn("b", F.when(F.col("rid") % 3 > 0, F.concat(F.lit("name "), "rid"))).withColumn("c", F.array("rid", F.lit(None)))
    held, real = [], type(left).mapInArrow
    monkeypatch.setattr(type(left), "mapInArrow", lambda df, *args, **more: held.append(real(df, *args, **more)) or held[-1])
    run = lambda k: spatial_join(left, right, left_id="id", right_id="rid", left_cols=["a"], right_cols=["b", "c"], kernel=k)
    got, want = run("blocks"), run("batched")
    assert got.dtypes == want.dtypes and got.columns == want.columns
    rows = _rows(got)
    assert rows == _rows(want)
    assert 4 * held[0].count() < len(rows)
