"""What must hold when layers are large, skewed or badly keyed."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions.overlay_arrow import pair_min_dist2, pair_sums
from canopy.operators.dissolve import dissolve_area
from canopy.operators.spatial_join import grid_layout, in_box, plan_grid, spatial_join
from canopy.operators.subdivide import pieces, subdivide
from shapes import layer, poly, rect


def star(n, x, y, r, seed=0):
    """A simple star-shaped ring of n vertices."""
    rng = random.Random(seed)
    far = [r * (0.5 + 0.5 * rng.random()) for _ in range(n)]
    return [(x + f * math.cos(2 * math.pi * k / n), y + f * math.sin(2 * math.pi * k / n)) for k, f in enumerate(far)]


def edges(pts):
    return np.array([(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1])], float)


def shoelace(e):
    return float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2)


def as_arrow(rows):
    import pyarrow as pa
    kind = pa.list_(pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")]))
    return pa.array([None if r is None else [dict(zip(("ax", "ay", "bx", "by"), v)) for v in r.tolist()] for r in rows], kind)


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_kernel_in_small_portions(limit):
    a = [edges(star(40, 0, 0, 10, 1)), edges(rect_pts(0, 0, 2, 2)), None, edges(rect_pts(0, 0, 9, 9))]
    b = [edges(star(30, 3, 2, 8, 2)), edges(rect_pts(1, 1, 3, 3)), edges(rect_pts(0, 0, 1, 1)), np.zeros((0, 4))]
    yb = np.array([-20.0, 0, 0, 0])
    want, touch = pair_sums(as_arrow(a), as_arrow(b), yb)
    got, contact = pair_sums(as_arrow(a), as_arrow(b), yb, limit)
    assert np.allclose(got, want) and (contact == touch).all()
    assert want[1] == 1.0 and list(want[2:]) == [0, 0]
    assert np.allclose(pair_min_dist2(as_arrow(a), as_arrow(b), limit), pair_min_dist2(as_arrow(a), as_arrow(b)))


def rect_pts(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize("n", [5, 100, 3000])
def test_pieces_are_small_and_add_up(n):
    e = edges(star(n, 7, -3, 100, n))
    parts = pieces(e, 32)
    assert max(map(len, parts)) <= 32 or n <= 32
    yb = np.full(1, e[:, [1, 3]].min() - 1)
    whole = shoelace(e)
    # each piece measured against a box that holds it all
    box = edges(rect_pts(-200, yb[0], 200, 200))
    got = [pair_sums(as_arrow([p]), as_arrow([box]), yb)[0][0] for p in parts]
    assert min(got) >= -1e-6 and sum(got) == pytest.approx(whole)


def test_subdivided_join_is_the_same_join(spark):
    big = [(1, poly(star(2000, 0, 0, 100, 1))), (2, poly(star(500, 80, 40, 60, 2))), (3, poly(rect(500, 500, 4, 4)))]
    rng = random.Random(0)
    small = [(k, poly(rect(rng.randint(-120, 120), rng.randint(-120, 120), rng.randint(1, 20), rng.randint(1, 20)))) for k in range(150)]
    left, right = layer(spark, small), layer(spark, big, "rid")
    assert subdivide(right, 64).where(F.size("edges") > 64).count() == 0
    for predicate in ("intersects", "within"):
        run = lambda **k: {(r["id"], r["rid"]): r["inter_area"] for r in spatial_join(
            left, right, left_id="id", right_id="rid", predicate=predicate, **k).collect()}
        plain, cut = run(), run(max_edges=64)
        assert cut.keys() == plain.keys() and plain
        assert all(cut[k] == pytest.approx(plain[k], abs=1e-6) for k in plain)


@pytest.mark.parametrize("kernel", ["batched", "exploded"])
def test_repeated_and_null_ids(spark, kernel):
    shapes = [(5, poly(rect(0, 0, 4, 4))), (5, poly(rect(0, 0, 4, 4))), (None, poly(rect(1, 1, 4, 4))), (None, poly(rect(50, 50, 1, 1)))]
    right = layer(spark, [(None, poly(rect(2, 2, 4, 4))), (9, poly(rect(2, 2, 4, 4)))], "rid")
    left = layer(spark, shapes)
    got = sorted(((r["id"], r["rid"], r["inter_area"]) for r in spatial_join(left, right, left_id="id", right_id="rid", kernel=kernel).collect()), key=str)
    assert got == sorted([(5, r, 4.0) for r in (None, 9)] * 2 + [(None, r, 9.0) for r in (None, 9)], key=str)
    rows = spatial_join(left, right, left_id="id", right_id="rid", how="left", kernel=kernel, with_area=False).collect()
    assert len(rows) == 7


def test_hot_cell_is_split_by_the_engine(spark):
    """90 % of the shapes in one spot: the join's partition of that cell is divided."""
    import canopy.operators.spatial_join as SJ
    rng = random.Random(1)
    a = [(i, poly(rect(rng.randint(0, 3) if i % 10 else rng.randint(100, 4000), rng.randint(0, 3), 2, 2))) for i in range(4000)]
    b = [(i, poly(rect(rng.randint(0, 4000), 0, 2, 2))) for i in range(400)] + [(1000, poly(rect(0, 0, 3, 3)))]
    left, right = layer(spark, a).repartition(8), layer(spark, b, "rid").repartition(4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    rows, SJ.BROADCAST_MAX_ROWS = SJ.BROADCAST_MAX_ROWS, -1
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = spatial_join(left, right, left_id="id", right_id="rid", left_cols=[], right_cols=[])
        df = pairs.groupBy("rid").agg(F.sum("inter_area"))
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        SJ.BROADCAST_MAX_ROWS = rows
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_small_shapes_keep_their_own_cells(spark):
    small = layer(spark, [(i, poly(rect(i * 10, 0, 4, 4))) for i in range(50)])
    large = layer(spark, [(1, poly(rect(0, 0, 5000, 5000)))], "rid")
    assert plan_grid(small, large).cell == 4.0


def test_carried_columns_count_for_the_broadcast(spark):
    from canopy.operators import spatial_join as SJ
    small = layer(spark, [(1, poly(rect(0, 0, 4, 4)))], "rid").withColumn("note", F.repeat(F.lit("x"), 1000))
    big = layer(spark, [(i, poly(rect(i, 0, 4, 4))) for i in range(5)])
    assert plan_grid(big, small, left_keep=[], right_keep=["note"]).small_kept == 1000
    assert SJ.broadcast_estimate(1, 4, 1, 1000) > SJ.broadcast_estimate(1, 4, 1)


def test_dissolve_keeps_null_and_empty_keys(spark):
    shapes = [(1, poly(rect(0, 0, 4, 4))), (2, poly(rect(2, 2, 4, 4))), (3, poly(rect(0, 0, 1, 1))), (4, []), (5, poly(rect(9, 9, 1, 1)))]
    df = layer(spark, shapes).withColumn("k", F.when(F.col("id") <= 2, "a").when(F.col("id") == 4, "e"))
    got = {r["k"]: (r["union_area"], r["n_shapes"]) for r in dissolve_area(df, "k").collect()}
    assert got == {"a": (28.0, 2), None: (2.0, 2), "e": (0.0, 1)}


def test_dissolve_cuts_crowded_cells(spark):
    """All shapes in one cell, cut until no task sweeps more than a few edges."""
    rng = random.Random(4)
    shapes = [(i, poly(rect(rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 9), rng.randint(1, 9)))) for i in range(300)]
    grid = np.zeros((80, 80), bool)
    for _i, rings in shapes:
        p = rings[0]["pts"]
        grid[int(p[0]["x"]):int(p[2]["x"]), int(p[0]["y"]):int(p[2]["y"])] = True
    df = layer(spark, shapes).withColumn("k", F.lit("a"))
    for kw in ({}, {"max_cell_edges": 40}, {"cell_size": 128.0, "max_cell_edges": 100}):
        assert dissolve_area(df, "k", **kw).first()["union_area"] == pytest.approx(grid.sum())


def test_building_a_join_reads_statistics_only(spark):
    """No stage of a layer runs but the two small statistics aggregates."""
    left = layer(spark, [(1, poly(rect(0, 0, 4, 4)))])
    right = layer(spark, [(7, poly(rect(2, 2, 4, 4)))], "rid")
    plan = plan_grid(left, right)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        spatial_join(left, right, left_id="id", right_id="rid", plan=plan)
        assert not tracker.getJobIdsForGroup("build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_key_is_written_by_several_tasks(spark, tmp_path):
    from canopy.sources.layers_io import export_partitioned
    df = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 10 < 9, "AC").otherwise("PA").alias("uf"), "id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        export_partitioned(df, "uf", path=str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old) if old else spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "uf=AC").glob("*.parquet"))) > 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_layout_prunes_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq
    rng = random.Random(9)
    df = layer(spark, [(i, poly(rect(rng.randint(0, 4000), rng.randint(0, 4000), 3, 3))) for i in range(4000)])
    path = str(tmp_path / "grid")
    grid_layout(df, 64.0, partitions=8).write.parquet(path)
    stored = spark.read.parquet(path)
    hit = in_box(stored, 100, 100, 200, 200)
    assert "PushedFilters: [IsNotNull" in hit._jdf.queryExecution().toString()
    assert hit.count() == in_box(df, 100, 100, 200, 200).count()
    read = 0
    files = list((tmp_path / "grid").glob("*.parquet"))
    for f in files:
        m = pq.ParquetFile(f)
        names = m.schema_arrow.names
        for g in range(m.num_row_groups):
            st = {c: next(m.metadata.row_group(g).column(i).statistics for i in range(m.metadata.num_columns)
                          if m.metadata.row_group(g).column(i).path_in_schema == c) for c in ("x0", "x1") if c in names}
            read += st["x0"].min <= 200 and st["x1"].max >= 100
    assert read < len(files)


def test_layers_with_clashing_attributes(spark):
    from pyspark.sql.types import LongType, StringType, StructField
    from canopy.sources.layer_columns import layer_schema
    got = layer_schema([StructField(n, StringType()) for n in ("source", "Geometry", "srid", "id", "ID", "geometry_attr")] + [StructField("v", LongType())])
    names = [f.name for f in got.fields]
    assert len({n.lower() for n in names}) == len(names)
    assert names[0] == "source" and names[-3:] == ["geometry", "srid", "_layer"]


def test_stacked_layers_share_one_crs(spark):
    from canopy.operators.relational import concat_layers
    a = spark.createDataFrame([(1, 5880)], "id long, srid int")
    b = spark.createDataFrame([(2, 4674)], "id long, srid int")
    with pytest.raises(ValueError):
        concat_layers([a, b], [5880, 4674])
    with pytest.raises(Exception, match="srid"):
        concat_layers([a, b], [5880, 5880]).collect()
    assert concat_layers([a, a], [5880, 5880]).count() == 2


def test_left_join_of_a_side_that_is_not_repeatable(spark):
    """Left rows that come out of a shuffle in another order each time keep their own partners."""
    rng = random.Random(12)
    a = [(i % 7, [(x, y) for x, y in ((rng.randint(0, 60), rng.randint(0, 60)),)][0]) for i in range(80)]
    b = [(i, (rng.randint(0, 60), rng.randint(0, 60))) for i in range(40)]
    left = layer(spark, [(i, poly(rect(*p, 6, 6))) for i, p in a]).withColumnRenamed("id", "a")
    right = layer(spark, [(i, poly(rect(*p, 4, 4))) for i, p in b]).withColumnRenamed("id", "b")
    # another order and other places each time the plan runs
    left = left.orderBy(F.rand()).repartition(5, F.rand())
    got = spatial_join(left, right, left_id="a", right_id="b", how="left", left_cols=["x0", "y0"], right_cols=[], with_area=False)
    want = []
    for i, (x, y) in a:
        hits = [j for j, (u, v) in b if u <= x + 6 and x <= u + 4 and v <= y + 6 and y <= v + 4]
        want += [(i, x, y, j) for j in hits or [None]]
    assert sorted(map(repr, ((r.a, int(r.x0), int(r.y0), r.b) for r in got.collect()))) == sorted(map(repr, want))
