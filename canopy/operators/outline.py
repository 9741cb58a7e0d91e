"""The outline of a union as polygons, and what else needs boundaries put together over cells.

**Cells.** Each cell of :mod:`canopy.operators.dissolve` gives the boundary of what is covered inside it: chains of edges that begin and
end on the cell's sides, rings that close inside, and the stretches of its own sides that the covered area touches. Of a side only what one of its
two cells covers is boundary: stretches that both cover cancel, by a running sum along each line.

**Stitching.** Where chains end, each goes on with the one that bounds the same wedge of the area (at a point, chains sorted by angle
alternate). So every chain has one successor, and the rings are the cycles of this list. They are ranked by pointer doubling: in each
round a chain learns the smallest chain, and how far it is, within twice as many steps as before, until nothing changes; a ring of
n chains takes log2(n) + 1 rounds of one equi-join. A task never holds a key, only one ring at a time when its chains are joined up.

**Polygons.** Rings that come back to a point are parted there. A hole belongs to the smallest shell round it, told by counting
shell edges to the right of a point of it within strips of the plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrangement import bands, chains, outline, simple_loops
from ..functions.geometry import RINGS
from ..session import scratch_path
from .dissolve import CELL, coded_shapes, key_code, measured_cells

PIECES = ("k string, kind string, axis int, line double, lo double, hi double, side int, "
          "xs array<double>, ys array<double>, source array<long>")
_PIECES = pa.schema([("k", pa.string()), ("kind", pa.string()), ("axis", pa.int32()), ("line", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64()),
                     ("side", pa.int32()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("source", pa.list_(pa.int64()))])
#: Strips of the plane for containment: so many times the mean height of an edge, at most MAX_STRIPS a key.
STRIP_EDGES, MAX_STRIPS = 4, 4096


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage, in the folder that all executors share."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cell_outline(odd: bool):
    def per_cell(k: str, box: tuple, edges: np.ndarray, shape: np.ndarray, cover: int) -> pa.Table:
        o = outline(bands(edges, shape, box, odd, cover), edges, box)
        closed, opened = chains(o, box)
        rows = [{"k": k, "kind": kind, "xs": pts[:, 0], "ys": pts[:, 1], "source": source}
                for kind, found in (("ring", closed), ("chain", opened)) for pts, source in found]
        rows += [{"k": k, "kind": "side", "axis": axis, "line": line, "lo": lo, "hi": hi, "side": side} for axis, line, lo, hi, side in o.sides]
        return pa.Table.from_pylist(rows, _PIECES)

    return per_cell


def _whole_cells(covered: DataFrame) -> DataFrame:
    """The four sides of cells that are covered whole."""
    side = lambda axis, line, lo, hi, s: F.struct(F.lit(axis).alias("axis"), F.col(line).alias("line"), F.col(lo).alias("lo"),
                                                  F.col(hi).alias("hi"), F.lit(s).alias("side"))
    four = F.array(side(0, "px0", "py0", "py1", -1), side(0, "px1", "py0", "py1", 1), side(1, "py0", "px0", "px1", -1), side(1, "py1", "px0", "px1", 1))
    return covered.select("k", F.explode(four).alias("s")).select("k", "s.*")


def _side_chains(sides: DataFrame) -> DataFrame:
    """Chains of the stretches of cell sides that are covered on one side only."""
    ends = sides.select("k", "axis", "line", F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("side").alias("d")),
                                                               F.struct(F.col("hi").alias("pos"), (-F.col("side")).alias("d")))).alias("e"))
    along = W.partitionBy("k", "axis", "line").orderBy("pos")
    cut = (ends.groupBy("k", "axis", "line", "e.pos").agg(F.sum("e.d").alias("d"))
           .select("k", "axis", "line", "pos", F.sum("d").over(along).alias("net"), F.lead("pos").over(along).alias("to")).where("net <> 0"))
    # the area lies on the left: up or leftwards where it is left of or below the line
    start = F.expr("CASE WHEN (axis = 0) = (net > 0) THEN pos ELSE to END")
    end = F.expr("CASE WHEN (axis = 0) = (net > 0) THEN to ELSE pos END")
    pair = F.array(start, end)
    return cut.select("k", "axis", "line", pair.alias("run")).select(
        "k", F.when(F.col("axis") == 0, F.array("line", "line")).otherwise(F.col("run")).alias("xs"),
        F.when(F.col("axis") == 0, F.col("run")).otherwise(F.array("line", "line")).alias("ys"), F.array(F.xxhash64("axis", "line")).alias("source"))


def _followed(open_chains: DataFrame) -> DataFrame:
    """(chain, next): the chain that goes on where each ends."""
    def angle(y, x):
        return F.atan2(y, x)

    first, last = F.col("xs")[0], F.element_at("xs", -1)
    out = open_chains.select("k", "chain", first.alias("x"), F.col("ys")[0].alias("y"), F.lit(0).alias("kind"),
                             angle(F.col("ys")[1] - F.col("ys")[0], F.col("xs")[1] - F.col("xs")[0]).alias("turn"))
    back = open_chains.select("k", "chain", last.alias("x"), F.element_at("ys", -1).alias("y"), F.lit(1).alias("kind"),
                              angle(F.element_at("ys", -2) - F.element_at("ys", -1), F.element_at("xs", -2) - F.element_at("xs", -1)).alias("turn"))
    point = ["k", "x", "y"]
    ways = out.unionByName(back).withColumns({"x": F.col("x") + F.lit(0.0), "y": F.col("y") + F.lit(0.0)})  # one zero
    about = W.partitionBy(*point).orderBy("turn", "kind")
    ways = ways.withColumns({"nth": F.row_number().over(W.partitionBy(*point, "kind").orderBy("turn", "chain")) - 1,
                             "shift": F.first("kind").over(about), "outs": F.sum(1 - F.col("kind")).over(W.partitionBy(*point))})
    ins = ways.where("kind = 1 AND outs > 0").select(*point, F.col("chain").alias("from"), F.expr("pmod(nth - shift, outs)").alias("nth"))
    outs = ways.where("kind = 0").select(*point, F.col("chain").alias("to"), F.col("nth").cast("long").alias("nth"))
    return ins.join(outs, [*point, "nth"]).select(F.col("from").alias("chain"), F.col("to").alias("next"))


def ranked_cycles(links: DataFrame) -> DataFrame:
    """(chain, ring, ahead) of a list (chain, next) made of cycles: the cycle's smallest chain, and the steps to it.

    Pointer doubling: round r knows the smallest of the next 2^r chains. A cycle's chains all agree once
    a round changes nothing, since then windows of one length, shifted by that length, have one minimum.
    """
    now = _written(links.select("chain", F.col("next").alias("hop"), F.col("chain").alias("ring"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("moved")), "links")
    steps = 1
    while True:
        far = now.select(F.col("chain").alias("hop"), F.col("hop").alias("_hop"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        now = _written(now.join(far, "hop").select(
            "chain", F.col("_hop").alias("hop"), F.least("ring", "_ring").alias("ring"),
            F.when(less, F.col("_ahead") + steps).otherwise(F.col("ahead")).alias("ahead"), less.alias("moved")), "links")
        if now.where("moved").isEmpty():
            return now.select("chain", "ring", "ahead")
        steps *= 2


def _loops(rings: DataFrame) -> DataFrame:
    """(k, xs, ys, area): the simple rings of closed walks (k, xs, ys, source), first point repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, found = [], []
            for i in range(b.num_rows):
                xs, ys, source = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                own = simple_loops(np.column_stack([xs, ys]), source)
                found += own
                k += [b.column(0)[i].as_py()] * len(own)
            area = [float(((q[:-1, 0] - q[0, 0]) * (q[1:, 1] - q[0, 1]) - (q[1:, 0] - q[0, 0]) * (q[:-1, 1] - q[0, 1])).sum() / 2) for q in found]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([q[:, 0] for q in found], pa.list_(pa.float64())),
                                              pa.array([q[:, 1] for q in found], pa.list_(pa.float64())), pa.array(area, pa.float64())],
                                             names=["k", "xs", "ys", "area"])

    return rings.select("k", "xs", "ys", "source").mapInArrow(run, "k string, xs array<double>, ys array<double>, area double").where("area <> 0")


def ring_edges(rings: DataFrame) -> DataFrame:
    """(k, ring, ax, ay, bx, by): a row per edge."""
    e = F.expr("transform(sequence(0, size(xs) - 2), i -> struct(xs[i] AS ax, ys[i] AS ay, xs[i + 1] AS bx, ys[i + 1] AS by))")
    return rings.select("k", "ring", F.explode(e).alias("e")).select("k", "ring", "e.*")


def containing_rings(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(point, ring): the rings (k, ring, ax, ay, bx, by) that hold a point (k, point, x, y) of the same k.

    A ring holds a point if an odd number of its edges lie to the point's right. Points and edges meet in horizontal strips.
    """
    level = edges.where("ay <> by")
    strips = level.groupBy("k").agg(
        F.min(F.least("ay", "by")).alias("y0"),
        F.greatest(F.avg(F.abs(F.col("ay") - F.col("by"))) * STRIP_EDGES,
                   (F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))) / MAX_STRIPS).alias("tall"))
    placed = points.join(strips, "k").withColumn("strip", F.floor((F.col("y") - F.col("y0")) / F.col("tall")))
    dealt = level.join(strips.withColumnRenamed("k", "sk"), F.col("k") == F.col("sk")).withColumn(
        "strip", F.explode(F.expr("sequence(floor((least(ay, by) - y0) / tall), floor((greatest(ay, by) - y0) / tall))")))
    right = F.expr("(ay > y) <> (by > y) AND x < ax + (y - ay) * ((bx - ax) / (by - ay))")
    return (placed.select("k", "strip", "point", "x", "y").join(dealt.select("k", "strip", "ring", "ax", "ay", "bx", "by"), ["k", "strip"]).where(right)
            .groupBy("point", "ring").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("point", "ring"))


def _polygons(loops: DataFrame) -> DataFrame:
    """(k, area, rings): a row per polygon, its shell first (part 0), then its holes."""
    rings = _written(loops.withColumn("ring", F.monotonically_increasing_id()), "rings")
    shells, holes = rings.where("area > 0"), rings.where("area < 0")
    # a point of the hole's first edge, off its middle, where another ring is least likely to touch it
    points = holes.select("k", F.col("ring").alias("point"), F.expr("xs[0] + 0.41421356 * (xs[1] - xs[0])").alias("x"),
                          F.expr("ys[0] + 0.41421356 * (ys[1] - ys[0])").alias("y"))
    sizes = shells.select(F.col("ring").alias("shell"), F.col("area").alias("size"))
    held = (containing_rings(points, ring_edges(shells)).withColumnRenamed("ring", "shell").join(sizes, "shell")
            .groupBy("point").agg(F.min_by("shell", F.struct("size", "shell")).alias("shell")))
    pts = F.expr("transform(sequence(0, size(xs) - 1), i -> named_struct('x', xs[i], 'y', ys[i]))")
    inner = holes.select(F.col("ring").alias("point"), "area", F.struct(F.lit(0).alias("part"), F.lit(True).alias("hole"), pts.alias("pts")).alias("r"))
    own = (inner.join(held, "point").groupBy("shell").agg(
        F.sum("area").alias("less"), F.transform(F.array_sort(F.collect_list(F.struct("point", "r"))), lambda v: v["r"]).alias("inner")))
    shell = F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("hole"), pts.alias("pts")))
    return (shells.withColumnRenamed("ring", "shell").join(own, "shell", "left")
            .select("k", (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"),
                    F.concat(shell, F.coalesce("inner", F.array().cast(RINGS))).alias("rings")))


def outlined(shapes: DataFrame, odd: bool = False, layer: DataFrame | None = None, **cells) -> DataFrame:
    """(k, area, rings): the polygons of what the shapes (k, edges, x0, y0, x1, y1) of each k cover, a row each.

    Polygons of a key don't overlap and touch in points only. ``odd`` takes the area that an odd number of all edges' rings wind
    round, else the union of the shapes. ``cells`` are passed to :func:`measured_cells`.
    """
    found, covered = measured_cells(shapes, _cell_outline(odd), PIECES, layer=shapes if layer is None else layer, odd=odd, **cells)
    found = _written(found, "pieces")
    sides = found.where("kind = 'side'").select("k", "axis", "line", "lo", "hi", "side")
    if covered is not None:
        sides = sides.unionByName(_whole_cells(covered))
    open_chains = found.where("kind = 'chain'").select("k", "xs", "ys", "source").unionByName(_side_chains(sides).select("k", "xs", "ys", "source"))
    open_chains = _written(open_chains.withColumn("chain", F.monotonically_increasing_id()), "chains")
    ranks = ranked_cycles(_followed(open_chains))
    # from the smallest chain on: it is 0 ahead of itself, the one after it farthest
    place = F.when(F.col("ahead") == 0, F.lit(-1)).otherwise(F.lit(0)).alias("head")
    parts = open_chains.join(ranks, "chain").select("k", "ring", F.struct(place, (-F.col("ahead")).alias("ahead"), "xs", "ys", "source").alias("p"))
    walk = parts.groupBy("k", "ring").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # a chain's last point is the next one's first
    cut = (lambda c: F.flatten(F.transform("p", lambda v: F.slice(v[c], 1, F.size(v[c]) - 1))))
    closed = (lambda c: F.concat(cut(c), F.array(F.col("p")[0][c][0])))
    stitched = walk.select("k", closed("xs").alias("xs"), closed("ys").alias("ys"), F.flatten(F.transform("p", lambda v: v["source"])).alias("source"))
    return _polygons(_loops(found.where("kind = 'ring'").select("k", "xs", "ys", "source").unionByName(stitched)))


def dissolve_outline(layer: DataFrame, key: str, **cells) -> DataFrame:
    """(key, area, rings): the union of each key's shapes as polygons, a row per polygon. NULL is a key like any other."""
    cells = {"max_cell_edges": 2000, **cells}
    found = outlined(coded_shapes(layer, key), layer=layer, **cells)
    names = layer.select(F.col(key).alias("_value")).distinct().withColumn("_k", key_code(F.col("_value")))
    return found.join(names, F.col("k") == F.col("_k")).select(F.col("_value").alias(key), "area", "rings")
