"""G01-G03 for shapes of any size: validity, reason and repair of one shape spread over many tasks.

:mod:`canopy.functions.validity` looks at a shape in one task, in time that
grows with the pairs of its edges that come near each other. Here a shape of more than ``max_points``
vertices becomes rows of edges, read out of it in one pass, and

- edges are dealt to cells of a grid of the shape's own, laid along its prevailing direction and as fine in each direction as its edges
  allow without being dealt to many cells; each cell reports the first pair of its edges that meet as they must not, and where rings touch;
- rings are cut where they touch others, one point of every stretch is tested, and ring nesting comes from the edges to the right of
  each point, counted per ring (:func:`containing_rings`);
- the repair is the even-odd outline of all edges (:mod:`canopy.operators.outline`), whose rings are put together over cells.

The verdicts, reasons and points are those of the small-shape path, which the layer's other rows take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf

from ..functions.validity import (VALID_TEXT, _circle_of_rings, _segments, _touching_points, closed_edges, faults, make_valid, pair_chunks,
                                  tidy_rings, validity)
from ..functions.geometry import EDGES, RINGS
from ..functions.wkb import _arrow_rows
from .dissolve import key_code
from .outline import _written, containing_rings, outlined
from .spatial_join import spread

#: Shapes of more vertices are spread over tasks.
MAX_POINTS = 20_000
#: Edges that a cell should hold, and rows that dealing out may make of an edge on average.
CELL_EDGES, COPIES = 2000, 8

_EDGES = ("shape long, fault string, x double, y double, cell long, ring int, part int, hole boolean, pos int, n int, place long, "
          "ax double, ay double, bx double, by double")
_EDGE_SCHEMA = pa.schema([("shape", pa.int64()), ("fault", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("cell", pa.int64()),
                          ("ring", pa.int32()), ("part", pa.int32()), ("hole", pa.bool_()), ("pos", pa.int32()), ("n", pa.int32()), ("place", pa.int64()),
                          *[(c, pa.float64()) for c in ("ax", "ay", "bx", "by")]])
_FOUND = "shape long, u long, v long, x double, y double, ring int, part int, pos int, t double"
_FOUND_SCHEMA = pa.schema([("shape", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("ring", pa.int32()),
                           ("part", pa.int32()), ("pos", pa.int32()), ("t", pa.float64())])
VERDICT = "shape long, valid boolean, reason string, x double, y double"


def points(rings: str = "rings"):
    """Vertices of a rings column, 0 for NULL."""
    return F.coalesce(F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r["pts"])), F.lit(0))


def grid_cells(ax, ay, bx, by, per_cell: int = CELL_EDGES, copies: float = COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(edge, cell) rows: every edge in all cells its box, a little widened, touches. Edges that meet share a cell."""
    # prevailing direction of the edges, whichever way they run
    dx, dy = bx - ax, by - ay
    turn = np.arctan2((2 * dx * dy).sum(), (dx * dx - dy * dy).sum()) / 2
    c, s = np.cos(turn), np.sin(turn)
    axes = []
    for p, q in ((c, s), (-s, c)):
        a, b = ax * p + ay * q, bx * p + by * q
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        near = 64 * np.spacing(max(1.0, float(np.abs(ax).max()) + float(np.abs(ay).max()), float(np.abs(bx).max()) + float(np.abs(by).max())))
        lo, hi = lo - near, hi + near
        start = lo.min()
        axes.append(((lo - start) / (hi.max() - start), (hi - start) / (hi.max() - start)))
    su, sv = (max(float((hi - lo).sum()), 1e-12) for lo, hi in axes)
    wanted = max(1.0, len(ax) / per_cell)
    while True:
        nu = int(np.clip(round(np.sqrt(wanted * sv / su)), 1, max(1, wanted)))
        nv = max(1, int(wanted // nu))
        spans = [(np.minimum((lo * n).astype(np.int64), n - 1), np.minimum((hi * n).astype(np.int64), n - 1)) for (lo, hi), n in zip(axes, (nu, nv))]
        wide, tall = (b - a + 1 for a, b in spans)
        rows = wide * tall
        if wanted <= 1 or rows.sum() <= copies * len(ax):
            break
        wanted /= 2
    edge = np.repeat(np.arange(len(ax)), rows)
    nth = np.arange(len(edge)) - np.repeat(np.cumsum(rows) - rows, rows)
    return edge, (spans[0][0][edge] + nth % wide[edge]) * nv + spans[1][0][edge] + nth // wide[edge]


def _dealt(shape: int, rings: list) -> Iterator[pa.RecordBatch]:
    """A shape's edges with their cells, or the fault that any of its rings shows by itself."""
    clean, fault = tidy_rings(rings)
    if fault is not None:
        reason, x, y = fault
        yield pa.RecordBatch.from_pylist([{"shape": shape, "fault": reason, "x": x, "y": y}], _EDGE_SCHEMA)
        return
    ax, ay, bx, by, ring, pos, n = _segments(clean)
    place = np.empty(len(ax), np.int64)
    place[np.argsort(np.minimum(ax, bx), kind="stable")] = np.arange(len(ax))
    part, hole = np.array([r[0] for r in clean]), np.array([bool(r[1]) for r in clean])
    edge, cell = grid_cells(ax, ay, bx, by)
    for at in range(0, len(edge), 1 << 16):
        e, c = edge[at:at + (1 << 16)], cell[at:at + (1 << 16)]
        none = pa.nulls(len(e), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(e), shape)), pa.nulls(len(e), pa.string()), none, none, pa.array(c), pa.array(ring[e].astype(np.int32)),
             pa.array(part[ring[e]].astype(np.int32)), pa.array(hole[ring[e]]), pa.array(pos[e].astype(np.int32)), pa.array(n[e].astype(np.int32)),
             pa.array(place[e]), *[pa.array(v[e]) for v in (ax, ay, bx, by)]], schema=_EDGE_SCHEMA)


def dealt_edges(shapes: DataFrame) -> DataFrame:
    """Rows of ``_EDGES`` of (shape, rings): an edge in each of its cells; a shape with a faulty ring is one row that names the fault."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                rings = next(iter(_arrow_rows(row.column(1))))
                if rings:
                    yield from _dealt(row.column(0)[0].as_py(), rings)

    return shapes.select("shape", "rings").mapInArrow(run, _EDGES)


def _cell_contacts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The first fault among a cell's edges (u, v, x, y), or where its rings touch (ring, part, pos, t, x, y)."""
    shape = key[0].as_py()
    ax, ay, bx, by = (table[c].to_numpy() for c in ("ax", "ay", "bx", "by"))
    ring, part, pos, n, place = (table[c].to_numpy() for c in ("ring", "part", "pos", "n", "place"))
    order = np.lexsort((pos, ring))  # the edge that comes first in the shape is the first of a pair
    ax, ay, bx, by, ring, part, pos, n, place = (v[order] for v in (ax, ay, bx, by, ring, part, pos, n, place))
    first, touched = None, []
    for i, j in pair_chunks(ax, ay, bx, by):
        i, j = np.minimum(i, j), np.maximum(i, j)
        bad, other, px, py = faults(ax, ay, bx, by, ring, pos, n, i, j)
        if bad.any():
            u, v = np.minimum(place[i], place[j])[bad], np.maximum(place[i], place[j])[bad]
            k = np.lexsort((v, u))[0]
            found = (int(u[k]), int(v[k]), float(px[bad][k]), float(py[bad][k]))
            first = found if first is None else min(first, found)
        elif first is None and other.any():
            x, y = _touching_points(ax, ay, bx, by, i[other], j[other])
            for e in (i[other], j[other]):
                long_x = np.abs(bx[e] - ax[e]) >= np.abs(by[e] - ay[e])
                t = np.where(long_x, x - ax[e], y - ay[e]) / np.where(long_x, bx[e] - ax[e], by[e] - ay[e])
                touched.append(np.column_stack([ring[e], part[e], pos[e], t, x, y]))
    if first is not None:
        return pa.Table.from_pylist([dict(zip(("shape", "u", "v", "x", "y"), (shape, *first)))], _FOUND_SCHEMA)
    if not touched:
        return _FOUND_SCHEMA.empty_table()
    rows = np.unique(np.concatenate(touched), axis=0)
    return pa.Table.from_arrays([pa.array(np.full(len(rows), shape)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()),
                                 pa.array(rows[:, 4]), pa.array(rows[:, 5]), *[pa.array(rows[:, c].astype(np.int32)) for c in (0, 1, 2)],
                                 pa.array(rows[:, 3])], schema=_FOUND_SCHEMA)


def _circles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The point at which rings of one part close a circle, the first part that has one."""
    by_part: dict[int, set] = {}
    for r in table.to_pylist():
        by_part.setdefault(r["part"], set()).add((r["ring"], (r["x"], r["y"])))
    for part in sorted(by_part):
        point = _circle_of_rings(by_part[part])
        if point is not None:
            return pa.table({"shape": [key[0].as_py()], "x": [point[0]], "y": [point[1]]})
    return pa.table({"shape": pa.array([], pa.int64()), "x": pa.array([], pa.float64()), "y": pa.array([], pa.float64())})


def _nesting(edges: DataFrame, touches: DataFrame) -> DataFrame:
    """(shape, rule, key, reason, x, y): rings that lie in or outside others as they must not."""
    rings = edges.where("pos = 0").select("shape", "ring", "part", "hole", F.col("ax").alias("rx"), F.col("ay").alias("ry"))
    several = rings.groupBy("shape").agg(F.count("*").alias("rings")).where("rings > 1").select("shape")
    edges = edges.join(several, "shape", "left_semi")
    along = W.partitionBy("shape", "ring", "pos").orderBy("t")
    touched = touches.select("shape", "ring", "pos", "t").distinct()
    gaps = (touched.select("shape", "ring", "pos", F.lag("t", 1, 0.0).over(along).alias("t0"), F.col("t").alias("t1"))
            .unionByName(touched.groupBy("shape", "ring", "pos").agg(F.max("t").alias("t0")).withColumn("t1", F.lit(1.0))).where("t1 > t0")
            .select("shape", "ring", "pos", ((F.col("t0") + F.col("t1")) / 2).alias("t")))
    # a point of every stretch between two touches; of a ring that touches none one point, off the middle of its first edge
    alone = edges.where("pos = 0").join(touched.select("shape", "ring").distinct(), ["shape", "ring"], "left_anti").select(
        "shape", "ring", "pos", F.lit(0.41421356).alias("t"))
    at = (gaps.unionByName(alone).join(edges, ["shape", "ring", "pos"])
          .select(F.col("shape").cast("string").alias("k"), F.struct("shape", "ring", "pos", "t").alias("point"),
                  F.expr("ax + t * (bx - ax)").alias("x"), F.expr("ay + t * (by - ay)").alias("y")))
    at = _written(at, "points")
    held = containing_rings(at, edges.select(F.col("shape").cast("string").alias("k"), F.col("ring").alias("ring"), "ax", "ay", "bx", "by"))
    counts = at.groupBy("point.shape", "point.ring").agg(F.count("*").alias("tests"))
    inside = (held.select("point.shape", F.col("point.ring").alias("a"), F.col("ring").alias("b")).where("a <> b")
              .groupBy("shape", "a", "b").agg(F.count("*").alias("inner")))
    one = rings.join(counts, ["shape", "ring"]).select("shape", F.col("ring").alias("a"), F.col("part").alias("a_part"), F.col("hole").alias("a_hole"), "tests", "rx", "ry")
    two = rings.select("shape", F.col("ring").alias("b"), F.col("part").alias("b_part"), F.col("hole").alias("b_hole"))
    pairs = _written(inside.join(one, ["shape", "a"]).join(two, ["shape", "b"]), "nesting")
    cols = ["shape", "rule", "key", "reason", "x", "y"]

    def rule(df: DataFrame, n: int, key: list, reason) -> DataFrame:
        return df.select("shape", F.lit(n).alias("rule"), F.array(*[k.cast("int") for k in key]).alias("key"), reason.alias("reason"),
                         F.col("rx").alias("x"), F.col("ry").alias("y")).select(*cols)

    # the shell of a part is its last ring that is none of its holes
    shells = two.where("NOT b_hole").groupBy("shape", "b_part").agg(F.max("b").alias("b"))
    own = one.where("a_hole").withColumnRenamed("a_part", "b_part").join(shells, ["shape", "b_part"])
    out = own.join(pairs.select("shape", "a", "b", "inner"), ["shape", "a", "b"], "left").where(F.coalesce("inner", F.lit(0)) < F.col("tests"))
    outside = rule(out, 1, [F.col("a")], F.lit("Hole lies outside shell"))
    nested = rule(pairs.where("a_hole AND b_hole AND a_part = b_part"), 2, [F.greatest("a", "b"), F.least("a", "b"), (F.col("a") < F.col("b"))],
                  F.lit("Holes are nested"))
    within_hole = (pairs.where("NOT a_hole AND b_hole AND inner = tests AND a_part <> b_part").select("shape", "a", "b_part").distinct())
    over = pairs.where("NOT a_hole AND NOT b_hole AND a_part <> b_part").join(within_hole, ["shape", "a", "b_part"], "left_anti")
    shell = rule(over, 3, [F.col("a_part"), F.col("b_part")], F.when(F.col("inner") < F.col("tests"), "Self-intersection").otherwise("Nested shells"))
    return outside.unionByName(nested).unionByName(shell)


def large_validity(shapes: DataFrame) -> DataFrame:
    """``VERDICT`` of every row of (shape, rings); ``shape`` must be unique. NULL rings give a NULL verdict, empty ones a valid one."""
    dealt = _written(dealt_edges(shapes), "edges")
    faulty = dealt.where("fault IS NOT NULL").select("shape", F.lit(0).alias("rule"), F.array(F.lit(0)).alias("key"), F.col("fault").alias("reason"), "x", "y")
    dealt = dealt.where("fault IS NULL")
    cols = ["shape", "cell", "ring", "part", "pos", "n", "place", "ax", "ay", "bx", "by"]
    found = _written(dealt.select(*cols).groupBy("shape", "cell").applyInArrow(_cell_contacts, _FOUND), "contacts")
    crossing = (found.where("u IS NOT NULL").groupBy("shape").agg(F.min(F.struct("u", "v", "x", "y")).alias("f"))
                .select("shape", F.lit(0).alias("rule"), F.array(F.lit(0)).alias("key"), F.lit("Self-intersection").alias("reason"), "f.x", "f.y"))
    sound = found.where("u IS NULL").join(crossing.select("shape"), "shape", "left_anti")
    # an edge once, in the first of its cells
    edges = (dealt.join(crossing.select("shape"), "shape", "left_anti").groupBy("shape", "ring", "pos")
             .agg(F.first("part").alias("part"), F.first("hole").alias("hole"), *[F.first(c).alias(c) for c in ("ax", "ay", "bx", "by")]))
    several = dealt.where("ring > 0").select("shape").distinct()
    edges = _written(edges.join(several, "shape", "left_semi"), "ring-edges")
    nesting = _nesting(edges, sound)
    shared = sound.select("shape", "part", "ring", "x", "y").distinct()
    alike = W.partitionBy("shape", "part", "x", "y")
    circles = (shared.withColumn("_n", F.count("*").over(alike)).where("_n > 1").select("shape", "part", "ring", "x", "y").groupBy("shape")
               .applyInArrow(_circles, "shape long, x double, y double")
               .select("shape", F.lit(4).alias("rule"), F.array(F.lit(0)).alias("key"), F.lit("Interior is disconnected").alias("reason"), "x", "y"))
    worst = (faulty.unionByName(crossing).unionByName(nesting).unionByName(circles)
             .groupBy("shape").agg(F.min(F.struct("rule", "key", "reason", "x", "y")).alias("f")))
    plain = F.col("f").isNull()
    return (shapes.select("shape", F.col("rings").isNull().alias("_null")).join(worst, "shape", "left")
            .select("shape", F.when(~F.col("_null"), plain).alias("valid"),
                    F.when(~F.col("_null"), F.coalesce("f.reason", F.lit(VALID_TEXT))).alias("reason"), "f.x", "f.y"))


_BOXED = T.StructType([T.StructField("edges", EDGES), *[T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]])


@arrow_udf(_BOXED)
def _closed_edges(rings: pa.Array) -> pa.Array:
    """All edges of all rings, non-finite and repeated vertices left out, rings closed; and their box."""
    out = []
    for row in _arrow_rows(rings):
        e = closed_edges(row or [])
        box = (float(e[:, [0, 2]].min()), float(e[:, [1, 3]].min()), float(e[:, [0, 2]].max()), float(e[:, [1, 3]].max())) if len(e) else (None,) * 4
        out.append((e, box))
    count = np.array([len(e) for e, _ in out])
    flat = np.concatenate([e for e, _ in out]) if out else np.zeros((0, 4))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(4)], names=["ax", "ay", "bx", "by"]))
    return pa.StructArray.from_arrays([lists, *[pa.array([b[c] for _, b in out], pa.float64()) for c in range(4)]], names=["edges", "x0", "y0", "x1", "y1"])


_closed_edges = _closed_edges.asNondeterministic()


def even_odd(shapes: DataFrame, **cells) -> DataFrame:
    """(shape, area, rings): what an odd number of a shape's rings wind round, as one multipolygon a row; (shape, rings) in.

    Shapes without such area are left out.
    """
    edges = _written(shapes.select(key_code(F.col("shape")).alias("k"), "shape", _closed_edges("rings").alias("e")).select("k", "shape", "e.*"), "odd-edges")
    found = outlined(edges.select("k", "edges", "x0", "y0", "x1", "y1"), odd=True, **{"max_cell_edges": 2000, **cells})
    numbered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("area", "rings"))), lambda p, i: F.transform(
        p["rings"], lambda r: F.struct(i.cast("int").alias("part"), r["hole"].alias("hole"), r["pts"].alias("pts")))))
    return (found.groupBy("k").agg(F.sum("area").alias("area"), numbered.cast(RINGS).alias("rings"))
            .join(edges.select("k", "shape"), "k").select("shape", "area", "rings"))


def _split(layer: DataFrame, rings: str, max_points: int) -> tuple[DataFrame, DataFrame | None]:
    """(small rows, large rows with a number ``_shape``, written, or None if there are none)."""
    size = points(rings)
    most = layer.agg(F.max(size)).first()[0] or 0
    if most <= max_points:
        return layer, None
    return layer.where(size <= max_points), _written(spread(layer.where(size > max_points)).withColumn("_shape", F.monotonically_increasing_id()), "large")


def with_validity(layer: DataFrame, rings: str = "rings", name: str = "validity", max_points: int = MAX_POINTS) -> DataFrame:
    """``layer`` with a struct (valid, reason, x, y), NULL for NULL geometry; shapes of more than ``max_points`` vertices by many tasks."""
    small, large = _split(layer, rings, max_points)
    out = small.withColumn(name, validity(rings))
    if large is None:
        return out
    found = large_validity(large.select(F.col("_shape").alias("shape"), F.col(rings).alias("rings")))
    verdict = found.select(F.col("shape").alias("_shape"), F.struct("valid", "reason", "x", "y").alias(name))
    return out.unionByName(large.join(verdict, "_shape").drop("_shape").select(*out.columns))


def repaired(layer: DataFrame, rings: str = "rings", max_points: int = MAX_POINTS) -> DataFrame:
    """``layer`` with every invalid shape repaired by the even-odd rule (NULL stays NULL), of whatever size."""
    small, large = _split(layer, rings, max_points)
    out = small.withColumn(rings, make_valid(rings))
    if large is None:
        return out
    shapes = large.select(F.col("_shape").alias("shape"), F.col(rings).alias("rings"))
    bad = _written(large_validity(shapes).where("NOT valid").select("shape"), "invalid")
    fixed = even_odd(shapes.join(bad, "shape", "left_semi")).select(F.col("shape").alias("_shape"), F.col("rings").alias("_fixed"))
    marked = large.join(bad.select(F.col("shape").alias("_shape"), F.lit(True).alias("_bad")), "_shape", "left").join(fixed, "_shape", "left")
    new = F.when(F.col("_bad"), F.coalesce("_fixed", F.array().cast(RINGS))).otherwise(F.col(rings))
    return out.unionByName(marked.withColumn(rings, new).select(*out.columns))
