"""Dissolve — union area per key, without double counting overlaps.

The plane is cut into square cells, coarse ones first. A shape goes to each
cell its box touches as the edges that pass through the cell, and what lies below
it only as the net cover of the cell's bottom. A shape that covers a cell whole
is one row without edges, and settles the cell. A cell that
holds too many edges or shapes is cut into ``split x split`` sub-cells, those again, each
round on what is still too full. So neither a large shape among small ones
nor a crowded place is dealt to more cells than it needs, and a key is never gathered in one
task; shapes with very many edges are cut into pieces first.

One grouped-map task per ``(key, cell)`` measures what is covered inside that cell
(:mod:`canopy.functions.arrangement`), and the per-cell sums are
pre-aggregated before the final (small) group by key. NULL is a key like any
other, and a key without any area gets 0. The same cells give the outline of
the union (:mod:`canopy.operators.outline`).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.arrangement import bands, net_cover
from ..functions.geometry import EDGES
from ..session import scratch_path
from .subdivide import subdivide

_CLIPPED = T.StructType([T.StructField("edges", EDGES), T.StructField("inner", T.IntegerType()), T.StructField("active", T.DoubleType()),
                         T.StructField("cover", T.IntegerType())])
_EDGE_NAMES = ("ax", "ay", "bx", "by")

#: Rounds of cutting full cells; ``split`` to this power is the finest grid.
MAX_ROUNDS = 8
#: Shapes of more edges are cut into pieces first.
PIECE_EDGES = 1024
#: A cell of more edges than ``max_cell_edges`` is cut if edges times the edges a slab holds on average exceeds WORK times that bound,
#: or if there are MOST times as many.
WORK, MOST = 25, 16
#: The first cells are at most so many times wider than most shapes.
COARSEST = 64


def edge_arrays(edges: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((n, 4) edges of all rows, number of edges per row) of a column of edge lists."""
    edges = edges.combine_chunks() if isinstance(edges, pa.ChunkedArray) else edges
    count = np.diff(edges.offsets.to_numpy())
    v = edges.flatten()
    return np.column_stack([v.field(k).to_numpy(zero_copy_only=False) for k in _EDGE_NAMES]).reshape(-1, 4), count


@arrow_udf(_CLIPPED)
def _clip_udf(edges: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    """What a box needs of a shape: the edges through it, the net cover of its bottom, or the cover of the whole box."""
    e, count = edge_arrays(edges)
    rows = len(count)
    row = np.repeat(np.arange(rows), count)
    left, low, right, top = (c.to_numpy(zero_copy_only=False) for c in (x0, y0, x1, y1))
    a, b = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    passes = (b > left[row]) & (a < right[row]) & (a != b)
    above = np.minimum(e[:, 1], e[:, 3]) >= top[row]
    below = np.maximum(e[:, 1], e[:, 3]) <= low[row]
    inner, shadow = passes & ~above & ~below, passes & below
    own = row[shadow]
    at, start, end, net = net_cover(own, np.maximum(a[shadow], left[own]), np.minimum(b[shadow], right[own]),
                                    np.where(e[shadow, 0] < e[shadow, 2], 1, -1))
    inners = np.bincount(row[inner], minlength=rows)
    whole = (inners[at] == 0) & (start == left[at]) & (end == right[at])
    cover = np.zeros(rows, np.int32)
    cover[at[whole]] = net[whole]
    at, start, end, net = (v[~whole] for v in (at, start, end, net))
    times = np.abs(net)
    at, start, end, way = (np.repeat(v, times) for v in (at, start, end, net > 0))
    floor = np.column_stack([np.where(way, start, end), low[at], np.where(way, end, start), low[at]]).reshape(-1, 4)
    out, of = np.concatenate([e[inner], floor]), np.concatenate([row[inner], at])
    order = np.argsort(of, kind="stable")
    out = out[order]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)),
                                     pa.StructArray.from_arrays([pa.array(out[:, c]) for c in range(4)], names=list(_EDGE_NAMES)))
    held = inners + np.bincount(at, minlength=rows)
    within = (np.minimum(b, right[row]) - np.maximum(a, left[row])) / (right - left)[row]
    active = np.bincount(row[inner], within[inner], minlength=rows)
    return pa.StructArray.from_arrays([lists, pa.array(held.astype(np.int32)), pa.array(active), pa.array(cover)], names=list(_CLIPPED.names))


_clip_udf = _clip_udf.asNondeterministic()  # a pure function, never to be evaluated twice

CELL = ["k", "cx", "cy", "px0", "py0", "px1", "py1"]


def key_code(key: Column) -> Column:
    """A key as a string that is never null, different for different keys."""
    return F.when(key.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), key.cast("string")))


def _cut_cells(cells: DataFrame, size: float) -> DataFrame:
    """(k, edges, box) rows dealt to the cells of width ``size`` (within their parent cell), clipped."""
    dealt = (cells
             .withColumn("cx", F.explode(F.expr(f"sequence(greatest(floor(x0 / {size!r}D), floor(px0 / {size!r}D)),"
                                                f" least(floor(x1 / {size!r}D), ceil(px1 / {size!r}D) - 1))")))
             .withColumn("cy", F.explode(F.expr(f"sequence(greatest(floor(y0 / {size!r}D), floor(py0 / {size!r}D)),"
                                                f" least(floor(y1 / {size!r}D), ceil(py1 / {size!r}D) - 1))"))))
    dealt = (dealt.withColumn("px0", F.col("cx") * F.lit(size)).withColumn("px1", (F.col("cx") + 1) * F.lit(size))
             .withColumn("py0", F.col("cy") * F.lit(size)).withColumn("py1", (F.col("cy") + 1) * F.lit(size)))
    # a shape that covers the parent whole covers this cell too
    clipped = dealt.withColumn("_c", _clip_udf("edges", "px0", "py0", "px1", "py1"))
    return (clipped.select("k", F.col("_c.edges").alias("edges"), F.col("_c.inner").alias("inner"), F.col("_c.active").alias("active"), (F.col("cover") + F.col("_c.cover")).alias("cover"),
                           "x0", "y0", "x1", "y1", "cx", "cy", "px0", "py0", "px1", "py1")
            .where((F.size("edges") > 0) | (F.col("cover") != 0)))


def first_cells(layer: DataFrame) -> tuple[float, int]:
    """(width of the first cells, edges of the largest shape): a power of two that holds the largest shape, at most ``COARSEST`` times most shapes."""
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    med, most, edges = layer.select(F.percentile_approx(span, 0.5, 1000), F.max(span), F.max(F.size("edges"))).first()
    med, most = max(med or 1.0, 1e-9), max(most or 1.0, 1e-9)
    return float(2 ** math.ceil(math.log2(min(max(most, 4 * med), COARSEST * med)))), edges or 0


def measured_cells(shapes: DataFrame, per_cell: Callable[[str, tuple, np.ndarray, np.ndarray, int], pa.Table], schema: str, *, layer: DataFrame, odd: bool = False,
                   cell_size: float | None = None, max_cell_edges: int = 4000, max_group_rows: int = 1000, split: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``per_cell`` over all cells, cells that one shape covers whole as CELL, or None).

    ``shapes`` are (k, edges, x0, y0, x1, y1) with a non-null ``k``, ``layer`` what they were made from. ``per_cell`` gets the key, the box, the edges with the number of
    their shape, and how many times shapes cover the box beside them. Cells are not covered whole where ``odd``.
    """
    spark = shapes.sparkSession
    size, most = first_cells(layer)
    size = float(cell_size) if cell_size is not None else size
    shapes = shapes.where(F.col("x0").isNotNull())
    if most > PIECE_EDGES:
        shapes = subdivide(shapes, PIECE_EDGES)
        size = size if cell_size is not None else first_cells(shapes)[0]
    todo = shapes.select("*", F.lit(0).alias("cover"), F.col("x0").alias("px0"), F.col("y0").alias("py0"),
                         (F.floor(F.col("x1") / size) * size + size).alias("px1"), (F.floor(F.col("y1") / size) * size + size).alias("py1"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        box = tuple(float(table[c][0].as_py()) for c in ("px0", "py0", "px1", "py1"))
        e, count = edge_arrays(table["edges"])
        return per_cell(key[0].as_py(), box, e, np.repeat(np.arange(len(count)), count), int(sum(table["cover"].to_pylist())))

    done = covered = None
    for r in range(MAX_ROUNDS):
        path = scratch_path(spark, "dissolve")
        _cut_cells(todo, size).write.parquet(path)
        cut = spark.read.parquet(path)
        held = cut.groupBy(*CELL).agg(F.sum("inner").alias("held"), F.sum("active").alias("active"), F.count_if(F.col("inner") > 0).alias("rows"), F.count_if(F.col("cover") != 0).alias("covers"))
        whole = held.where("covers > 0") if not odd else held.where("false")
        crowded = (F.col("held") > max_cell_edges) & ((F.col("held") * F.col("active") > WORK * max_cell_edges) | (F.col("held") > MOST * max_cell_edges))
        full = held.where((crowded | (F.col("rows") > max_group_rows)) & (F.lit(odd) | (F.col("covers") == 0)))
        at = ["k", "cx", "cy"]
        final = r == MAX_ROUNDS - 1 or full.isEmpty()
        settled = whole if final else whole.unionByName(full)
        ready = cut.join(settled.select(*at), at, "left_anti")
        part = ready.select(*CELL, "edges", "cover").groupBy(*CELL).applyInArrow(run, schema)
        done = part if done is None else done.unionByName(part)
        if not odd:
            covered = whole.select(*CELL) if covered is None else covered.unionByName(whole.select(*CELL))
        if final:
            break
        todo, size = cut.join(full.select(*at), at, "left_semi").drop("cx", "cy", "inner", "active"), size / split
    return done, covered


def coded_shapes(layer: DataFrame, key: str) -> DataFrame:
    """(k, edges, box) of a layer; exact copies of a shape are merged (they do not change a union)."""
    return (layer.select(key_code(F.col(key)).alias("k"), "edges", "x0", "y0", "x1", "y1")
            .where(F.col("x0").isNotNull()).dropDuplicates(["k", "edges"]))


def dissolve_area(layer: DataFrame, key: str, cell_size: float | None = None,
                  max_cell_edges: int = 4000, max_group_rows: int = 1000, split: int = 4) -> DataFrame:
    """Union area per ``key`` (overlaps counted once) and the number of shapes merged.

    Exact copies of a shape are merged first (a map-side distinct; copies do
    not change a union). ``max_cell_edges`` and ``max_group_rows`` (shapes) bound
    the edges that pass through a cell (unless most lie side by side, ``WORK``) and the shapes they belong to (what
    covers a cell whole needs no cutting): cells beyond either are cut into ``split x split`` sub-cells, at most ``MAX_ROUNDS``
    times (edges that all meet in one point cannot be parted further). Each
    round's cells are written to the shared folder.
    """
    def per_cell(k: str, box: tuple, edges: np.ndarray, shape: np.ndarray, _cover: int) -> pa.Table:
        return pa.table({"k": [k], "cell_area": [bands(edges, shape, box).area()]})

    measured, covered = measured_cells(coded_shapes(layer, key), per_cell, "k string, cell_area double", layer=layer, cell_size=cell_size,
                                       max_cell_edges=max_cell_edges, max_group_rows=max_group_rows, split=split)
    whole = covered.select("k", ((F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0"))).alias("cell_area"))
    areas = measured.unionByName(whole).groupBy("k").agg(F.sum("cell_area").alias("union_area"))
    counts = layer.groupBy(F.col(key).alias("_value")).agg(F.count("*").alias("n_shapes")).withColumn("k", key_code(F.col("_value")))
    return (counts.join(areas, "k", "left").select(F.col("_value").alias(key), F.coalesce("union_area", F.lit(0.0)).alias("union_area"), "n_shapes"))
