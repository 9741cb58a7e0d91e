"""Grid-keyed spatial joins (J01-J05) and the grid layout.

A theta join on boxes plans as a nested-loop join. Here each shape is
exploded into the grid cells its box covers, both sides are equi-joined on
``(lvl, cx, cy)`` (hash or sort-merge, chosen by Catalyst/AQE from sizes),
and a candidate pair is kept only in the one cell holding the lower-left
corner of the two boxes' overlap, so no ``distinct`` is needed.

Large shapes (states, biomes) would cover thousands of fine cells, so each
shape gets a *level*: the coarsest grid it needs so that its box spans at
most two cells per axis. A pair is looked up at ``max(level_a, level_b)``:
each shape is exploded at its own level and at every coarser level present
on the other side (a literal list of at most a few dozen values).

The exact test then finishes every candidate pair in the task that found it
(:mod:`canopy.functions.overlay_arrow`): its intersection area and whether the
boundaries meet. Nothing is regrouped by id, so repeated and NULL ids stay
separate rows, and since no operator above the join asks for its partitioning,
AQE is free to split the partition of a hot cell.

Shapes with very many vertices are cut first (``max_edges``, see
:mod:`canopy.operators.subdivide`): a pair row then carries one small piece of
each shape, and the pieces' sums are added per pair of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import overlay as ov
from ..functions.overlay_arrow import pair_overlay_col
from ..functions.geometry import SHAPE_COLUMNS
from ..session import scratch_path

_TINY = 1e-9
#: Size classes by which a coarse plan's cells are larger, at most.
COARSER = 2


_EXTENT_SQL = "greatest(x1 - x0, y1 - y0)"


def _extent() -> Column:
    return F.expr(_EXTENT_SQL)


def _log2_class_sql() -> str:
    """Smallest integer c with 2**c >= extent (exact: the float log2 is only a
    first guess, corrected by exact powers of two); the same expression
    classifies shapes in the stats job and in the explode."""
    e = f"greatest({_EXTENT_SQL}, {_TINY!r}D)"
    c0 = f"CAST(ceil(log2({e})) AS INT)"
    return (f"({c0} - CASE WHEN pow(2D, {c0} - 1) >= {e} THEN 1 ELSE 0 END"
            f" + CASE WHEN pow(2D, {c0}) < {e} THEN 1 ELSE 0 END)")


def _log2_class() -> Column:
    return F.expr(_log2_class_sql())


@dataclass(frozen=True)
class GridPlan:
    """Cell size ``2**k``, the levels present on each side and side sizes."""
    k: int
    left_levels: tuple[int, ...]
    right_levels: tuple[int, ...]
    left_rows: int = -1
    right_rows: int = -1
    left_edges: int = -1
    right_edges: int = -1
    small_kept: int = -1
    #: Pairs of boxes that meet, about (as if spread evenly over what both sides cover).
    pairs: float = -1.0
    #: Doublings by which a box may exceed the cells of its level: it covers at most ``2**span + 1`` of them along an axis.
    span: int = 0
    #: Pairs of rows of a unit, about, where cell rows are dealt out packed (:mod:`canopy.operators.block_join`); 0: they are not.
    unit_pairs: float = 0.0

    @property
    def cell(self) -> float:
        return float(2.0 ** self.k)


def _kept_bytes(df: DataFrame, cols: list[str]) -> Column:
    """Bytes of the variable-width columns among ``cols``, summed over all rows."""
    sizes = []
    for c in cols:
        t = df.schema[c].dataType
        if not isinstance(t, _FIXED_WIDTH):
            plain = isinstance(t, (T.StringType, T.BinaryType))
            sizes.append(F.octet_length(F.col(c) if plain else F.to_json(F.struct(F.col(c)))))
    return F.coalesce(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0)).cast("long")), F.lit(0))


def plan_grid(left: DataFrame, right: DataFrame, cell_size: float | None = None,
              left_keep: list[str] | None = None, right_keep: list[str] | None = None, coarse: bool = False,
              packed: bool = False) -> GridPlan:
    """One small aggregate job over both boxes picks the grid.

    A plan computed on supersets of the two layers stays valid for them
    (extra levels only add cell rows; larger counts only make the broadcast
    check stricter), so a filtered or joined layer can reuse the plan of its
    source instead of being computed once more for statistics.

    The cell is the power of two at or above the smaller of the two median
    extents (or ``cell_size`` if given), so small shapes are never piled into
    the cells of large ones; larger shapes get a coarser level of their own. With ``coarse`` the cell is up to
    ``COARSER`` classes larger, as far as nine in ten shapes of either side need: fewer cells and levels to deal
    shapes to, where a cell's pairs are summed without going through them. With ``packed``, large layers get the
    cells that deal out the fewest rows (:func:`canopy.operators.block_join.fewest_rows`). Collected values are bounded: two
    extents a side and two sets of integer size classes (at most ~100 values).
    """
    def side(df, k):
        # box columns only: a stored layer's edge lists are not read here
        return df.select(_extent().alias("ext"), _log2_class().alias("c"), F.lit(k).alias("side"), "x0", "y0", "x1", "y1")
    stats = (side(left, 0).unionByName(side(right, 1))
             .where(F.col("ext").isNotNull())
             .groupBy("side")
             .agg(F.percentile_approx("ext", [0.5, 0.9], 1000).alias("ext"), F.collect_set("c").alias("classes"),
                  F.count("*").alias("n"), F.expr("avg(x1 - x0)").alias("w"), F.expr("avg(y1 - y0)").alias("h"),
                  *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
             .collect())
    by_side = {r["side"]: r for r in stats}
    if cell_size is None:
        power = (lambda ext: int(math.ceil(math.log2(max(ext, _TINY)))))
        k = power(min([float(r["ext"][0]) for r in stats] or [1.0]))
        if coarse and stats:
            k = max(k, min(k + COARSER, power(max(float(r["ext"][1]) for r in stats))))
    else:
        k = int(math.ceil(math.log2(cell_size)))

    span, unit = 0, 0.0

    def levels(side: int) -> tuple[int, ...]:
        r = by_side.get(side)
        if r is None:
            return (0,)
        return tuple(sorted({max(0, int(c) - k - span) for c in r["classes"]}))

    def stat(side: int, name: str) -> int:
        r = by_side.get(side)
        return int(r[name] or 0) if r is not None else 0

    nl, nr = stat(0, "n"), stat(1, "n")
    # Edge lists are summed only on the side small enough to be broadcast
    # (at most BROADCAST_MAX_ROWS rows), the one the byte check needs.
    el = er = kept = -1
    if min(nl, nr) <= BROADCAST_MAX_ROWS:
        small, cols = (right, right_keep) if nr <= nl else (left, left_keep)
        total, kept = small.where(F.col("x0").isNotNull()).agg(F.sum(F.size("edges")), _kept_bytes(small, cols or [])).first()
        total, kept = int(total or 0), -1 if cols is None else int(kept)
        el, er = (-1, total) if nr <= nl else (total, -1)
    pairs = 0.0
    if len(by_side) == 2 and not any(r[c] is None for r in stats for c in ("w", "h", "x0", "y0", "x1", "y1")):
        a, b = by_side[0], by_side[1]
        pairs = float(nl) * nr
        for lo, hi, size in (("x0", "x1", "w"), ("y0", "y1", "h")):
            reach = float(a[size]) + float(b[size])
            pairs *= min(1.0, reach / max(_TINY, min(max(a[hi], b[hi]) - min(a[lo], b[lo]), 1e300), reach))
    pairs = pairs if math.isfinite(pairs) else 0.0
    if packed and cell_size is None and len(by_side) == 2:
        from .block_join import fewest_rows
        k, span, unit = fewest_rows(k, by_side[0], by_side[1], pairs)
    return GridPlan(k, levels(0), levels(1), nl, nr, el, er, kept, pairs, span, unit)


def _own_level_sql(k: int) -> str:
    return f"greatest(0, {_log2_class_sql()} - {int(k)})"


def _own_level(k: int) -> Column:
    return F.expr(_own_level_sql(k))


def with_cells(df: DataFrame, plan: GridPlan, other_levels: tuple[int, ...] | None = None,
               keep_level: bool = True) -> DataFrame:
    """Explode each shape into ``(lvl, cx, cy)`` cells of the grid plan.

    At its own level (and any coarser one) a box spans at most two cells per
    axis, so the candidates are a fixed array of ``4 x levels`` structs built
    with plain expressions (code-generated), filtered to the cells the box
    really covers; a plan with a ``span`` lists the cells of each level instead.
    ``other_levels``: coarser levels present on the other side
    of a join. ``floor`` (not integer division) keeps negative coordinates in
    the right cell.
    """
    mine = sorted(set(plan.left_levels) | set(plan.right_levels) | set(other_levels or ()))
    # First name the per-level corner cells and spans once (small code),
    # then pick from a fixed array of at most 4 candidates per level. SQL
    # text, two projections: few driver round trips, small generated code.
    cols = [f"`{c}`" for c in df.columns]
    base = [f"{_own_level_sql(plan.k + plan.span)} AS _own"]
    for L in mine:
        size = repr(plan.cell * 2.0 ** L) + "D"
        base += [f"floor(x0 / {size}) AS _bx{L}", f"floor(y0 / {size}) AS _by{L}",
                 f"floor(x1 / {size}) - floor(x0 / {size}) AS _nx{L}",
                 f"floor(y1 / {size}) - floor(y0 / {size}) AS _ny{L}"]
    out = df.selectExpr(*cols, *base)
    if plan.span:
        at = [f"CASE WHEN {'_own <=' if other_levels and L in other_levels else '_own ='} {L} THEN named_struct('lvl', {L}, 'bx', _bx{L}, 'by', _by{L}, "
              f"'nx', least(_nx{L}, {2 ** plan.span}L), 'ny', least(_ny{L}, {2 ** plan.span}L)) END" for L in mine]
        out = out.selectExpr(*cols, "_own", f"explode(array({', '.join(at)})) AS _cell").where("_cell IS NOT NULL")
        out = out.selectExpr(*cols, "_own", "_cell", "explode(sequence(0L, _cell.nx)) AS _dx")
        out = out.selectExpr(*cols, "_own", "_cell", "_dx", "explode(sequence(0L, _cell.ny)) AS _dy")
        out = out.selectExpr(*cols, "_own", "_cell.lvl AS lvl", "_cell.bx + _dx AS cx", "_cell.by + _dy AS cy")
        return out if keep_level else out.drop("_own")
    cands = []
    for L in mine:
        use = f"_own = {L}" if not other_levels or L not in other_levels else f"_own <= {L}"
        for dx in (0, 1):
            for dy in (0, 1):
                cands.append(f"CASE WHEN {use} AND _nx{L} >= {dx} AND _ny{L} >= {dy} "
                             f"THEN named_struct('lvl', {L}, 'cx', _bx{L} + {dx}, 'cy', _by{L} + {dy}) END")
    out = out.selectExpr(*cols, "_own", f"explode(array({', '.join(cands)})) AS _cell")
    out = out.where("_cell IS NOT NULL").selectExpr(*cols, "_own", "_cell.lvl AS lvl", "_cell.cx AS cx",
                                                    "_cell.cy AS cy")
    return out if keep_level else out.drop("_own")


def grid_layout(df: DataFrame, cell_size: float, partitions: int | None = None) -> DataFrame:
    """L01 as a write layout: cell keys added, rows range-partitioned and
    sorted by cell so Parquet min/max statistics on ``x0..y1`` prune row
    groups for box filters (the re-aimed spatial index)."""
    k = int(math.ceil(math.log2(cell_size)))
    plan = GridPlan(k, (0,), (0,))
    s = F.lit(plan.cell) * F.pow(F.lit(2.0), _own_level(k))
    out = (df.withColumn("lvl", _own_level(k))
             .withColumn("cx", F.floor(F.col("x0") / s)).withColumn("cy", F.floor(F.col("y0") / s)))
    # the box is part of the key, so that one crowded cell is cut too
    key = ["lvl", "cx", "cy", "x0", "y0"]
    out = out.repartitionByRange(partitions, *key) if partitions else out.repartitionByRange(*key)
    return out.sortWithinPartitions(*key)


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose box meets the given one; over a stored grid layout the four
    comparisons reach the Parquet scan and skip row groups."""
    return df.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))


def _side(df: DataFrame, prefix: str, id_col: str, keep: list[str]) -> DataFrame:
    """One projection: prefixed id, edges, area and kept columns; the box
    keeps its plain names for :func:`with_cells`."""
    cols = [F.col(id_col).alias(f"{prefix}id"), F.col("edges").alias(f"{prefix}edges"),
            F.col("area").alias(f"{prefix}area"), "x0", "y0", "x1", "y1"]
    cols += [F.col(f"`{c}`").alias(f"{prefix}c_{c}") for c in keep]
    return df.where(F.col("x0").isNotNull()).select(*cols)


def _attrs(df: DataFrame, id_col: str, exclude=()) -> list[str]:
    return [c for c in df.columns if c not in SHAPE_COLUMNS and c != id_col and c not in exclude]


# A side is broadcast only when the grid-stats job proves it small: at most
# BROADCAST_MAX_ROWS shapes and, counting its exploded rows (up to 4 cells
# per level) with their edge lists (32 bytes per edge) and row overhead, at
# most BROADCAST_MAX_BYTES. Otherwise Spark plans a shuffle join on the cell
# key (sort-merge, AQE skew splitting, or a runtime broadcast).
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


# Carried columns of other types are measured before a side may be broadcast.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def broadcast_estimate(rows: int, edges: int, levels: int = 1, kept: int = 0) -> int:
    """Upper estimate of a side's exploded size in bytes; ``kept``: bytes of its carried variable-width columns."""
    return 4 * max(1, levels) * (edges * 32 + rows * 96 + kept)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least the cluster's parallelism.

    Large inputs arrive split into many scan partitions already; a small
    input (one Parquet file) would otherwise run the whole pair stage in one
    task. Which it is follows from the plan's size estimate, so nothing runs.
    Sessions without that estimate (Spark Connect) keep the input as it is.
    """
    try:
        spark = df.sparkSession
        want = spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    except Exception:
        return df
    return df.repartition(want) if size < want * split else df


def _salted(lp: DataFrame, rp: DataFrame, buckets: int, hot_rows: int) -> tuple[DataFrame, DataFrame, list]:
    """Split hot cells: a cell with more than ``hot_rows`` left rows has its
    left rows spread over ``buckets`` salt values and its right rows copied
    once per salt; every other cell keeps salt 0. Each pair is still found
    exactly once (a left row has one salt, its partners are in every salt).

    The hot-cell list is computed inside the plan (no driver round trip); it
    holds at most ``left rows / hot_rows`` keys, and Spark's size estimates
    decide how it is joined.
    """
    key = ["lvl", "cx", "cy"]
    hot = (lp.groupBy(*key).count().where(F.col("count") > hot_rows)
             .select(*key, F.lit(True).alias("_hot")))
    lp = (lp.join(hot, key, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("l_id"), F.lit(buckets)))
                        .otherwise(F.lit(0)).cast("int")).drop("_hot"))
    rp = (rp.join(hot, key, "left")
            .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1)))
                                           .otherwise(F.array(F.lit(0)))))
            .drop("_hot"))
    return lp, rp, key + ["_salt"]


def candidate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                    left_keep: list[str], right_keep: list[str], plan: GridPlan,
                    salt_buckets: int = 0, hot_cell_rows: int | None = None) -> DataFrame:
    """Box-overlapping pairs, each exactly once, with both shapes' columns.

    ``salt_buckets > 1`` splits hot cells explicitly (see :func:`_salted`); by
    default a hot cell is left to AQE, which splits the sort-merge partition
    that holds it (a test holds the plan to that).
    """
    bcast = None
    side = "right" if plan.right_rows <= plan.left_rows else "left"
    rows, edges, lv = ((plan.right_rows, plan.right_edges, len(plan.right_levels)) if side == "right"
                       else (plan.left_rows, plan.left_edges, len(plan.left_levels)))
    kept, frame = (right_keep, right) if side == "right" else (left_keep, left)
    fixed = all(isinstance(frame.schema[c].dataType, _FIXED_WIDTH) for c in kept)
    if 0 <= rows <= BROADCAST_MAX_ROWS and edges >= 0 and (fixed or plan.small_kept >= 0) \
            and broadcast_estimate(rows, edges, lv, 0 if fixed else plan.small_kept) <= BROADCAST_MAX_BYTES:
        bcast = side
        if bcast == "right":
            left = spread(left)
        else:
            right = spread(right)
    lp = with_cells(_side(left, "l_", left_id, left_keep), plan, plan.right_levels)
    rp = with_cells(_side(right, "r_", right_id, right_keep), plan, plan.left_levels)
    lp = lp.select(*[F.col(c).alias(f"l_{c}") if c in ("x0", "y0", "x1", "y1", "_own") else F.col(c)
                     for c in lp.columns])
    rp = rp.select(*[F.col(c).alias(f"r_{c}") if c in ("x0", "y0", "x1", "y1", "_own") else F.col(c)
                     for c in rp.columns])
    on = ["lvl", "cx", "cy"]
    if salt_buckets and salt_buckets > 1 and bcast is None:
        hot_rows = hot_cell_rows or max(10_000, plan.left_rows // 1000)
        lp, rp, on = _salted(lp, rp, salt_buckets, hot_rows)
    if bcast == "right":
        rp = F.broadcast(rp)
    elif bcast == "left":
        lp = F.broadcast(lp)
    j = lp.join(rp, on)
    s = F.lit(plan.cell) * F.pow(F.lit(2.0), F.col("lvl"))
    ox = F.greatest("l_x0", "r_x0")
    oy = F.greatest("l_y0", "r_y0")
    return j.where(
        (F.col("lvl") == F.greatest("l__own", "r__own"))
        & (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1"))
        & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
        & (F.floor(ox / s) == F.col("cx")) & (F.floor(oy / s) == F.col("cy")))


def pair_overlay(pairs: DataFrame, carry: list[str]) -> DataFrame:
    """Exact per-pair intersection area and boundary contact, on the JVM.

    Explodes the two edge lists of each pair (pipelined in one codegen stage
    with the arithmetic and the partial hash aggregate), then sums per pair
    row: a number given to each candidate row, so equal ids stay apart.
    """
    keys = ["lvl", "cx", "cy", "_pair"]
    # Pass-through values travel as one struct (fewer fused-code variables);
    # it is a grouping key too, being a function of the pair.
    bag = F.struct("l_id", "r_id", "l_area", "r_area", *carry).alias("_bag")
    yb = F.least("l_y0", "r_y0")
    pairs = pairs.withColumn("_pair", F.monotonically_increasing_id())
    e1 = pairs.select(*keys, bag, yb.alias("_yb"), F.explode("l_edges").alias("_ea"), "r_edges")
    e2 = e1.select(*keys, "_bag", "_yb", "_ea", F.explode("r_edges").alias("_eb"))
    terms = ov.edge_pair_terms(e2, keys + ["_bag"])
    agg = terms.groupBy(*keys, "_bag").agg(F.sum("_t").alias("_sum"), F.max("_m").alias("edge_contact"))
    return agg.select("_bag.*", F.greatest(F.col("_sum"), F.lit(0.0)).alias("inter_area"), "edge_contact")


def pair_overlay_batched(pairs: DataFrame, carry: list[str]) -> DataFrame:
    """Same result as :func:`pair_overlay`, each pair finished in place by the
    Arrow-batched kernel (no edge-pair rows, no regrouping shuffle)."""
    o = pair_overlay_col(F.col("l_edges"), F.col("r_edges"), F.least("l_y0", "r_y0"))
    out = pairs.select("l_id", "r_id", "l_area", "r_area", *carry, o.alias("_o"))
    return out.select("l_id", "r_id", "l_area", "r_area", *carry, "_o.inter_area", "_o.edge_contact")


# "batched" (default): every pair is finished where it was found, a bounded
# number of edge pairs at a time, and nothing is regrouped, so AQE may split
# hot cells. "exploded": edge pairs stream through one code-generated stage
# and one row per pair is shuffled for the final sum; its aggregate keeps the
# join's partitioning, which stops AQE from splitting a hot cell.
def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number per row that stays the same however often it is read: numbered, written once and read back."""
    path = scratch_path(df.sparkSession, "numbered")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.schema(df.withColumn(name, F.lit(0).cast("long")).schema).parquet(path)


PAIR_KERNELS = {"batched": pair_overlay_batched, "exploded": pair_overlay}
DEFAULT_KERNEL = "batched"


_PREDICATES = ("intersects", "within", "contains")


def pair_count(named: str | None = None) -> Column:
    """The number of pairs behind rows of ``totals_by``; with ``named``, of those where this column is true."""
    n = F.col("n_pairs") if named is None else F.when(F.col(named), F.col("n_pairs"))
    return F.coalesce(F.sum(n), F.lit(0).cast("long"))


def _join_blocks(left, right, left_id, right_id, predicate, how, lcols, rcols, with_area, cell_size, suffixes, plan, by, least) -> DataFrame:
    """:func:`spatial_join` by blocks."""
    from .block_join import block_pairs, block_totals, matched_rows, pairs_and_matched
    clash = set(lcols) & set(rcols) | ({right_id} & set(lcols)) | ({left_id} & set(rcols))
    # output name -> column of a pair; of the left side first
    ours = {left_id: "l_id", **{(c + suffixes[0] if c in clash else c): f"l_c_{c}" for c in lcols}}
    theirs = {right_id: "r_id", **{(c + suffixes[1] if c in clash else c): f"r_c_{c}" for c in rcols}}
    names = {left_id: "l_id", right_id: "r_id", **ours, **theirs}
    if how == "left":
        # what the join and the rows without a partner need, and no more
        left = _numbered(left.select(*[F.col(f"`{c}`") for c in dict.fromkeys([left_id, *lcols, *SHAPE_COLUMNS])]), "_lrow")
    plan = plan or plan_grid(left, right, cell_size, lcols, rcols, coarse=by is not None and least is None and predicate == "intersects",
                             packed=by is None)
    met = None
    if by is None and how == "left":
        pairs, met = pairs_and_matched(left, right, left_id, right_id, lcols, rcols, "_lrow", plan, predicate, with_area)
        out = [*names, *(["inter_area"] if with_area else [])]
    elif by is None:
        pairs = block_pairs(left, right, left_id, right_id, lcols, rcols, plan, predicate, with_area)
        out = [*names, *(["inter_area"] if with_area else [])]
    else:
        pairs = block_totals(left, right, left_id, right_id, lcols, rcols, plan, predicate,
                             [c for n, c in ours.items() if n in by], [c for n, c in theirs.items() if n in by], least)
        out = [*by, "n_pairs", "inter_area"]
    pairs = pairs.select(*[F.col(f"`{names.get(n, n)}`").alias(n) for n in out])
    if how == "inner":
        return pairs
    # left rows without a partner; both reads of the written rows see the same numbers
    met = matched_rows(left, right, left_id, right_id, "_lrow", plan, predicate) if met is None else met
    alone = left.join(met, "_lrow", "left_anti")
    values = {left_id: F.col(left_id), **{(c + suffixes[0] if c in clash else c): F.col(f"`{c}`") for c in lcols}, "n_pairs": F.lit(1).cast("long")}
    return pairs.unionAll(alone.select(*[(values[n] if n in values else F.lit(None).cast(pairs.schema[n].dataType)).alias(n) for n in out]))


def spatial_join(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                 predicate: str = "intersects", how: str = "inner",
                 left_cols: list[str] | None = None, right_cols: list[str] | None = None,
                 with_area: bool = True, cell_size: float | None = None,
                 suffixes: tuple[str, str] = ("_left", "_right"),
                 plan: GridPlan | None = None, kernel: str = DEFAULT_KERNEL,
                 salt_buckets: int = 0, hot_cell_rows: int | None = None,
                 max_edges: int | None = None, totals_by: list[str] | None = None, least_area: float | None = None) -> DataFrame:
    """Join two prepared shape layers on a spatial predicate.

    Output: ``left_id``, ``right_id``, the chosen attribute columns of both
    sides (clashing names get ``suffixes``) and, with ``with_area``, the exact
    ``inter_area`` of each pair of rows. Ids need be neither unique nor
    present: every pair of rows that meets is one output row. ``how="left"``
    keeps unmatched left rows with a null right side; for that the left rows are
    numbered and written to the shared folder, and both the join and the rows kept read
    the written numbers, so ``left`` may come from a shuffle or be computed anew by a retried task. ``max_edges`` cuts shapes with more edges
    into pieces (:func:`canopy.operators.subdivide.subdivide`) before the join.

    ``kernel="blocks"`` overlays the pairs of a cell block by block
    (:mod:`canopy.operators.block_join`). There ``totals_by`` (output columns) asks for the pairs' number
    ``n_pairs`` and summed ``inter_area`` by these columns, of pairs with more than ``least_area`` in common, several rows
    a combination, to be summed again; a left row without a partner counts as a pair there too, with NULL area.
    """
    if predicate not in _PREDICATES:
        raise ValueError(f"predicate must be one of {_PREDICATES}")
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    lcols = _attrs(left, left_id) if left_cols is None else list(left_cols)
    rcols = _attrs(right, right_id) if right_cols is None else list(right_cols)
    if left_id == right_id:
        raise ValueError("left_id and right_id must differ; rename one side first")
    if totals_by is not None and (kernel != "blocks" or max_edges):
        raise ValueError("totals_by needs kernel='blocks' and whole shapes")
    if least_area is not None and (totals_by is None or how == "left"):
        raise ValueError("least_area goes with totals_by of an inner join")
    if kernel == "blocks" and not max_edges:
        return _join_blocks(left, right, left_id, right_id, predicate, how, lcols, rcols, with_area, cell_size, suffixes, plan, totals_by, least_area)
    lkeep = [] if how == "left" else lcols
    carry_l, carry_r = list(lkeep), list(rcols)
    if how == "left" or max_edges:
        left = _numbered(left, "_lrow") if how == "left" else left.withColumn("_lrow", F.monotonically_increasing_id())
        carry_l.append("_lrow")
    base = left
    if max_edges:
        from .subdivide import subdivide
        left, right = subdivide(left, max_edges), subdivide(right.withColumn("_rrow", F.monotonically_increasing_id()), max_edges)
        carry_r.append("_rrow")
    plan = plan or plan_grid(left, right, cell_size, carry_l, carry_r)
    carry = [f"l_c_{c}" for c in carry_l] + [f"r_c_{c}" for c in carry_r]
    if kernel == "blocks":
        from .block_join import block_pairs
        pairs = block_pairs(left, right, left_id, right_id, carry_l, carry_r, plan, "meets")
    else:
        cands = candidate_pairs(left, right, left_id, right_id, carry_l, carry_r, plan,
                                salt_buckets=salt_buckets, hot_cell_rows=hot_cell_rows)
        pairs = PAIR_KERNELS[kernel](cands, carry)
    if max_edges:
        rest = [c for c in carry if c not in ("l_c__lrow", "r_c__rrow")]
        pairs = (pairs.groupBy("l_c__lrow", "r_c__rrow")
                 .agg(F.sum("inter_area").alias("inter_area"), F.max("edge_contact").alias("edge_contact"),
                      F.any_value(F.struct("l_id", "r_id", "l_area", "r_area", *rest)).alias("_bag"))
                 .select("l_c__lrow", "inter_area", "edge_contact", "_bag.*"))
    if predicate == "intersects":
        cond = ov.intersects(F.col("edge_contact"), F.col("inter_area"), F.col("l_area"), F.col("r_area"))
    elif predicate == "within":
        cond = ov.within(F.col("inter_area"), F.col("l_area"), F.col("r_area"))
    else:
        cond = ov.contains(F.col("inter_area"), F.col("l_area"), F.col("r_area"))
    pairs = pairs.where(cond)

    clash = set(lcols) & set(rcols) | ({right_id} & set(lcols)) | ({left_id} & set(rcols))
    out_cols = [F.col("l_id").alias(left_id), F.col("r_id").alias(right_id)]
    out_cols += [F.col(f"l_c_{c}").alias(c + suffixes[0] if c in clash else c) for c in lkeep]
    out_cols += [F.col(f"r_c_{c}").alias(c + suffixes[1] if c in clash else c) for c in rcols]
    if with_area:
        out_cols.append(F.col("inter_area"))
    if how == "inner":
        return pairs.select(*out_cols)
    result = pairs.select(F.col("l_c__lrow").alias("_lrow"), *out_cols[1:])
    kept = base.select("_lrow", left_id, *[F.col(c).alias(c + suffixes[0] if c in clash else c) for c in lcols])
    return kept.join(result, "_lrow", "left").drop("_lrow")
