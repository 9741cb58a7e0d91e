"""The grid join by blocks: shapes travel once per cell, pairs are made where they are overlaid.

Joining the two sides' cell rows makes a row per candidate pair with both
shapes' edge lists, which is most of the work where layers are dense. Here
both sides' cell rows (L01, :func:`canopy.operators.spatial_join.with_cells`)
are dealt by cell as one table, and a task reads the shapes of one cell after
another and overlays their pairs in numpy (:mod:`canopy.functions.block_pairs`).

A cell with more than ``BLOCK_ROWS`` rows of one side is cut: its rows are
dealt to blocks, and every block of the left meets every block of the right in
a unit of its own, so a unit's rows are bounded and a crowded cell is shared
out. What comes out is a row per pair (:func:`block_pairs`), the left rows with
a partner (:func:`matched_rows`), or the pairs' count and summed area by
columns of either side, summed over the pairs of a batch of units before they
leave the task (:func:`block_totals`); summing these again gives the totals.

Where large layers' pairs are gone through, a cell row per shape, cell and block
would be many times the layers on disk. There the plan takes the cells and
blocks that deal out the fewest rows (:func:`fewest_rows`), a unit's pairs being a
bounded share of all, and rows of one cell are packed and compressed, many in one
row, before they are dealt out (:func:`_pack`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import block_pairs as bp

#: Rows of one side of a cell that one unit holds, about.
BLOCK_ROWS = 16_384
#: So many times as many where pairs are only summed, as every left block's rows go to every right block.
WIDER = 4
#: Pairs of rows from which a unit whose pairs are gone through is cut into blocks of a quarter of that, so that a task has a bounded number.
UNIT_PAIRS = 1 << 24
#: Pairs of one task, about, where the plan expects so many that there are more tasks than the session has shuffle partitions.
TASK_PAIRS = 1 << 24
#: Pairs that leave a task in one batch.
PAIRS_AT_ONCE = 1 << 16
#: Pairs of stairs from which a unit's pairs may be summed without going through them.
CROWDED = bp.CROWDED
#: Cell rows of one task, about, while there are fewer tasks than the session has shuffle partitions.
TASK_ROWS = 10_000
#: Shuffle partitions at most.
MOST_TASKS = 10_000
#: Shapes of both layers, and pairs expected for each of them, from which cells and blocks are chosen to deal out few rows, and rows are packed.
PACKED_SHAPES, PACKED_PAIRS = 1 << 21, 16
#: Into about so many units all pairs are dealt at least, where each is larger than ``UNIT_PAIRS``; cells are not so large that there are fewer than LEAST_UNITS.
UNITS, LEAST_UNITS = 4096, 512
#: Doublings by which a box may exceed a cell before it gets a level of its own.
MOST_SPAN = 3
#: Cell rows, or bytes of them, that are sorted and packed together, rows of a block put in one pack at least (if there are as many), and bytes unpacked at once.
PACK_ROWS, PACK_BYTES, LEAST_PACK, UNPACK_BYTES = 1 << 17, 1 << 26, 64, 1 << 23
_UNIT = ["lvl", "cx", "cy", "lb", "rb"]
#: A shape's columns in a pack, besides those of its side.
_SHAPE = ["own", "x0", "y0", "x1", "y1", "area", "edges"]


def _cuts(n, m, unit: float, ceil: Callable = math.ceil, least: Callable = min, most: Callable = max):
    """Blocks of a cell's ``n`` rows of one side, with ``m`` of the other, for units of about ``unit`` pairs of rows and few copies; numbers or columns."""
    return ceil(most(n / (BLOCK_ROWS * WIDER), n * least(m, math.sqrt(unit)) / unit))


def fewest_rows(k: int, left, right, pairs: float) -> tuple[int, int, float]:
    """(power of two of the cell, span, pairs of rows of a unit) that deal out the fewest cell rows, by both sides' statistics as if evenly
    spread: from ``2**k`` up, as larger cells need fewer copies of a shape, but more blocks. Small layers, and those with few ``pairs``, keep ``k``."""
    sides = left, right
    shapes = sum(int(r["n"]) for r in sides)
    if shapes < PACKED_SHAPES or pairs < PACKED_PAIRS * shapes:
        return k, 0, 0.0
    known = [float(r[c]) for r in sides for c in ("x0", "y0", "x1", "y1", "w", "h")]
    if not all(map(math.isfinite, known)):
        return k, 0, 0.0
    classes = [{int(c) for c in r["classes"]} for r in sides]
    top = max(max(c) for c in classes)
    far = [max(float(r[hi]) for r in sides) - min(float(r[lo]) for r in sides) for lo, hi in (("x0", "x1"), ("y0", "y1"))]
    best = None
    for kk in range(k, max(k, top) + 1):
        size = 2.0 ** kk
        cells = max(1.0, far[0] / size) * max(1.0, far[1] / size)
        # a row goes to the other side's higher levels too
        rows = [float(r["n"]) * (1 + float(r["w"]) / size) * (1 + float(r["h"]) / size) * (1 + sum(c > kk + MOST_SPAN for c in others))
                for r, others in zip(sides, reversed(classes))]
        unit = max(float(UNIT_PAIRS), rows[0] * rows[1] / cells / UNITS)
        n, m = (v / cells for v in rows)
        lb, rb = max(1, _cuts(n, m, unit)), max(1, _cuts(m, n, unit))
        dealt = rows[0] * rb + rows[1] * lb
        if best is None or dealt < best[0] and cells * lb * rb >= LEAST_UNITS:
            best = dealt, kk, min(max(0, top - kk), MOST_SPAN), unit
    return best[1:]


def _tasks(df: DataFrame, rows: int, pairs: float = 0.0) -> int:
    """Partitions for units made from so many shapes, whose pairs are gone through."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        most = max(most, 4 * spark.sparkContext.defaultParallelism)
    except Exception:
        pass  # Spark Connect has no context
    return max(most if rows < 0 else max(1, min(most, max(8, rows // TASK_ROWS))), int(min(pairs // TASK_PAIRS, MOST_TASKS)))


def _units(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keep: list[str], right_keep: list[str], plan,
           wider: int = 1) -> DataFrame:
    """Both sides' cell rows as one table, dealt and sorted by unit."""
    from .spatial_join import _side, with_cells
    sides = []
    for mine, df, idc, keep, others in (("l", left, left_id, left_keep, plan.right_levels), ("r", right, right_id, right_keep, plan.left_levels)):
        d = with_cells(_side(df, f"{mine}_", idc, keep), plan, others).where(F.col("lvl") >= min(others))
        sides.append((mine, d, [f"{mine}_id", *[f"{mine}_c_{c}" for c in keep]]))
    key = ["lvl", "cx", "cy"]
    counts = [d.select(*key, F.lit(int(mine == "l")).alias("_nl"), F.lit(int(mine == "r")).alias("_nr")) for mine, d, _c in sides]
    if plan.unit_pairs:
        return _packed_units(sides, counts, plan)
    most = BLOCK_ROWS * wider
    full = F.col("_nl") * F.col("_nr") > F.lit(UNIT_PAIRS) if wider == 1 else F.lit(False)
    blocks = (lambda n: F.ceil(F.col(n) / F.when(full, -(-most // 4)).otherwise(most)).cast("int").alias(n))
    # at most one row per so many cell rows
    hot = (counts[0].unionAll(counts[1]).groupBy(*key).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr"))
           .where((F.col("_nl") > 0) & (F.col("_nr") > 0) & ((F.greatest("_nl", "_nr") > most) | full)).select(*key, blocks("_nl"), blocks("_nr")))
    out = []
    for k, (mine, d, carry) in enumerate(sides):
        own, other = ("_nl", "_nr") if mine == "l" else ("_nr", "_nl")
        d = d.join(F.broadcast(hot), key, "left")
        d = d.withColumn("_mine", F.when(F.col(own) > 1, F.pmod(F.monotonically_increasing_id(), F.col(own))).otherwise(0).cast("int"))
        d = d.withColumn("_theirs", F.explode(F.when(F.col(other) > 1, F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))))
        lb, rb = ("_mine", "_theirs") if mine == "l" else ("_theirs", "_mine")
        held = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias(mine)]
        gap = sides[1 - k]
        none = F.lit(None).cast(T.StructType([T.StructField(c, gap[1].schema[c].dataType) for c in gap[2]])).alias(gap[0])
        out.append(d.select(*key, F.col(lb).alias("lb"), F.col(rb).alias("rb"), F.lit(mine == "l").alias("is_left"),
                            (F.col("_own") == F.col("lvl")).alias("own"), "x0", "y0", "x1", "y1", F.col(f"{mine}_area").alias("area"),
                            F.col(f"{mine}_edges").alias("edges"), *(held + [none] if mine == "l" else [none] + held)))
    both = out[0].unionAll(out[1])
    return both.repartition(_tasks(both, plan.left_rows + plan.right_rows, plan.pairs if wider == 1 else 0.0), *_UNIT).sortWithinPartitions(*_UNIT)


def _packed_units(sides: list[tuple], counts: list[DataFrame], plan) -> DataFrame:
    """:func:`_units` with the rows of a cell and block packed while they are dealt out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    key = ["lvl", "cx", "cy"]
    cuts = (lambda n, m: F.greatest(F.lit(1), _cuts(F.col(n), F.col(m), plan.unit_pairs, F.ceil, lambda a, b: F.least(a, F.lit(b)), F.greatest)).cast("int"))
    # cells cut into blocks; a unit holds so many pairs of rows that they are few
    hot = (counts[0].unionAll(counts[1]).groupBy(*key).agg(F.sum("_nl").alias("_nl"), F.sum("_nr").alias("_nr")).where((F.col("_nl") > 0) & (F.col("_nr") > 0))
           .select(*key, cuts("_nl", "_nr").alias("_bl"), cuts("_nr", "_nl").alias("_br")).where((F.col("_bl") > 1) | (F.col("_br") > 1)))
    out, kinds = [], []
    for mine, d, carry in sides:
        own, other = ("_bl", "_br") if mine == "l" else ("_br", "_bl")
        d = d.join(F.broadcast(hot), key, "left")
        d = d.select(*key, F.coalesce(own, F.lit(1)).alias("_blocks"), F.coalesce(other, F.lit(1)).alias("_others"), (F.col("_own") == F.col("lvl")).alias("own"),
                     "x0", "y0", "x1", "y1", F.col(f"{mine}_area").alias("area"), F.col(f"{mine}_edges").alias("edges"),
                     F.struct(*[F.col(f"`{c}`") for c in carry]).alias(mine))
        kinds.append(d.schema[mine])
        held = T.StructType([d.schema[c] for c in [*_SHAPE, mine]])
        packs = T.StructType([d.schema[c] for c in key] + [T.StructField("_mine", T.IntegerType()), T.StructField("_others", T.IntegerType()),
                                                           T.StructField("_size", T.LongType()), T.StructField("_rows", T.BinaryType())])
        d = d.mapInArrow(_pack(to_arrow_schema(held)), packs).withColumn("_theirs", F.explode(F.sequence(F.lit(0), F.col("_others") - 1)))
        lb, rb = ("_mine", "_theirs") if mine == "l" else ("_theirs", "_mine")
        out.append(d.select(*key, F.col(lb).alias("lb"), F.col(rb).alias("rb"), F.lit(mine == "l").alias("is_left"), "_size", "_rows"))
        common = held
    both = out[0].unionAll(out[1])
    both = both.repartition(_tasks(both, plan.left_rows + plan.right_rows, plan.pairs), *_UNIT).sortWithinPartitions(*_UNIT)
    fields = [both.schema[c] for c in [*_UNIT, "is_left"]] + [common[c] for c in _SHAPE] + [T.StructField(f.name, f.dataType) for f in kinds]
    whole = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return both.mapInArrow(_unpack(to_arrow_schema(whole)), whole)


def _pack(kinds: pa.Schema):
    """The function for mapInArrow that makes cell rows into rows (cell, block, the other side's blocks, bytes, packed rows of the columns ``kinds``)."""
    def packed(batches: list[pa.RecordBatch], turn: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        lvl, cx, cy, blocks, others = (rows.column(c).to_numpy() for c in ("lvl", "cx", "cy", "_blocks", "_others"))
        order = np.lexsort((cy, cx, lvl))
        lvl, cx, cy, blocks, others = (v[order] for v in (lvl, cx, cy, blocks, others))
        new = np.append(True, (lvl[1:] != lvl[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(order)))
        cell = np.cumsum(new) - 1
        # a cell's rows go to its blocks in turn, a run of them each
        run = np.maximum(LEAST_PACK, -(-n // blocks[first]))[cell]
        part = (np.arange(len(order)) - first[cell]) // run
        begin = np.flatnonzero(new | np.append(True, part[1:] != part[:-1]))
        end = np.append(begin[1:], len(order))
        held = rows.select(kinds.names).cast(kinds).take(pa.array(order)).combine_chunks().to_batches()[0]
        codec = pa.Codec("zstd", 1)
        size, data = [], []
        for b, e in zip(begin.tolist(), end.tolist()):
            one = held.slice(b, e - b).serialize()
            size.append(one.size)
            data.append(codec.compress(one, asbytes=True))
        mine = ((part + turn) % blocks)[begin].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (lvl[begin], cx[begin], cy[begin], mine, others[begin], np.array(size, np.int64))]
                                          + [pa.array(data, pa.binary())], ["lvl", "cx", "cy", "_mine", "_others", "_size", "_rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        context = TaskContext.get()
        held, rows, size, turn = [], 0, 0, context.partitionId() if context else 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows and (rows >= PACK_ROWS or size >= PACK_BYTES):
                yield packed(held, turn)
                held, rows, size, turn = [], 0, 0, turn + 1
        if rows:
            yield packed(held, turn)
    return run


def _unpack(kinds: pa.Schema):
    """The function for mapInArrow that gives packed rows back as the rows of :func:`_units`, columns ``kinds``."""
    side = {s: pa.schema([*(kinds.field(c) for c in _SHAPE), kinds.field(s)]) for s in "lr"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            unit = [batch.column(c) for c in [*_UNIT, "is_left"]]
            size, data, left = batch.column("_size").to_pylist(), batch.column("_rows"), batch.column("is_left").to_pylist()
            held, at, total = [], [], 0
            for k, n in enumerate(size):
                s = "l" if left[k] else "r"
                got = pa.ipc.read_record_batch(codec.decompress(data[k].as_buffer(), n), side[s])
                held.append(got)
                at.append(k)
                total += n
                if total < UNPACK_BYTES and k + 1 < len(size):
                    continue
                of = pa.array(np.repeat(at, [h.num_rows for h in held]))
                shapes = [pa.concat_arrays([h.column(c) for h in held]) for c in _SHAPE]
                ends = [pa.concat_arrays([h.column(s) if s in h.schema.names else pa.nulls(h.num_rows, kinds.field(s).type) for h in held]) for s in "lr"]
                yield pa.RecordBatch.from_arrays([c.take(of) for c in unit] + shapes + ends, kinds.names)
                held, at, total = [], [], 0
    return run


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole units, with the row at which each unit begins."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in _UNIT]
        change = np.zeros(batch.num_rows, bool)
        for v in keys:
            change[1:] |= v[1:] != v[:-1]
        change[0] = last is not None and any(v[0] != w for v, w in zip(keys, last))
        last = [v[-1] for v in keys]
        at = np.flatnonzero(change)
        if not len(at):
            held.append(batch)
            continue
        if at[-1]:
            held.append(batch.slice(0, at[-1]))
        if held:
            yield _begun(pa.Table.from_batches(held))
        held = [batch.slice(at[-1])]
    if held:
        yield _begun(pa.Table.from_batches(held))


def _begun(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for c in _UNIT:
        v = rows.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return rows, np.flatnonzero(change)


def _sides(rows: pa.Table, begin: np.ndarray, cell: float):
    """The two sides of a table of whole units and each unit's rows in them."""
    left = rows.column("is_left").to_numpy()
    unit = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, rows.num_rows)))
    nl = np.bincount(unit[left], minlength=len(begin))
    nr = np.bincount(unit[~left], minlength=len(begin))
    # rows of units with one side only meet nothing
    some = (nl > 0) & (nr > 0)
    keep = some[unit]
    lt, rt = rows.filter(pa.array(left & keep)), rows.filter(pa.array(~left & keep))
    nl, nr = nl[some], nr[some]
    size = cell * 2.0 ** rows.column("lvl").to_numpy()[begin[some]]
    x, y = (rows.column(c).to_numpy()[begin[some]] * size for c in ("cx", "cy"))
    return lt, rt, (np.cumsum(nl) - nl, nl, np.cumsum(nr) - nr, nr, x, y)


def _struct(table: pa.Table, name: str) -> pa.StructArray:
    got = table.column(name).combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _each(finish: Callable, cell: float, predicate: str, least: float | None = None, distance: float | None = None, with_area: bool = True):
    """The function for mapInArrow: ``finish(rows left, rows right, their shapes, batches of (i, j, area, contact))`` yields what leaves the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _whole_units(batches):
            lt, rt, units = _sides(rows, begin, cell)
            if not lt.num_rows:
                continue
            a, b = bp.Shapes(lt), bp.Shapes(rt)
            yield from finish(lt, rt, a, b, bp.found(a, b, units, predicate, least, distance, with_area=with_area))
    return run


def _sums(finish: Callable, codes: Callable, cell: float, predicate: str, least: float | None = None, with_area: bool = True):
    """The function for mapInArrow where pairs are only summed by the sides' codes (``codes(rows left, rows right)``).

    ``finish(rows left, rows right, batches of (left code, right code, number or None for 1 each, area))`` yields what leaves the task. Of
    crowded units the pairs of stairs are summed without going through them (:mod:`canopy.functions.stairs`), unless each pair's area is asked about.
    """
    crowded = CROWDED if predicate == "intersects" and least is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _whole_units(batches):
            lt, rt, units = _sides(rows, begin, cell)
            if not lt.num_rows:
                continue
            a, b = bp.Shapes(lt), bp.Shapes(rt)
            lk, rk = codes(lt, rt)
            crowd = None if crowded is None else bp.crowded(a, b, *units[:4], lk, rk, crowded)

            def found():
                for i, j, area, _contact in bp.found(a, b, units, predicate, least, crowd=crowd, with_area=with_area):
                    yield lk[i], rk[j], None, area
                if crowd is None or not crowd.any():
                    return
                l0, nl, r0, nr, x, y = units
                got = [t for u in np.flatnonzero(crowd)
                       for t in bp.crowd_totals(a, b, np.arange(l0[u], l0[u] + nl[u]), np.arange(r0[u], r0[u] + nr[u]), lk, rk, x[u], y[u], crowd[u], with_area)]
                if sum(len(t[0]) for t in got):
                    yield tuple(np.concatenate(v) for v in zip(*got))
            yield from finish(lt, rt, found())
    return run


def _fields(df: DataFrame, side: str) -> list[T.StructField]:
    return df.schema[side].dataType.fields


def _pair_rows(units: DataFrame, values: list[T.StructField], take: Callable, cell: float, predicate: str, **ask) -> DataFrame:
    """A row per pair: both sides' columns and ``values``, which ``take(shapes left, shapes right, i, j, area or distance, contact)`` gives as arrays.

    Spark reads a row from Python at several times the cost of an element of an array. So what leaves the task is a row
    per run of pairs of one left row, with arrays of their right rows' columns and values, which Spark makes into rows.
    """
    ours, lists = _fields(units, "l"), [*_fields(units, "r"), *values]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ours] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in lists])
    names = schema.names

    def finish(lt, rt, a, b, found):
        lc, rc = _struct(lt, "l").flatten(), _struct(rt, "r").flatten()
        for i, j, value, contact in found:
            for s in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[s:s + PAIRS_AT_ONCE], j[s:s + PAIRS_AT_ONCE]
                begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                at, run = pa.array(np.append(begin, len(p)), pa.int32()), pa.array(p[begin])
                of = pa.array(q)
                each = [c.take(of) for c in rc] + [pa.array(v) for v in take(a, b, p, q, value[s:s + PAIRS_AT_ONCE], contact[s:s + PAIRS_AT_ONCE])]
                yield pa.RecordBatch.from_arrays([c.take(run) for c in lc] + [pa.ListArray.from_arrays(at, v) for v in each], names)
    runs = units.mapInArrow(_each(finish, cell, predicate, **ask), schema)
    first, *rest = [f.name for f in lists]
    mine = [F.col(f"`{f.name}`") for f in ours]
    if not rest:
        return runs.select(*mine, F.explode(F.col(f"`{first}`")).alias(first))
    rows = runs.select(*mine, *[F.col(f"`{c}`") for c in rest], F.posexplode(F.col(f"`{first}`")).alias("_at", first))
    return rows.select(*mine, F.col(f"`{first}`"), *[F.get(F.col(f"`{c}`"), F.col("_at")).alias(c) for c in rest])


def block_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keep: list[str], right_keep: list[str], plan,
                predicate: str, with_area: bool = True) -> DataFrame:
    """One row per pair that fulfils the predicate: ids, kept columns, areas and (``with_area``) ``inter_area``.

    ``predicate`` "meets" keeps what shares any area or boundary and adds ``edge_contact``, false where the area settles it
    (for pieces of shapes, whose sums are taken later).
    """
    return _pairs_of(_units(left, right, left_id, right_id, left_keep, right_keep, plan), plan, predicate, with_area)


def _pairs_of(units: DataFrame, plan, predicate: str, with_area: bool) -> DataFrame:
    area = [T.StructField("inter_area", T.DoubleType())] if with_area else []
    if predicate == "meets":
        # the shapes' areas are of use to the sums of pieces only
        values = [T.StructField(c, T.DoubleType()) for c in ("l_area", "r_area", "inter_area")] + [T.StructField("edge_contact", T.BooleanType())]
        take = (lambda a, b, i, j, area, contact: [a.area[i], b.area[j], area, contact])
    else:
        values, take = area, (lambda a, b, i, j, area, contact: [area] if with_area else [])
    return _pair_rows(units, values, take, plan.cell, predicate, with_area=with_area)


def matched_rows(left: DataFrame, right: DataFrame, left_id: str, right_id: str, row: str, plan, predicate: str) -> DataFrame:
    """The numbers ``row`` of left rows with a partner, once per unit that has one."""
    return _matched_of(_units(left, right, left_id, right_id, [row], [], plan, WIDER if predicate == "intersects" else 1), row, plan, predicate)


def pairs_and_matched(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keep: list[str], right_keep: list[str], row: str, plan,
                      predicate: str, with_area: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`block_pairs` and :func:`matched_rows` of the same units, so that Spark deals the shapes out once for both."""
    units = _units(left, right, left_id, right_id, [*left_keep, row], right_keep, plan)
    return _pairs_of(units, plan, predicate, with_area), _matched_of(units, row, plan, predicate)


def _matched_of(units: DataFrame, row: str, plan, predicate: str) -> DataFrame:
    codes = (lambda lt, rt: (np.arange(lt.num_rows), np.zeros(rt.num_rows, np.int64)))

    def finish(lt, rt, found):
        seen = np.zeros(lt.num_rows, bool)
        for i, _j, n, _area in found:
            seen[i if n is None else i[n > 0]] = True
        yield pa.RecordBatch.from_arrays([_struct(lt, "l").field(f"l_c_{row}").take(pa.array(np.flatnonzero(seen)))], [row])
    return units.mapInArrow(_sums(finish, codes, plan.cell, predicate, with_area=False), T.StructType([T.StructField(row, T.LongType())]))


def near_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keep: list[str], right_keep: list[str], plan,
               distance: float) -> DataFrame:
    """One row per pair at most ``distance`` apart: ids, kept columns and ``distance``; the left boxes are grown by it already."""
    units = _units(left, right, left_id, right_id, left_keep, right_keep, plan)
    return _pair_rows(units, [T.StructField("distance", T.DoubleType())], lambda a, b, i, j, far, contact: [far], plan.cell, "intersects", distance=distance)


def _codes(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per distinct row of the columns, and the first row that has it."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)[1]
    return code, np.unique(code, return_index=True)[1]


def block_totals(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keep: list[str], right_keep: list[str], plan,
                 predicate: str, by_left: list[str], by_right: list[str], least: float | None = None) -> DataFrame:
    """``n_pairs`` and ``inter_area`` (sum) of the pairs with more than ``least`` in common, by prefixed columns
    (``l_id``, ``l_c_<name>``, ``r_id``, ...); a combination comes once per batch of units that has it."""
    units = _units(left, right, left_id, right_id, left_keep, right_keep, plan, WIDER if predicate == "intersects" and least is None else 1)
    kinds = {f.name: f.dataType for s in "lr" for f in _fields(units, s)}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in [*by_left, *by_right]]
                          + [T.StructField("n_pairs", T.LongType()), T.StructField("inter_area", T.DoubleType())])
    names = schema.names

    def columns(lt, rt):
        return ([_struct(t, s).field(c) for c in by] for t, s, by in ((lt, "l", by_left), (rt, "r", by_right)))

    def codes(lt, rt):
        lc, rc = columns(lt, rt)
        return _codes(lc, lt.num_rows)[0], _codes(rc, rt.num_rows)[0]

    def finish(lt, rt, found):
        lc, rc = columns(lt, rt)
        lf, rf = _codes(lc, lt.num_rows)[1], _codes(rc, rt.num_rows)[1]
        for i, j, n, area in found:
            code = i * len(rf) + j
            if len(lf) * len(rf) <= 4 * len(code) + 1024:
                some = np.flatnonzero(np.bincount(code, minlength=1))
                n, total = np.bincount(code, weights=n)[some], np.bincount(code, weights=area)[some]
                got = some
            else:
                got, at = np.unique(code, return_inverse=True)
                n, total = np.bincount(at, weights=n), np.bincount(at, weights=area)
            p, q = pa.array(lf[got // len(rf)]), pa.array(rf[got % len(rf)])
            yield pa.RecordBatch.from_arrays([c.take(p) for c in lc] + [c.take(q) for c in rc] + [pa.array(n.astype(np.int64)), pa.array(total)], names)
    return units.mapInArrow(_sums(finish, codes, plan.cell, predicate, least), schema)
