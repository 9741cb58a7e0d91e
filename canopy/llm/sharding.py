"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

**Ring.** Each shard owns ``vnodes`` points of the 64-bit hash ring; a row
belongs to the first point clockwise of its key's hash (the point's *arc*).

**Bounded loads.** A shard takes at most its capacity. In every round each
arc's rows go to its shard in ring order while there is room; what overflows continues
clockwise to the next point whose shard still has room. A round in which anything
overflows fills at least one shard, so there are at most as many rounds as
shards; few rows move, as most stay in their own arc.

With ``slack`` = 0 the capacities are the row count divided by the shards, rounded up for the
first shards and down for the rest, so counts differ by at most one (law
``rows``). With ``slack`` > 0 each shard takes up to (1 + slack) times the mean,
the classic trade of balance for fewer moved rows.

**At scale.** Rows inside an arc differ only in their rank, so the rounds need
no row: they run over the arcs' row counts, a table of ``shards * vnodes``
rows whatever the input. They give, for each arc, ranges of ranks and the shard
and first slot of each, a table of about that size, which is broadcast. Ranks
are exact: rows are counted per ring position (pre-aggregated, so a hot key is one row a task),
positions are cumulated within their arc, and rows that share a position
are numbered within salted parts of it. The texts are read once and never
shuffled; only (id, size, checksum, position) is.

Only DataFrame functions run; no Python code sees a row.

Defined cases: a null text has no bytes (size 8, checksum 0); null ids hash as
the text 'null'; repeated rows each get a slot of their own; fewer rows than
shards leave some shards empty; an empty table gives an empty result. Other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

SHARDS, VNODES, SALTS = 24, 256, 64
#: The ring is cut into this many equal cells to look arcs up by an equi-join.
CELL_BITS = 12


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(owner, point) of every virtual node; points are signed 64-bit hashes."""
    return (spark.range(shards * vnodes)
            .select(F.expr(f"cast(id div {vnodes} as int)").alias("owner"),
                    F.expr(f"xxhash64(concat('shard ', id div {vnodes}, ' node ', id % {vnodes}))").alias("point")))


def _cell(position: str) -> Column:
    """Which of the ring's 2^CELL_BITS equal cells a position lies in."""
    return F.expr(f"cast(shiftright({position}, {64 - CELL_BITS}) + {1 << (CELL_BITS - 1)} as int)")


def ring_cells(points: DataFrame) -> DataFrame:
    """(cell, points, first): the points in each cell and how many lie before it; 2^CELL_BITS rows."""
    held = points.groupBy(_cell("point").alias("cell")).agg(F.collect_list("point").alias("points"))
    every = points.sparkSession.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"))
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    return (every.join(held, "cell", "left")
            .select("cell", F.coalesce("points", F.expr("cast(array() as array<bigint>)")).alias("points"))
            .withColumn("first", F.coalesce(F.sum(F.size("points")).over(before), F.lit(0))))


def fill(arcs: list[tuple[int, int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Place the arcs' rows: (arc, first rank, end rank, shard, first slot) ranges.

    ``arcs`` has (owner, rows) in clockwise order; the capacities suffice.
    """
    room, slots, out = list(caps), [0] * len(caps), []
    waiting = [(a, 0, n, a) for a, (_, n) in enumerate(arcs) if n]  # arc, first rank, end rank, point it is at
    while waiting:
        over = []
        for arc, first, end, at in waiting:
            s = arcs[at][0]
            if take := min(room[s], end - first):
                out.append((arc, first, first + take, s, slots[s]))
                room[s] -= take
                slots[s] += take
            if first + take < end:
                over.append((arc, first + take, end, at))
        # on to the next point of a shard with room, clockwise
        ahead, following = [0] * len(arcs), None
        for i in range(2 * len(arcs) - 1, -1, -1):
            ahead[i % len(arcs)] = following
            if room[arcs[i % len(arcs)][0]]:
                following = i % len(arcs)
        waiting = sorted(((arc, first, end, ahead[at]) for arc, first, end, at in over), key=lambda w: ((w[3] - w[0]) % len(arcs), w[0]))
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(rows: DataFrame, key_col: str, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``home_shard``.

    ``rows`` should be narrow: it is written to the shared folder and shuffled.
    """
    spark = rows.sparkSession
    points = ring(spark, shards, vnodes)
    owners = [r.owner for r in points.orderBy("point", "owner").collect()]  # shards * vnodes
    if not owners:
        raise ValueError("a ring needs at least one shard and one virtual node")
    placed = (rows.withColumn("_pos", F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("null"))))
              .withColumn("cell", _cell("_pos")).join(F.broadcast(ring_cells(points)), "cell")
              .withColumn("_arc", F.expr(f"(first + size(filter(points, p -> p < _pos))) % {len(owners)}"))
              .withColumn("_salt", F.expr(f"cast(monotonically_increasing_id() % {SALTS} as int)"))
              .drop("cell", "points", "first"))
    kept = written(placed, "ring")
    groups = kept.groupBy("_arc", "_pos", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_arc").orderBy("_pos", "_salt").rowsBetween(W.unboundedPreceding, -1)
    shift = groups.select("_arc", "_pos", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    loads = {r["_arc"]: r.n for r in kept.groupBy("_arc").agg(F.count("*").alias("n")).collect()}  # shards * vnodes
    arcs = [(owner, loads.get(a, 0)) for a, owner in enumerate(owners)]
    ranges = fill(arcs, capacities(sum(loads.values()), shards, slack))
    listed = json.dumps([[str(v) for v in (a, f, e, s, t, arcs[a][0])] for a, f, e, s, t in ranges])
    names = [("_arc", "long"), ("_first", "long"), ("_end", "long"), ("shard", "int"), ("_slot", "long"), ("home_shard", "int")]
    where = F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<array<string>>")).alias("r"))
                        .select(*[F.col("r")[i].cast(t).alias(n) for i, (n, t) in enumerate(names)]))
    own = W.partitionBy("_arc", "_pos", "_salt").orderBy(key_col)
    return (kept.withColumn("_own", F.row_number().over(own) - 1).join(shift, ["_arc", "_pos", "_salt"])
            .withColumn("_rank", F.col("_own") + F.col("_shift"))
            .join(where, "_arc").where("_rank >= _first AND _rank < _end")
            .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_first"))
            .select(*rows.columns, "shard", "slot", "home_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` in a shard: id, size, text_crc32, law, shard, slot, grown_shard, home_shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(narrow, id_col, shards, vnodes).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard")
