"""Hard negatives by threshold joins with prefix-filtered inverted indexes (in the manner of L2AP).

**Threshold join.** A block of rows is joined with a block of anchors: all pairs whose inner product reaches the anchor's threshold t. Dimensions
are ordered by their energy. A row x is indexed by its first dimensions only, as many as leave a rest of norm below t / |q|: what it leaves
out can't lift a pair that shares nothing indexed to t. The inverted index is one list of rows per dimension, walked some dimensions at
a time; partial scores are accumulated along it, and a row goes as soon as its partial score plus the product of the remaining norms
stays below t for every anchor. What is left is verified by its exact integer score.

**Windows.** An anchor's windows are score ranges [lo, hi], each to be filled with its first ``k`` rows. The join starts at a high threshold, which is
lowered until each window is full or the threshold has passed its lower end; only anchors with an open window go on.

**Two joins.** The positives are one window without ends over the rows of the anchor's label; the negatives one window [low * s, s] for each
positive's score s over the rows of other labels. Rows lie in blocks by a hash of the label, so positives are sought in one label's
blocks. Each join first fills the windows from one block; the scores that are the k-th there lift the lower ends for all other blocks.

Rows of a label, however many, are dealt at random to blocks of about ``BLOCK_BYTES``; a work unit is one block and at most about ``ANCHOR_BYTES`` of
anchors, dealt out by one shuffle. Units give at most ``k`` rows a window, never pairs.

Defined cases: components x become floor(256 * x); rows with a null label or with a vector that is null, empty, or holds null or non-finite
components (also once multiplied) take no part, zero vectors do; vectors are compared with those of their own length only; the anchor's other rows
are all rows with another id (or a null id), repeated rows each on their own; of rows that repeat an anchor's id the smallest label and vector
(by its packed bytes) is the anchor; a positive that is repeated has a set of negatives each time; ties go to the smaller id, null ids last; a positive
with a score below 0 has no negatives (its range is empty), one with 0 those that score 0; scores beyond the range of a long are that
range's ends; an anchor without positives has no rows; an empty table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .intvec import LEAST, MOST, apart, first_k, integer_vectors, matrix, numbers, pair_products, products

BLOCK_BYTES, ANCHOR_BYTES = 2 << 20, 1 << 20
#: Labels are hashed to so many numbers; a number's rows fill as many blocks as they need.
LABEL_BUCKETS = 64
#: Thresholds, as shares of (norm of the anchor) * (greatest norm of the block); the last takes everything.
LEVELS = (0.9, 0.7, 0.55, 0.4, 0.25, 0.1, 0.0, -np.inf)
#: Dimensions of the index walked before rows are dropped again.
STEP = 8
#: Cells of a (anchors x rows) matrix held at once.
CELLS = 2_000_000

UNIT = ["bucket", "part", "block"]
FOUND = "anchor_id long, win int, id long, score long"


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of the components from each place on: rows x (dim + 1)."""
    with np.errstate(over="ignore"):
        squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


class Block:
    """A block of rows of one length, its dimensions by falling energy."""

    def __init__(self, x: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.rest = _suffix_norms(self.x)
        self.most = self.rest[:, 0].max()

    def join(self, q: np.ndarray, q_rest: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows) of all pairs that may reach their anchor's threshold ``t``: none that does is left out."""
        dim = q.shape[1]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            # the least share of |q| * most that any threshold asks for; 0 indexes every dimension
            share = np.nan_to_num((t / (q_rest[:, 0] * self.most)).min(), nan=0.0, neginf=0.0, posinf=0.0)
            omitted = self.rest < share * self.most * (1 - 1e-9)
            indexed = np.where(omitted.any(axis=1), omitted.argmax(axis=1), dim)
            indexed = np.minimum(-(-indexed // STEP) * STEP, dim)
            alive = np.argsort(-indexed, kind="stable")
            alive = alive[indexed[alive] > 0]
            done_i, done_j = [], []
            acc = np.zeros((len(q), len(alive)))
            slack = 1e-9 * q_rest[:, :1] * self.rest[None, :, 0]
            for at in range(0, dim, STEP):
                end = min(at + STEP, dim)
                acc += q[:, at:end] @ self.x[alive, at:end].T
                reach = ~(acc + q_rest[:, end, None] * self.rest[None, alive, end] + slack[:, alive] + 1e-6 < t[:, None])
                last = indexed[alive] <= end
                i, j = np.nonzero(reach[:, last])
                done_i.append(i)
                done_j.append(alive[last][j])
                kept = ~last & reach.any(axis=0)
                if not kept.any():
                    break
                alive, acc = alive[kept], acc[:, kept]
        return (np.concatenate(done_i), np.concatenate(done_j)) if done_i else (np.zeros(0, np.int64),) * 2


def fill(q: np.ndarray, x: np.ndarray, allowed: np.ndarray, ids: np.ndarray, null: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, rows, scores): the first ``k`` rows (higher scores, smaller ids, null ids last) of every window.

    Window w belongs to anchor ``of[w]`` (a row of ``q``) and takes the ``allowed`` (anchors x rows) with a score from lo[w] to hi[w].
    """
    block = Block(x)
    q_rest = _suffix_norms(q[:, block.order])
    q = np.ascontiguousarray(q[:, block.order])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wins = np.nonzero(lo <= hi)[0]
    for level in LEVELS:
        if not len(wins):
            break
        open_q, back = np.unique(of[wins], return_inverse=True)
        lowest = np.full(len(open_q), np.inf)
        np.minimum.at(lowest, back, lo[wins].astype(np.float64))
        with np.errstate(invalid="ignore", over="ignore"):
            start = np.zeros(len(open_q)) if level == 0 else np.nan_to_num(level * q_rest[open_q, 0] * block.most, nan=-np.inf, neginf=-np.inf)
            # a double next to a long's end may lie above it: step below, the exact scores decide
            t = np.maximum(start, np.where(lowest <= LEAST, -np.inf, lowest - np.abs(lowest) * 1e-12))
        i, j = block.join(q[open_q], q_rest[open_q], t)
        own = allowed[open_q[i], j]
        i, j = i[own], j[own]
        score = pair_products(q[open_q], block.x, i, j) if len(i) < 0.3 * len(open_q) * len(x) else products(q[open_q], block.x)[i, j]
        passed = t[i] <= score.astype(np.float64)
        i, j, score = i[passed], j[passed], score[passed]
        # pairs to windows: the pairs of an anchor stand together
        pairs = np.argsort(i, kind="stable")
        first = np.searchsorted(i[pairs], np.arange(len(open_q) + 1))
        width = (first[1:] - first[:-1])[back]
        win = np.repeat(np.arange(len(wins)), width)
        at = pairs[np.repeat(first[:-1][back] - np.concatenate([[0], np.cumsum(width)[:-1]]).astype(np.int64), width) + np.arange(width.sum())]
        inside = (score[at] >= lo[wins][win]) & (score[at] <= hi[wins][win])
        win, at = win[inside], at[inside]
        best, _ = first_k(win, score[at], null[j[at]].astype(np.int64), ids[j[at]], k)
        win, at = win[best], at[best]
        shut = (np.bincount(win, minlength=len(wins)) >= k) | (t[back] <= lo[wins].astype(np.float64))
        own = shut[win]
        out.append((wins[win[own]], j[at[own]], score[at[own]]))
        wins = wins[~shut]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _unit(rows: pa.Table, anchors: pa.Table, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """FOUND of one work unit."""
    names = ["anchor_id", "win", "id", "score"]
    row_dims, anchor_dims = rows["dim"].to_numpy(), anchors["dim"].to_numpy()
    for dim in np.intersect1d(row_dims, anchor_dims).tolist():
        r, a = rows.filter(pc.equal(rows["dim"], dim)), anchors.filter(pc.equal(anchors["dim"], dim))
        x, q = matrix(r["vec"].to_pylist(), dim), matrix(a["vec"].to_pylist(), dim)
        ids, null = numbers(r["id"])
        own, _ = numbers(a["id"])
        codes = {v: n for n, v in enumerate(set(r["label"].to_pylist()) | set(a["label"].to_pylist()))}
        r_label, a_label = (np.array([codes[v] for v in t["label"].to_pylist()]) for t in (r, a))
        lows, highs, ranks = (a[c].to_pylist() for c in ("lo", "hi", "wins"))
        step = max(1, CELLS // len(x))
        for at in range(0, len(q), step):
            end = min(at + step, len(q))
            of = np.repeat(np.arange(end - at), [len(w) for w in ranks[at:end]])
            lo, hi, win = (np.array([v for w in c[at:end] for v in w], np.int64) for c in (lows, highs, ranks))
            allowed = ((a_label[at:end, None] == r_label[None]) == same) & (null[None] | (own[at:end, None] != ids[None]))
            w, j, score = fill(q[at:end], x, allowed, ids, null, of, lo, hi, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[at:end][of[w]]), pa.array(win[w], pa.int32()), pa.array(ids[j], mask=null[j]),
                                              pa.array(score)], names=names)


def _ask(rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND: each window's first ``k`` of every unit (bucket, part, block) of ``asked``."""
    schema = pa.schema([("anchor_id", pa.int64()), ("win", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_unit(left, right, k, same)) if left.num_rows and right.num_rows else [], schema)

    wanted = asked.select(*UNIT).distinct()
    cols = [*UNIT, "id", "label", "dim", "vec"]
    return (apart(rows.join(apart(wanted), UNIT[:2]).select(*cols)).groupBy(*UNIT)
            .cogroup(apart(asked.select(*cols, "lo", "hi", "wins")).groupBy(*UNIT)).applyInArrow(run, FOUND))


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("anchor_id", "win").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


def windows_filled(rows: DataFrame, anchors: DataFrame, blocks: list[tuple[int, int]], k: int, same: bool) -> DataFrame:
    """(anchor_id, win, place, id, score): the first ``k`` of every window of ``anchors`` (id, label, dim, vec, block, bucket, wins, lo, hi).

    ``blocks`` are (bucket, its number of parts). Positives (``same``) are sought in the anchor's bucket, negatives in all.
    """
    parts = F.create_map(*[F.lit(x) for b in blocks for x in b])
    sizes = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("parts")) for b, n in blocks])
    every = F.flatten(F.transform(sizes, lambda b: F.transform(F.sequence(F.lit(0), b.parts - 1), lambda p: F.struct(b.bucket.alias("bucket"), p.alias("part")))))
    places = F.transform(F.sequence(F.lit(0), parts[F.col("bucket")] - 1), lambda p: F.struct(F.col("bucket"), p.alias("part"))) if same else every
    placed = anchors.withColumn("_places", places).withColumn("_home", F.pmod(F.xxhash64("id"), F.size("_places")).cast("int"))

    def asked(df: DataFrame, chosen: Column) -> DataFrame:
        return df.withColumn("_unit", F.explode(chosen)).drop("bucket").select("*", "_unit.bucket", "_unit.part").drop("_unit", "_places", "_home")

    home = written(_ask(rows, asked(placed, F.array(F.col("_places")[F.col("_home")])), k, same), "home")
    full = (home.groupBy(F.col("anchor_id").alias("id"), "win").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            .where("kth IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("win", "kth"))).alias("_kth")))
    lifted = F.transform("wins", lambda w, i: F.greatest(F.col("lo")[i], F.col("_kth")[w]))  # greatest() leaves nulls out
    others = F.filter("_places", lambda p, i: i != F.col("_home"))
    rest = asked(placed.join(full, "id", "left").withColumn("lo", lifted).drop("_kth"), others)
    return _first(home.union(_ask(rows, rest, k, same)), k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
         id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank of the rows that ``is_anchor`` (a condition on ``id``).

    ``label`` is an expression over ``vectors``; ``low`` (a, b) asks for a * positive_score <= b * negative_score.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors.where(label.isNotNull()), id_col, vec_col, label)
                   .withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")), "rows")
    sizes = rows.groupBy("bucket").agg(F.sum(F.length("vec")).alias("bytes")).collect()  # LABEL_BUCKETS rows at most
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    blocks = [(r.bucket, max(1, -(-r.bytes // block_bytes))) for r in sizes]
    parts = F.create_map(*[F.lit(x) for b in blocks for x in b])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("bucket")]).cast("int"))
    anchors = (rows.where(is_anchor & F.col("id").isNotNull()).groupBy("id")
               .agg(F.min(F.struct("label", "vec", "dim", "bucket")).alias("a")).select("id", "a.label", "a.vec", "a.dim", "a.bucket"))
    size = anchors.agg(F.sum(F.length("vec"))).first()[0] or 0
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // anchor_bytes)))).cast("int"))
    whole = anchors.withColumns({"wins": F.array(F.lit(0)), "lo": F.array(F.lit(LEAST - 1)), "hi": F.array(F.lit(MOST))})
    found = written(windows_filled(rows, whole, blocks, positives, same=True)
                    .select("anchor_id", F.col("place").cast("int").alias("win"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score")), "positives")
    a, b = low
    least = F.expr(f"CAST(ceil({a} * CAST(hi AS DECIMAL(30,0)) / {b}) AS LONG)")
    spans = (found.where("positive_score >= 0").select(F.col("anchor_id").alias("id"), "win", F.col("positive_score").alias("hi"))
             .select("id", F.struct("win", least.alias("lo"), "hi").alias("w")).groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("w"))
             .select("id", F.col("w.win").alias("wins"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    hard = windows_filled(rows, anchors.join(spans, "id"), blocks, negatives, same=False)
    return (hard.select("anchor_id", "win", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        F.col("score").alias("negative_score")).join(found, ["anchor_id", "win"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("win").alias("positive_rank")))
