"""Nearest neighbours by randomly rotated one-bit codes.

**Codes.** Every vector is scaled to length 1, rotated by one random orthogonal matrix P and kept as the signs of its
components, ``dim`` packed bits, with one correction scalar: the inner product c of the rotated vector with its code
(the signs over sqrt(dim)). All rows get a code; nothing is fitted.

**Estimate and bound.** For a query q the inner product is estimated as <code, P q> / c; its error is at most
``EPSILON`` * sqrt((1 - c^2) / c^2 / (dim - 1)) with a probability that falls as exp(-EPSILON^2 / 2).

**Search.** The codes are scanned in blocks against a block of at most about ``QUERY_BLOCK`` queries. A task keeps each query's k best
exact scores so far; a row is reranked with its original vector, in double precision, only if its estimate plus its bound
reaches the k-th of these (at first, the k-th best lower bound of the block). So the bounds, not a fixed number, choose what is reranked,
and ties and groups of copies are never cut off. A task gives k rows a query, and the k best of these over all tasks are the result.

A block of queries is a bounded constant (``QUERY_BLOCK`` vectors) sent to all tasks; further blocks are scanned one after another,
each adding its rows to a table in the shared folder.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as
candidate; vectors are compared with those of their own length only; candidates of a query are all rows with another id (or a null id), repeated
rows each on their own; of rows that repeat a query's id the smallest vector is the query; ties go to the smaller id, null ids last; an empty table
gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch_path, slices, written
from .vectors import by_length, rotation, unit, usable

EPSILON = 3.0
QUERY_BLOCK, CODE_BLOCK = 2048, 2048


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of the rows of ``x``."""
    r = unit(x) @ rotation(x.shape[1])
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / np.sqrt(x.shape[1])


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, code, scalar, vec) of the rows that hold a usable vector; ``vec`` are its original bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, CODE_BLOCK):
            rows, vecs = usable(b.column(1))
            for same in by_length(np.array([len(v) for v in vecs], np.int64)):
                x = np.stack([vecs[i] for i in same])
                bits, scalar = encode(x)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(rows[same])), pa.array(np.full(len(x), x.shape[1]), pa.int32()),
                    pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(scalar),
                    pa.array([v.astype(np.float64).tobytes() for v in x], pa.binary())], names=["id", "dim", "code", "scalar", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(
        run, "id long, dim int, code binary, scalar double, vec binary")


class Best:
    """The k best exact scores of each of a block of queries of one dimension, so far."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int) -> None:
        self.ids, self.k, self.q = ids, k, unit(vecs)
        self.rotated = (self.q @ rotation(vecs.shape[1])).astype(np.float32)
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.least = np.full(len(ids), -np.inf)

    def scan(self, ids: list, bits: np.ndarray, scalar: np.ndarray, vecs: np.ndarray) -> None:
        dim = vecs.shape[1]
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        estimate = (signs @ self.rotated.T) / (np.sqrt(dim) * scalar)[:, None]
        bound = EPSILON * np.sqrt(np.maximum(1 - scalar**2, 0) / scalar**2 / max(dim - 1, 1)) + 1e-6
        upper = estimate + bound[:, None]
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        has = np.array([i is not None for i in ids])
        units = unit(vecs)
        for j, own in enumerate(self.ids):
            floor = self.least[j]
            others = ~(has & (known == own))
            if floor == -np.inf and others.sum() > self.k:
                floor = np.partition((estimate[:, j] - bound)[others], -self.k)[-self.k]
            rows = np.nonzero((upper[:, j] >= floor) & others)[0]
            if len(rows):
                exact = (units[rows] * self.q[j]).sum(axis=1)
                if len(rows) > self.k:  # equals of the k-th stay in, for the ids to decide
                    kept = exact >= np.partition(exact, -self.k)[-self.k]
                    rows, exact = rows[kept], exact[kept]
                new = ((-s, (not has[r], known[r])) for s, r in zip(exact.tolist(), rows.tolist()))
                self.found[j] = sorted([*self.found[j], *new])[:self.k]
                if len(self.found[j]) == self.k:
                    self.least[j] = -self.found[j][-1][0]


def search_block(coded: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """(query_id, id, score): each task's k best rows for each of ``queries`` (id, double bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for dim in sorted({len(v) // 8 for _, v in queries}):
            own = [(i, np.frombuffer(v)) for i, v in queries if len(v) == 8 * dim]
            best[dim] = Best(np.array([i for i, _ in own], np.int64), np.stack([v for _, v in own]), k)
        for b in slices(batches, CODE_BLOCK):
            ids, dims = b.column(0).to_pylist(), b.column(1).to_numpy()
            code, scalar, vec = b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_pylist()
            for same in by_length(dims):
                if (dim := int(dims[same[0]])) in best:
                    best[dim].scan([ids[i] for i in same], np.stack([np.frombuffer(code[i], np.uint8) for i in same]), scalar[same],
                                   np.stack([np.frombuffer(vec[i]) for i in same]))
        rows = [(int(q), None if null else i, -s) for x in best.values() for q, found in zip(x.ids, x.found) for s, (null, i) in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))],
                                             names=["query_id", "id", "score"])

    return coded.mapInArrow(run, "query_id long, id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, score: the ``k`` largest cosines of every row that ``is_query`` (a condition on ``id``)."""
    spark = vectors.sparkSession
    coded = written(codes(vectors, id_col, vec_col), "codes")
    queries = coded.where(is_query & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-queries.count() // query_block))
    path = scratch_path(spark, "nearest")
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()  # about query_block rows
        search_block(coded, [(r.id, bytes(r.vec)) for r in own], k).write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, id long, score double").parquet(path)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
