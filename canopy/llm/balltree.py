"""Exact top-k search by integer inner product: ball-tree branch and bound per shard.

**Shards.** Up to ``PIVOTS`` rows, drawn at random, are pivots; every row goes to its nearest one's cluster, and a cluster is dealt at random into
shards of about ``SHARD_BYTES``. So a group of copies, however large, fills several shards, and a shard fits a task. A cluster's pivot and its
farthest row are a ball around all its shards.

**Trees.** Each shard becomes one ball tree: a node holds a centre and a radius, is cut in the middle along the line through two far rows, and ends in
leaves of at most ``LEAF`` rows. No row below a node has an inner product with q over <q, centre> + |q| radius.

**Search.** A query first descends its own shard's tree, the more promising child first, and leaves out every node whose bound lies below its current
k-th score (a node that only reaches it is visited: an equal score may have a smaller id). Its k-th score then goes with it to the other
shards: clusters whose ball can't reach it are not asked at all, and the trees asked start with it. Bounds are taken in double
precision with a margin, scores are exact whole numbers; nothing is approximate or cut off.

A work unit is one tree and a block of queries of at most about ``QUERY_BYTES``; units are dealt out by one shuffle.

Defined cases: components x become floor(256 * x); vectors that are null, empty, or hold null or non-finite components (also once multiplied) take no
part, neither as query nor as candidate, zero vectors do; vectors are compared with those of their own length only; candidates of a query are
all rows with another id (or a null id), repeated rows each on their own; of rows that repeat a query's id the smallest vector (by its packed
bytes) is the query; ties go to the smaller id, null ids last; scores beyond the range of a long are that range's ends; an empty table gives an empty
result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, written
from .intvec import LEAST, apart, first_k, integer_vectors, matrix, numbers, products

PIVOTS, PIVOT_BYTES = 256, 4 << 20
#: Pivots drawn: so many to a shard that the rows fill, at least these.
PER_SHARD, LEAST_PIVOTS = 4, 16
SHARD_BYTES, QUERY_BYTES = 4 << 20, 1 << 20
LEAF = 128
#: Groups of fewer queries than this descend together, by what most of them prefer.
SPLIT = 32
#: Clusters of rows that no pivot has the length of: dealt over so many numbers.
OTHERS = 64

FOUND = "query_id long, id long, score long"
ASKED = ["id", "dim", "vec", "kth"]
TREE = ["dim", "ids", "null", "vecs", "lo", "hi", "left", "centre", "radius"]


def _margin(q: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Upper bounds of <q, x> over the balls (c, r), rounding included; never NaN."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        far = np.sqrt((c * c).sum(axis=1))[None] + r[None]
        bound = q @ c.T + length * r[None] + 1e-9 * length * far + 1
    return np.where(np.isnan(bound), np.inf, bound)


class BallTree:
    """Balls over the rows of ``x``; node 0 is the root, a leaf has no children (left = 0), a right child follows its left one."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        self.lo, self.hi, self.left, centres, radii = [0], [len(x)], [0], [], []
        node = 0
        while node < len(self.lo):
            own = order[self.lo[node]:self.hi[node]]
            rows = x[own]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max() * (1 + 1e-9))
            if len(own) > leaf:
                a = rows[away.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = len(own) // 2
                order[self.lo[node]:self.hi[node]] = own[np.argpartition(rows @ (a - b), half)]
                self.left[node] = len(self.lo)
                middle = self.lo[node] + half
                self.lo += [self.lo[node], middle]
                self.hi += [middle, self.hi[node]]
                self.left += [0, 0]
            node += 1
        self.order, self.centre, self.radius = order, np.array(centres), np.array(radii)


class Best:
    """The k best (score, null id, id) of each of a block of queries; unfilled places have null = 2."""

    def __init__(self, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.own, self.q, self.k = own, q, k
        self.score = np.full((len(q), k), LEAST - 1, np.int64)
        self.null, self.ids = np.full((len(q), k), 2, np.int64), np.zeros((len(q), k), np.int64)
        self.kth = floor.copy()  # no score below it is of use; equal ones are

    def add(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score = products(self.q[rows], x)
        i, j = np.nonzero((score >= self.kth[rows][:, None]) & (null[None] | (ids[None] != self.own[rows][:, None])))
        if not len(i):
            return
        hit = np.unique(i)
        group = np.concatenate([i, np.repeat(hit, self.k)])
        held = rows[hit]
        scores = np.concatenate([score[i, j], self.score[held].ravel()])
        nulls = np.concatenate([null[j].astype(np.int64), self.null[held].ravel()])
        known = np.concatenate([ids[j], self.ids[held].ravel()])
        at, rank = first_k(group, scores, nulls, known, self.k)
        to = rows[group[at]]
        self.score[to, rank], self.null[to, rank], self.ids[to, rank] = scores[at], nulls[at], known[at]
        last = self.null[held, -1] < 2
        self.kth[held] = np.where(last, np.maximum(self.kth[held], self.score[held, -1]), self.kth[held])

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.null < 2)
        return pa.RecordBatch.from_arrays([pa.array(self.own[i]), pa.array(self.ids[i, j], mask=self.null[i, j] == 1), pa.array(self.score[i, j])],
                                          names=["query_id", "id", "score"])


def descend(tree: dict, best: Best) -> None:
    """Branch and bound of all queries of ``best`` over one tree (arrays as ``packed_tree`` names them)."""
    bound = _margin(best.q, tree["centre"], tree["radius"])
    todo = [(0, np.arange(len(best.q)))]
    while todo:
        node, rows = todo.pop()
        rows = rows[bound[rows, node] >= best.kth[rows]]
        if not len(rows):
            continue
        child = int(tree["left"][node])
        if not child:
            own = slice(int(tree["lo"][node]), int(tree["hi"][node]))
            best.add(rows, tree["vecs"][own], tree["ids"][own], tree["null"][own])
            continue
        first = bound[rows, child] >= bound[rows, child + 1]
        if len(rows) < SPLIT:
            first[:] = first.mean() >= 0.5
        for side, near in ((first, child), (~first, child + 1)):
            if side.any():
                todo += [(2 * child + 1 - near, rows[side]), (near, rows[side])]


def packed_tree(ids: np.ndarray, null: np.ndarray, packed: list[bytes], dim: int) -> dict:
    """The columns of TREE of one shard's rows of one length."""
    x = matrix(packed, dim)
    t = BallTree(x)
    return {"dim": dim, "ids": ids[t.order].tobytes(), "null": null[t.order].tobytes(), "vecs": x[t.order].tobytes(),
            "lo": np.array(t.lo, np.int64).tobytes(), "hi": np.array(t.hi, np.int64).tobytes(), "left": np.array(t.left, np.int64).tobytes(),
            "centre": t.centre.tobytes(), "radius": t.radius.tobytes()}


def unpacked_tree(row: dict) -> dict:
    kinds = {"ids": np.int64, "null": bool, "lo": np.int64, "hi": np.int64, "left": np.int64}
    out = {c: np.frombuffer(row[c], kinds.get(c, np.float64)) for c in TREE[1:]}
    return {**out, "vecs": out["vecs"].reshape(-1, row["dim"]), "centre": out["centre"].reshape(-1, row["dim"]), "dim": row["dim"]}


def _asked(table: pa.Table, dim: int, k: int) -> Best | None:
    """The queries (id, dim, vec, kth) of one length."""
    own = table.filter(pc.equal(table["dim"], dim))
    if not own.num_rows:
        return None
    kth = pc.fill_null(own["kth"].combine_chunks(), LEAST - 1).to_numpy(zero_copy_only=False)
    return Best(numbers(own["id"])[0], matrix(own["vec"].to_pylist(), dim), kth.astype(np.int64), k)


def shard_trees(rows: DataFrame) -> DataFrame:
    """(cluster, part, *TREE): one row per shard and vector length."""
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, null = numbers(table["id"])
        dims, packed = table["dim"].to_numpy(), table["vec"].to_pylist()
        out = []
        for dim in np.unique(dims).tolist():
            at = np.nonzero(dims == dim)[0]
            out.append({"cluster": key[0].as_py(), "part": key[1].as_py(), **packed_tree(ids[at], null[at], [packed[i] for i in at], dim)})
        return pa.Table.from_pylist(out, schema=pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("dim", pa.int32()),
                                                           *[(c, pa.binary()) for c in TREE[1:]]]))

    return (rows.select("cluster", "part", "id", "dim", "vec").groupBy("cluster", "part")
            .applyInArrow(build, "cluster int, part int, dim int, " + ", ".join(f"{c} binary" for c in TREE[1:])))


def ask(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND: of every (cluster, part, block) of ``asked`` (and id, dim, vec, kth), each query's best rows of that shard."""
    keys = ["cluster", "part", "block"]
    wanted = asked.select(*keys).distinct()

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist() if right.num_rows else []:
            best = _asked(right, row["dim"], k)
            if best is not None:
                descend(unpacked_tree(row), best)
                out.append(best.found())
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    return (apart(trees.join(apart(wanted), ["cluster", "part"])).groupBy(*keys).cogroup(apart(asked).groupBy(*keys)).applyInArrow(run, FOUND))


class Clusters:
    """At most PIVOTS vectors that rows are clustered by, per vector length."""

    def __init__(self, sample: list[tuple[int, bytes]]) -> None:
        by_dim: dict[int, list[bytes]] = {}
        for dim, packed in sample:
            by_dim.setdefault(dim, []).append(bytes(packed))
        self.first, self.of, at = {}, {}, 0
        for dim, own in sorted(by_dim.items()):
            self.of[dim] = np.unique(matrix(own, dim), axis=0)
            self.first[dim] = at
            at += len(self.of[dim])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, distance to its pivot) of rows of one length; without pivots, numbers below 0 and no bound."""
        dim = x.shape[1]
        if dim not in self.of:
            return np.full(len(x), -1 - dim % OTHERS), np.full(len(x), np.inf)
        pivots = self.of[dim]
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.nan_to_num((pivots**2).sum(axis=1)[None] - 2 * (x @ pivots.T)).argmin(axis=1)
            away = np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)) * (1 + 1e-9)
        return near + self.first[dim], away


def clustered(rows: DataFrame, clusters: Clusters) -> DataFrame:
    """``rows`` (id, dim, vec, row) with their cluster and the distance to its pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            dims, packed = b.column(1).to_numpy(), b.column(2).to_pylist()
            near, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                near[at], away[at] = clusters.nearest(matrix([packed[i] for i in at], dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(away)], names=["id", "dim", "vec", "row", "cluster", "away"])

    return rows.select("id", "dim", "vec", "row").mapInArrow(run, "id long, dim int, vec binary, row long, cluster int, away double")


def elsewhere(queries: DataFrame, clusters: Clusters, parts: dict[int, int], radius: dict[int, float]) -> DataFrame:
    """(cluster, part, id, dim, vec, kth): every other shard that may hold one of a query's k best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            cols = {c: b.column(b.schema.get_field_index(c)) for c in ("cluster", "part", *ASKED)}
            dims, packed = cols["dim"].to_numpy(), cols["vec"].to_pylist()
            kth = cols["kth"].to_pylist()
            home = list(zip(cols["cluster"].to_pylist(), cols["part"].to_pylist()))
            row, cluster, part = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                near = [c for c in (range(clusters.first[dim], clusters.first[dim] + len(clusters.of[dim])) if dim in clusters.of
                                    else [-1 - dim % OTHERS]) if c in parts]
                bound = np.full((len(at), len(near)), np.inf)
                if dim in clusters.of and near:
                    balls = clusters.of[dim][np.array(near) - clusters.first[dim]]
                    bound = _margin(matrix([packed[i] for i in at], dim), balls, np.array([radius[c] for c in near]))
                for n, i in enumerate(at):
                    for m, c in enumerate(near):
                        if kth[i] is None or bound[n, m] >= kth[i]:
                            own = [p for p in range(parts[c]) if (c, p) != home[i]]
                            row += [i] * len(own)
                            cluster += [c] * len(own)
                            part += own
            for at in range(0, len(row), 4096):
                own = slice(at, at + 4096)
                taken = pa.array(row[own], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cluster[own], pa.int32()), pa.array(part[own], pa.int32()),
                                                  *[cols[c].take(taken) for c in ASKED]], names=["cluster", "part", *ASKED])

    return queries.mapInArrow(run, "cluster int, part int, id long, dim int, vec binary, kth long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_bytes: int = SHARD_BYTES,
           pivots: int = PIVOTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, ``id_col``, score: the ``k`` largest integer inner products of every row that ``is_query`` (a condition on ``id``)."""
    raw = written(integer_vectors(vectors, id_col, vec_col).select("id", "dim", "vec", "row"), "vectors")
    longest, size = (x or 1 for x in raw.agg(F.max("dim"), F.sum(F.length("vec"))).first())
    most = min(pivots, PIVOT_BYTES // (8 * longest), max(PER_SHARD * -(-size // shard_bytes), LEAST_PIVOTS))
    clusters = Clusters([(r.dim, r.vec) for r in raw.select("dim", "vec").orderBy(F.rand(7)).limit(max(1, most)).collect()])
    rows = written(clustered(raw, clusters), "rows")
    stats = rows.groupBy("cluster").agg(F.sum(F.length("vec")).alias("bytes"), F.max("away").alias("away")).collect()  # PIVOTS + OTHERS rows at most
    parts = {r.cluster: max(1, -(-r.bytes // shard_bytes)) for r in stats}
    radius = {r.cluster: r.away for r in stats}
    count = F.element_at(F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p)]), F.col("cluster")) if parts else F.lit(1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), count).cast("int"))
    trees = written(shard_trees(rows), "trees")
    queries = (rows.where(is_query & F.col("id").isNotNull()).groupBy("id")
               .agg(F.min(F.struct("vec", "row", "dim", "cluster", "part")).alias("q")).select("id", "q.dim", "q.vec", "q.cluster", "q.part"))
    size = queries.agg(F.sum(F.length("vec"))).first()[0] or 0
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // query_bytes)))).cast("int")
    home = written(ask(trees, queries.withColumn("block", block).withColumn("kth", F.lit(None).cast("long")), k), "home")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    kth = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    rest = elsewhere(queries.join(kth, "id", "left"), clusters, parts, radius).withColumn("block", block)
    found = home.union(ask(trees, rest, k)).withColumn("rank", place).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
