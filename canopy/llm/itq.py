"""Embedding near-duplicates by iterative quantisation.

**Codes.** On a bounded sample (``SAMPLE`` distinct vectors, those of the smallest hash) the mean and the principal axes of the unit vectors
are taken, and a rotation is learnt that brings the rotated vectors near the corners of the cube: in turn the codes are set to the signs
and the rotation to the best one for these codes (an orthogonal Procrustes problem). Every vector then gets its ``bits`` signs, balanced bits
that differ more the wider the angle. If the codes find too few of the links within the sample (near copies of one vector are most of it, so
that the mean takes away what they have in common), a random rotation without a mean is taken instead.

**Multi-index Hamming tables.** The code is cut into ``TABLES`` segments, each the key of a table; a vector fetches the vectors of its label
whose segment differs in at most one bit in some table. In each table the side whose bit is 0 asks for the
other, and a pair counts in the first table that finds it, so that it counts once.

**Rerank.** All fetched pairs are compared with the original vectors in double precision; those with a cosine of at least
``least`` link.

**Groups of copies.** Equal vectors of a label are one *class* with a count from the start. Near copies may still
crowd one bucket, so a bucket's rows are dealt into blocks of about ``BLOCK`` and every pair of blocks is a work unit of its own, compared as one matrix
product. Pairs are never emitted: a task gives, for each vector, its number of links and one root that
its links connect it to. Link counts are sums of these; components come from the roots.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing;
vectors of different lengths never link; repeated rows are copies that link with each other; a null id takes part, and a component of null ids only has
a null component_id; an empty table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, written
from .components import connected_components
from .vectors import by_length, rotation, unit, usable

SAMPLE, ROUNDS, TABLES, BITS, LEAST = 20_000, 30, 4, 64, 0.98
BLOCK = 512
#: A fitted quantisation that finds less than this share of the links among so many vectors of its sample gives way to a random rotation that finds more.
TRIED, LEAST_FOUND = 2_000, 0.99
#: Pairs compared one by one at once, and links held before they are summed up.
PAIRS_AT_ONCE = 1 << 17

Model = dict[int, tuple[np.ndarray, np.ndarray]]  # vector length -> (mean, projection)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation fitted to the unit vectors ``x``."""
    mean = x.mean(axis=0)
    bits = min(bits, x.shape[1])
    _, _, axes = np.linalg.svd(np.cov((x - mean).T, bias=True).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    v = (x - mean) @ axes[:bits].T
    turn = rotation(bits)
    for _ in range(rounds):
        b = np.where(v @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(b.T @ v)
        turn = (left @ right).T
    return mean, axes[:bits].T @ turn


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signed 64-bit codes of unit vectors, bit i the sign of component i."""
    mean, project = model
    on = (x - mean) @ project > 0
    return (on.astype(np.uint64) << np.arange(on.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vec): label as text, vector as double bytes, null where a row can't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            held: list[bytes | None] = [None] * b.num_rows
            for i, v in zip(*usable(b.column(3))):
                if b.column(2)[int(i)].is_valid:
                    held[i] = (v.astype(np.float64) + 0.0).tobytes()  # one form of zero
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(held, pa.binary())], names=["row", "id", "label", "vec"])

    return rows.mapInArrow(run, "row long, id long, label string, vec binary")


def fit(vectors: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> Model:
    """One quantisation for each vector length in a sample of at most ``sample`` distinct ones of ``vectors``; copies count once."""
    some = vectors.where("vec IS NOT NULL").select(F.xxhash64("vec").alias("order"), F.md5("vec").alias("hash"), "vec")
    keys = some.select("order", "hash").distinct().orderBy("order", "hash").limit(sample)
    rows = some.join(F.broadcast(keys), ["order", "hash"]).groupBy("order", "hash").agg(F.first("vec").alias("vec")).collect()
    got = [np.frombuffer(r.vec) for r in sorted(rows, key=lambda r: (r.order, r.hash))]
    model = {}
    for same in by_length(np.array([len(v) for v in got], np.int64)):
        x = unit(np.stack([got[i] for i in same]))
        dim = x.shape[1]
        # where near copies of one vector are most of the sample, its mean is that vector and their codes are noise
        choices = [learn(x, bits), (np.zeros(dim), rotation(dim)[:, :bits])]
        shares = [found_share(x[:TRIED], m, bits) for m in choices]
        model[dim] = choices[shares[1] > shares[0] and shares[0] < LEAST_FOUND]
    return model


def found_share(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], bits: int, least: float = LEAST) -> float:
    """The share of the links among the unit vectors ``x`` that the tables of their codes find, 1 if there are none."""
    i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
    code = encode(x, model)
    differ = (code[i] ^ code[j]).view(np.uint64)
    found = np.zeros(len(i), bool)
    for low, width in _segments(bits):
        found |= np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= 1
    return float(found.mean()) if len(i) else 1.0


def with_code(classes: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """``classes`` with ``code``; lengths that the sample lacked get a random rotation."""
    schema = T.StructType([*classes.schema.fields, T.StructField("code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            vecs = [np.frombuffer(v) for v in b.column(b.schema.get_field_index("vec")).to_pylist()]
            code = np.zeros(len(vecs), np.int64)
            for same in by_length(np.array([len(v) for v in vecs], np.int64)):
                x = unit(np.stack([vecs[i] for i in same]))
                dim = x.shape[1]
                code[same] = encode(x, model.get(dim) or (np.zeros(dim), rotation(dim)[:, :bits]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    return classes.mapInArrow(run, schema)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each table's segment."""
    cuts = [bits * i // TABLES for i in range(TABLES + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(bits: int, ask: bool) -> Column:
    """The (seg, val) of a code in every table: its own, or (``ask``) those with one more bit set."""
    out = []
    for s, (low, width) in enumerate(_segments(bits)):
        val = f"(shiftrightunsigned(code, {low}) & {(1 << width) - 1}L)"
        if ask and width:
            out.append(f"transform(filter(sequence(0, {width - 1}), b -> getbit({val}, b) = 0),"
                       f" b -> named_struct('seg', {s}, 'val', {val} | shiftleft(1L, b)))")
        elif not ask:
            out.append(f"array(named_struct('seg', {s}, 'val', {val}))")
    return F.explode(F.expr(f"concat({', '.join(out)})")).alias("k")


def work_units(classes: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """(unit, side, seg, row, code, weight, vec): the rows of each pair of blocks of each bucket.

    A unit compares its side 0 with its side 1, or has side 2 only and compares that with itself.
    """
    cols = ["row", "group", "code", "weight", "vec"]
    flat = lambda ask: classes.select(*cols, _keys(bits, ask)).select(*cols, "k.seg", "k.val")
    held, asked = flat(False), flat(True)
    key = ["group", "seg", "val"]
    members = held.groupBy(*key).agg(F.count("*").alias("m"))
    askers = asked.groupBy(*key).agg(F.count("*").alias("a"))
    sizes = written(members.join(askers, key, "left").select(*key, "m", F.coalesce("a", F.lit(0)).alias("a"))
                    .where("m > 1 OR a > 0")
                    .withColumn("mb", F.ceil(F.col("m") / block)).withColumn("ab", F.ceil(F.col("a") / block)), "sizes")
    part = lambda n: F.expr(f"pmod(xxhash64(row), {n})")
    name = lambda kind: f"concat_ws('|', group, seg, val, '{kind}', x.i, x.j)"
    held = held.join(sizes, key).withColumn("b", part("mb"))
    # block b with itself and every other member block, then with every block of askers
    own = held.where("m > 1").withColumn("x", F.explode(F.expr(
        "transform(sequence(0L, mb - 1), o -> named_struct('i', least(b, o), 'j', greatest(b, o), 'side', if(b = o, 2, int(b > o))))")))
    left = held.where("a > 0").withColumn("x", F.explode(F.expr(
        "transform(sequence(0L, ab - 1), o -> named_struct('i', b, 'j', o, 'side', 0))")))
    right = asked.join(sizes, key).withColumn("b", part("ab")).withColumn("x", F.explode(F.expr(
        "transform(sequence(0L, mb - 1), o -> named_struct('i', o, 'j', b, 'side', 1))")))
    rows = [df.select(F.expr(name(kind)).alias("unit"), "x.side", "seg", "row", "code", "weight", "vec")
            for kind, df in (("M", own), ("A", left), ("A", right))]
    return rows[0].union(rows[1]).union(rows[2])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the components of the pairs (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


class Links:
    """Compares the rows of work units; holds the links found until they are summed up."""

    def __init__(self, bits: int, least: float) -> None:
        self.segments, self.least = _segments(bits), least
        self.some: list[tuple] = []  # small units, whose pairs are compared together
        self.pending = 0
        self.links: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, seg: int, side: np.ndarray, row: np.ndarray, code: np.ndarray, weight: np.ndarray, unit_vecs: np.ndarray) -> None:
        itself = side[0] == 2
        left, right = (np.arange(len(side)),) * 2 if itself else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
        n = len(left) * len(right)
        if n > 4096:
            i, j = np.nonzero(unit_vecs[left] @ unit_vecs[right].T >= self.least)
            if itself:
                i, j = i[i < j], j[i < j]
            self._keep(seg, row, code, weight, left[i], right[j])
        elif n:
            i, j = np.triu_indices(len(left), 1) if itself else (np.repeat(left, len(right)), np.tile(right, len(left)))
            self.some.append((seg, row, code, weight, unit_vecs, i, j))
            self.pending += len(i)
            if self.pending > PAIRS_AT_ONCE:
                self.compare()

    def compare(self) -> None:
        """The pairs of the small units that wait."""
        for dim in {s[4].shape[1] for s in self.some}:
            some = [s for s in self.some if s[4].shape[1] == dim]
            first = np.cumsum([0, *(len(s[1]) for s in some)])
            row, code, weight, vecs = (np.concatenate([s[c] for s in some]) for c in (1, 2, 3, 4))
            i = np.concatenate([s[5] + f for s, f in zip(some, first)])
            j = np.concatenate([s[6] + f for s, f in zip(some, first)])
            seg = np.concatenate([np.full(len(s[5]), s[0]) for s in some])
            linked = (vecs[i] * vecs[j]).sum(axis=1) >= self.least
            self._keep(seg[linked], row, code, weight, i[linked], j[linked])
        self.some, self.pending = [], 0

    def _keep(self, seg, row, code, weight, i: np.ndarray, j: np.ndarray) -> None:
        differ = (code[i] ^ code[j]).view(np.uint64)
        first = np.ones(len(i), bool)  # no earlier table finds the pair
        for s, (low, width) in enumerate(self.segments):
            part = (differ >> np.uint64(low)) & np.uint64((1 << width) - 1)
            first &= (np.bitwise_count(part) > 1) | (s >= np.asarray(seg))
        i, j = i[first], j[first]
        if len(i):
            self.links.append((row[i], row[j], weight[i], weight[j]))
            self.held += len(i)

    def summed(self) -> pa.RecordBatch | None:
        """(row, links, root) of every row with links since the last call."""
        if not self.links:
            return None
        a, b, wa, wb = (np.concatenate(c) for c in zip(*self.links))
        self.links, self.held = [], 0
        nodes, roots = _forest(a, b)
        counts = np.bincount(np.searchsorted(nodes, np.concatenate([a, b])), np.concatenate([wb, wa]), len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts.astype(np.int64)), pa.array(roots)], names=["row", "links", "root"])


def linked(units: DataFrame, bits: int, least: float = LEAST) -> DataFrame:
    """(row, links, root): partial link counts of classes, and classes that their links connect them to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, open_unit, waiting = Links(bits, least), None, []

        def close() -> None:
            side, seg, row, code, weight, vec = zip(*waiting)
            links.add(seg[0], np.array(side), np.array(row), np.array(code, np.int64), np.array(weight, np.float64),
                      unit(np.frombuffer(b"".join(vec)).reshape(len(vec), -1)))

        for b in slices(batches, 4096):
            names, *cols = (c.to_pylist() for c in b.columns)
            for name, rows in groupby(zip(names, *cols), key=lambda r: r[0]):
                if name != open_unit and waiting:
                    close()
                    waiting = []
                    if links.held > PAIRS_AT_ONCE:
                        yield links.summed()
                open_unit = name
                waiting += [r[1:] for r in rows]
        if waiting:
            close()
        links.compare()
        if (rest := links.summed()) is not None:
            yield rest

    return (units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "row long, links long, root long"))


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", bits: int = BITS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                          F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    seen = written(_vectors(rows, id_col, vec_col, label_col), "vectors")
    model = fit(seen, bits, sample)
    same = seen.where("vec IS NOT NULL").select("row", "id", F.concat_ws(":", F.octet_length("vec"), "label").alias("group"), F.md5("vec").alias("hash"), "vec")
    classes = written(with_code(same.groupBy("group", "hash").agg(
        F.min("row").alias("row"), F.min("id").alias("least"), F.count("*").alias("weight"), F.min("vec").alias("vec")), model, bits), "classes")
    # codes have at most as many bits as the shortest vectors' length; unused bits are 0 in all of a group
    found = written(linked(work_units(classes, bits, block), bits, least), "found")
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("row").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "row")
    of_class = (classes.select("group", "hash", "row", "least", "weight").join(counts, "row", "left").join(roots, "row", "left")
                .withColumn("root", F.coalesce("root", "row")))
    ids = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    told = (of_class.join(ids, "root")
            .select("group", "hash", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    part = same.select("id", "group", "hash").join(told, ["group", "hash"]).select("id", "n_links", "component_id")
    rest = seen.where("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return part.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id",
                                   F.expr("id <=> component_id").alias("kept"))
