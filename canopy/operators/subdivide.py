"""Cut shapes with very many vertices into pieces of bounded size.

A state or biome boundary carries 10^4 to 10^6 vertices; a candidate pair that
held all of them would cost that much for every small shape it meets.
``subdivide`` cuts such a shape along vertical and horizontal lines, again and
again at the median of its edges, until no piece has more than ``max_edges``.

Pieces are oriented edge sets like any shape. A vertical cut needs no closing
edges (vertical edges span no trapezoid). A horizontal cut at ``y = c`` closes
both halves with the stretches of the line that lie inside the shape: the
net signed cover of the line by the edges above it, so stretches that cancel
disappear and the pieces shrink. Whatever touches such a seam touches
the shape's inside, so intersects, within and areas over all pieces of a shape are those of the
shape. ``area`` stays that of the whole shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.geometry import EDGES

#: Cuts in a row after which a piece is kept as it is (edges that all pass one point cannot be parted).
MAX_DEPTH = 40


def _cut(e: np.ndarray, axis: int, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, 4) cut by the line where coordinate ``axis`` is ``c``: (low, high), unclosed."""
    a, b = e[:, axis], e[:, axis + 2]
    low, high = (a <= c) & (b <= c), (a >= c) & (b >= c)
    cross = ~low & ~high
    x = e[cross]
    t = (c - x[:, axis]) / (x[:, axis + 2] - x[:, axis])
    other = x[:, 1 - axis] + t * (x[:, 3 - axis] - x[:, 1 - axis])
    mid = np.empty((len(x), 2))
    mid[:, axis], mid[:, 1 - axis] = c, other
    first, last = np.column_stack([x[:, :2], mid]), np.column_stack([mid, x[:, 2:]])
    up = x[:, axis] < c  # the edge comes from the low side
    return (np.concatenate([e[low], first[up], last[~up]]),
            np.concatenate([e[high & ~low], last[up], first[~up]]))


def _cover(e: np.ndarray, c: float) -> np.ndarray:
    """The edges projected on ``y = c``, stretches that cancel removed."""
    e = e[e[:, 0] != e[:, 2]]
    if not len(e):
        return np.zeros((0, 4))
    way = np.sign(e[:, 2] - e[:, 0])
    xs = np.concatenate([np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])])
    at, where = np.unique(xs, return_inverse=True)
    net = np.cumsum(np.bincount(where, np.concatenate([way, -way]), len(at)))[:-1].round().astype(int)
    # neighbouring stretches of one cover are joined
    starts = np.flatnonzero(np.diff(net, prepend=net[0] + 1))
    ends = np.append(starts[1:], len(net))
    rows = [(at[s], at[t], n) for s, t, n in zip(starts, ends, net[starts]) if n]
    return np.array([(l, c, r, c) if n > 0 else (r, c, l, c) for l, r, n in rows for _ in range(abs(n))], float).reshape(-1, 4)


def pieces(e: np.ndarray, max_edges: int, depth: int = MAX_DEPTH) -> list[np.ndarray]:
    """Oriented edges (n, 4) cut into edge sets of at most ``max_edges``."""
    if len(e) <= max_edges or not depth:
        return [e]
    spans = [np.ptp(e[:, [k, k + 2]]) for k in (0, 1)]
    for axis in sorted((0, 1), key=lambda k: -spans[k]):
        low, high = e[:, [axis, axis + 2]].min(), e[:, [axis, axis + 2]].max()
        c = float(np.median((e[:, axis] + e[:, axis + 2]) / 2))
        if not low < c < high:
            c = (low + high) / 2
        if not low < c < high:
            continue
        below, above = _cut(e, axis, c)
        if axis == 1:
            seam = _cover(above, c)
            below, above = np.concatenate([below, seam]), np.concatenate([above, seam[:, [2, 3, 0, 1]]])
        if max(len(below), len(above)) < len(e):
            return pieces(below, max_edges, depth - 1) + pieces(above, max_edges, depth - 1)
    return [e]


def _pieces_udf(max_edges: int):
    @arrow_udf(T.ArrayType(EDGES))
    def cut(edges: pa.Array) -> pa.Array:
        out = []
        for v in edges:
            if not v.is_valid:
                out.append(None)
                continue
            e = np.column_stack([v.values.field(k).to_numpy(zero_copy_only=False) for k in ("ax", "ay", "bx", "by")])
            out.append([[dict(zip(("ax", "ay", "bx", "by"), r)) for r in p.tolist()] for p in pieces(e, max_edges) if len(p)])
        return pa.array(out, edge_lists)

    edge_lists = pa.list_(pa.list_(pa.struct([(k, pa.float64()) for k in ("ax", "ay", "bx", "by")])))
    return cut.asNondeterministic()  # a pure function, never to be evaluated twice


def subdivide(layer: DataFrame, max_edges: int = 256) -> DataFrame:
    """``layer`` with every shape of more than ``max_edges`` edges as several rows, one per piece.

    All other columns repeat, ``area`` included; edges and box are the piece's. Smaller shapes pass
    without a trip through Python.
    """
    large = F.when(F.size("edges") > max_edges, F.col("edges"))
    parts = F.coalesce(_pieces_udf(max_edges)(large), F.array("edges"))
    out = layer.withColumn("_cut", F.size("edges") > max_edges).withColumn("_parts", parts)
    out = out.select(*[c for c in layer.columns if c != "edges"], "_cut", F.explode("_parts").alias("edges"))
    ends = {c: (lambda f, k: f(F.transform("edges", lambda e: e[k])))(F.array_min if c[1] == "0" else F.array_max, f"a{c[0]}")
            for c in ("x0", "y0", "x1", "y1")}
    other = {c: (lambda f, k: f(F.transform("edges", lambda e: e[k])))(F.array_min if c[1] == "0" else F.array_max, f"b{c[0]}")
             for c in ("x0", "y0", "x1", "y1")}
    pick = {c: (F.least if c[1] == "0" else F.greatest)(ends[c], other[c]) for c in ends}
    return out.select(*[F.when(F.col("_cut"), pick[c]).otherwise(F.col(c)).alias(c) if c in pick else F.col(c) for c in layer.columns])
