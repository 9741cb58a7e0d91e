"""Edge-pair terms for intersection area (G12) and boundary contact.

Published geometry, written as column arithmetic so it runs inside
whole-stage codegen:

* With shells counter-clockwise and holes clockwise, let ``T_e`` be the
  trapezoid between a non-vertical edge ``e`` and a base line ``y = yb`` below
  both shapes, signed ``s_e = sign(ax - bx)``. A shape's indicator is
  ``sum_e s_e 1[T_e]``, so ``|A n B| = sum_ij s_i s_j |T_i n T_j|`` and
  ``|T_i n T_j|`` is the integral of ``min(y_i, y_j) - yb`` over the common x
  range: one trapezoid, or two when the edge lines cross inside it.
* Two closed segments meet iff their boxes meet and each segment's end
  points are not strictly on the same side of the other's line.

Only edge pairs whose closed x ranges overlap can contribute to either sum,
so :func:`edge_pair_terms` filters on that first. The arithmetic is applied
in a few projections, each naming its intermediate values once, so the
fused (whole-stage) code stays under the JVM's method size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def edge_pair_terms(df: DataFrame, keep: list[str], ea: str = "_ea", eb: str = "_eb",
                    yb: str = "_yb") -> DataFrame:
    """Per edge pair: ``_t`` (signed trapezoid overlap) and ``_m`` (segments meet).

    ``df`` holds two edge structs per row plus the pair's base line ``yb``.
    Rows whose closed x ranges do not overlap are dropped (they contribute
    nothing to either sum).

    Over the common range ``[lo, hi]`` of width ``w`` the two edge lines
    differ by ``d``, linear with end values ``dl, dh``; then
    ``integral of min(ya, yb) = w * mean(ya, yb) - integral |d| / 2`` and
    ``integral |d| = w |dl + dh| / 2`` when ``dl, dh`` share a sign, else
    ``w (dl^2 + dh^2) / (2 (|dl| + |dh|))`` (two triangles).
    """
    q = lambda c: f"`{c}`"
    kp = [q(c) for c in keep]
    s = df.selectExpr(*kp, f"{yb} AS _yb", f"{ea} AS _a", f"{eb} AS _b",
                      f"greatest(least({ea}.ax, {ea}.bx), least({eb}.ax, {eb}.bx)) AS lo",
                      f"least(greatest({ea}.ax, {ea}.bx), greatest({eb}.ax, {eb}.bx)) AS hi")
    s = s.where("lo <= hi")
    # Heights above yb at both ends of the common range; the slope is only
    # used where the range is non-degenerate, so neither edge is vertical
    # there (nullif keeps ANSI mode from raising on the others).
    ka = "((_a.by - _a.ay) / nullif(_a.bx - _a.ax, 0D))"
    kb = "((_b.by - _b.ay) / nullif(_b.bx - _b.ax, 0D))"
    s = s.selectExpr(*kp, "_a", "_b", "lo", "hi",
                     f"_a.ay - _yb + {ka} * (lo - _a.ax) AS yal", f"_a.ay - _yb + {ka} * (hi - _a.ax) AS yah",
                     f"_b.ay - _yb + {kb} * (lo - _b.ax) AS ybl", f"_b.ay - _yb + {kb} * (hi - _b.ax) AS ybh")
    s = s.selectExpr(*kp, "_a", "_b", "hi - lo AS w", "yal + yah + ybl + ybh AS ysum",
                     "yal - ybl AS dl", "yah - ybh AS dh")

    def orient(p, r, c):
        return (f"signum(({p}.bx - {p}.ax) * ({r}.{c}y - {p}.ay) - ({p}.by - {p}.ay) * ({r}.{c}x - {p}.ax))")
    absd = ("CASE WHEN dl * dh >= 0 THEN abs(dl + dh) / 2 "
            "ELSE (dl * dl + dh * dh) / (2 * (abs(dl) + abs(dh))) END")
    term = (f"CASE WHEN w > 0 THEN signum(_a.ax - _a.bx) * signum(_b.ax - _b.bx) * w * (ysum / 4 - ({absd}) / 2) "
            "ELSE 0D END")
    meet = ("least(_a.ay, _a.by) <= greatest(_b.ay, _b.by) AND least(_b.ay, _b.by) <= greatest(_a.ay, _a.by)"
            f" AND {orient('_a', '_b', 'a')} * {orient('_a', '_b', 'b')} <= 0"
            f" AND {orient('_b', '_a', 'a')} * {orient('_b', '_a', 'b')} <= 0")
    return s.selectExpr(*kp, f"{term} AS _t", f"{meet} AS _m")


def _orient(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


# Relative size below which an intersection area counts as rounding noise.
# Without any boundary contact two valid shapes either share a whole part
# (area of that part) or nothing, so this only absorbs float error.
AREA_EPS = 1e-9


def area_positive(inter_area: Column, area_a: Column, area_b: Column) -> Column:
    return inter_area > F.lit(AREA_EPS) * F.least(F.abs(area_a), F.abs(area_b))


def intersects(edge_contact: Column, inter_area: Column, area_a: Column, area_b: Column) -> Column:
    """G13 from the per-pair sums: boundaries meet, or interiors share area."""
    return edge_contact | area_positive(inter_area, area_a, area_b)


def within(inter_area: Column, area_a: Column, area_b: Column) -> Column:
    """A within b iff |a n b| = |a| > 0 (valid, regular shapes)."""
    return (area_a > 0) & (inter_area >= area_a * (1.0 - AREA_EPS)) & area_positive(inter_area, area_a, area_b)


def contains(inter_area: Column, area_a: Column, area_b: Column) -> Column:
    return within(inter_area, area_b, area_a)
