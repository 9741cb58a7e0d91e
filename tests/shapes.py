"""Hand-written shapes for unit tests (FIXTURES.md part D)."""
from pyspark.sql import functions as F

from canopy.functions.geometry import RINGS, with_shape


def poly(*rings):
    """rings: lists of (x, y); the first is the shell, the rest holes."""
    out = []
    for k, pts in enumerate(rings):
        pts = list(pts) + [pts[0]]
        out.append({"part": 0, "hole": k > 0, "pts": [{"x": float(x), "y": float(y)} for x, y in pts]})
    return out


def multi(*polys):
    out = []
    for p, rings in enumerate(polys):
        for r in rings:
            out.append({**r, "part": p})
    return out


def rect(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def layer(spark, rows, id_name="id"):
    """rows: list of (id, rings) -> prepared shape layer."""
    df = spark.createDataFrame([(i, r) for i, r in rows], f"{id_name} long, rings {RINGS.simpleString()}")
    return with_shape(df, "rings")
