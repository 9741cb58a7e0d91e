"""Polygon layers derived from the driver tables.

Every coordinate is integer arithmetic on a table key (``FIXTURES.md`` part
B), so the DuckDB oracle can rebuild the same shapes independently from
rectangles. Units are metres in a 40,000 x 40,000 plane.

A shape with corner (x, y), width w and height h (both even) is a rectangle,
or, when ``id % 3 = 0``, an L with the upper right quarter missing, held as
one ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import RINGS, point, ring, with_shape

# Fixed values of the fixture layout (FIXTURES.md part B).
UF_CODES = ["AC", "AM", "MT", "PA", "RO"]
IMPORT_BIO_LABELS = ["Muito Alta", "Alta", "Muita Alta", "Extremamente Alta"]
CAR_LABEL = "Cadastro Ambiental Rural"
FEIJO = "Feijó"

PLANE = 40000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _keys(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The table's columns that a layer is made of, spread over the cluster before shapes are built from them."""
    from ..operators.spatial_join import spread
    return spread(read_table(spark, sf_dir, name).select(*cols))


def _corners(ell: bool) -> list[tuple[str, str]]:
    """Counter-clockwise vertices (SQL over columns _x, _y, _w, _h) of a
    rectangle, or of the L with the upper right quarter missing."""
    if not ell:
        return [("_x", "_y"), ("_x + _w", "_y"), ("_x + _w", "_y + _h"), ("_x", "_y + _h")]
    return [("_x", "_y"), ("_x + _w", "_y"), ("_x + _w", "_y + _h / 2"), ("_x + _w / 2", "_y + _h / 2"),
            ("_x + _w / 2", "_y + _h"), ("_x", "_y + _h")]


def _ring_sql(ell: bool) -> str:
    pts = _corners(ell)
    pts = pts + pts[:1]
    inner = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in pts)
    return f"array(named_struct('part', 0, 'hole', false, 'pts', array({inner})))"


def _edges_sql(ell: bool) -> str:
    pts = _corners(ell)
    pts = pts + pts[:1]
    return "array(" + ", ".join(f"named_struct('ax', {a[0]}, 'ay', {a[1]}, 'bx', {b[0]}, 'by', {b[1]})"
                                for a, b in zip(pts[:-1], pts[1:])) + ")"


def _native_shape(df: DataFrame, x: Column, y: Column, w: Column, h: Column, lshape: Column | None) -> DataFrame:
    """Rings plus the prepared shape columns as plain (code-generated)
    expressions: the fixture vertices are known, so no array walk is needed.
    The expressions are SQL text, parsed once on the JVM."""
    keep = df.columns
    df = df.select(*keep, x.cast("double").alias("_x"), y.cast("double").alias("_y"),
                   w.cast("double").alias("_w"), h.cast("double").alias("_h"),
                   (lshape if lshape is not None else F.lit(False)).alias("_ell"))
    area = "CASE WHEN _ell THEN _w * _h - (_w / 2) * (_h / 2) ELSE _w * _h END"
    return df.selectExpr(
        *[f"`{c}`" for c in keep],
        f"CASE WHEN _ell THEN {_ring_sql(True)} ELSE {_ring_sql(False)} END AS rings",
        f"CASE WHEN _ell THEN {_edges_sql(True)} ELSE {_edges_sql(False)} END AS edges",
        "_x AS x0", "_y AS y0", "_x + _w AS x1", "_y + _h AS y1", f"{area} AS area")


def _shape(df: DataFrame, idc: str, mx: int, my: int, w0: int, wm: int, h0: int, hm: int,
           lshape: bool = True) -> DataFrame:
    i = F.col(idc)
    x = (i * mx) % PLANE
    y = (i * my) % PLANE
    w = F.lit(w0) + 2 * (i % wm)
    h = F.lit(h0) + 2 * (i % hm)
    return _native_shape(df, x, y, w, h, (i % 3 == 0) if lshape else None)


def _pick(labels: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (idx + 1).cast("int"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DETER-style alerts from ``orders``: id, UF, CLASSNAME, VIEW_DATE."""
    o = _keys(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderkey").alias("id"), _pick(UF_CODES, F.col("o_custkey") % 5).alias("UF"),
        F.col("o_orderpriority").alias("CLASSNAME"), F.col("o_orderdate").alias("VIEW_DATE"))
    return _shape(o, "id", 7919, 104729, 200, 150, 200, 130)


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land tenure parcels from ``part``: id, desc_subclass, sigla_uf."""
    p = _keys(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand")
    sub = (F.when(F.col("p_type") == "ECONOMY", F.lit(CAR_LABEL))
            .when(F.col("p_type").isin("SMALL", "LARGE"), F.col("p_type"))
            .otherwise(F.col("p_brand")))
    p = p.select(F.col("p_partkey").alias("id"), sub.alias("desc_subclass"),
                 _pick(UF_CODES, F.col("p_partkey") % 5).alias("sigla_uf"))
    return _shape(p, "id", 15485863, 32452843, 400, 400, 400, 300)


def prodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly deforestation polygons from ``events``: id, source."""
    e = _keys(spark, sf_dir, "events", "event_id", "event_type").select(F.col("event_id").alias("id"),
                                                   F.col("event_type").alias("source"))
    return _shape(e, "id", 49979687, 67867967, 100, 200, 100, 170)


def dat_embarg_text(i: Column) -> Column:
    """Embargo date as text ``DD-MM-YY HH:MI:SS`` (four-digit year if id % 17 = 0)."""
    year = F.lit(1988) + i % 35
    ytxt = F.when(i % 17 == 0, year.cast("string")).otherwise(F.lpad((year % 100).cast("string"), 2, "0"))
    txt = F.concat_ws("-", F.lpad((1 + i % 28).cast("string"), 2, "0"),
                      F.lpad((1 + i % 12).cast("string"), 2, "0"), ytxt)
    return F.when(i % 23 == 0, F.lit(None).cast("string")).otherwise(F.concat(txt, F.lit(" 10:11:12")))


def embargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embargoed areas from ``customer``: objectid, dat_embarg (text)."""
    c = _keys(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("objectid"))
    c = c.withColumn("dat_embarg", dat_embarg_text(F.col("objectid")))
    return _shape(c, "objectid", 86028121, 15487469, 300, 250, 300, 220)


def priority_biomes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Priority areas from ``supplier``, as five biome layers (``id % 5``) to be stacked."""
    s = _keys(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("id"), _pick(IMPORT_BIO_LABELS, F.col("s_nationkey") % 4).alias("Import_bio"))
    s = _shape(s, "id", 32452867, 15485867, 2000, 1000, 2000, 900)
    return [s.where(F.col("id") % 5 == b) for b in range(5)]


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities from ``nation``: id, NM_MUN; 8 km squares on a 5 x 5 grid."""
    n = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.when(F.col("n_nationkey") == 22, F.lit(FEIJO)).otherwise(F.col("n_name")).alias("NM_MUN"))
    i = F.col("id")
    return _native_shape(n, (i % 5) * 8000, F.floor(i / 5) * 8000, F.lit(8000), F.lit(8000), None)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from ``region``: id, uf; 8 x 40 km strips."""
    r = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"),
                                                   F.col("r_name").alias("uf"))
    i = F.col("id")
    return _native_shape(r, i * 8000, F.lit(0), F.lit(8000), F.lit(40000), None)


# Which parcels parcels_raw breaks (``id`` divisible by the
# number; the first that fits), FIXTURES.md part C.
RAW_KINDS = [(101, "bow"), (103, "null"), (107, "empty"), (109, "z"), (113, "repeated"), (127, "nested"),
             (131, "touching"), (137, "overlap"), (139, "twice"), (149, "crossing")]


def parcels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as a source file would bring them, broken on purpose (``RAW_KINDS``):
    bow-tie ring, null geometry, empty polygon, Z = 7, a repeated vertex (valid),
    a shell inside another, a hole that touches its shell in one point (valid),
    parts that overlap, a ring wound twice, a hole that leaves its shell.
    Columns: id, desc_subclass, sigla_uf, geometry (WKB)."""
    from ..functions.wkb import wkb_from_rings
    from ..operators.spatial_join import spread
    p = spread(parcels(spark, sf_dir))
    i = F.col("id")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    a, b, c, d = point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)

    def box(left, low, right, high, **where):
        return ring([point(left, low), point(right, low), point(right, high), point(left, high)], **where)
    shell = ring([a, b, c, d])
    spur = (x1 - 2, y0 + 2, x1 + 2, y0 + 4)  # reaches over the right side
    rings = {
        "bow": F.array(ring([a, c, b, d])),
        "null": F.lit(None).cast(RINGS),
        "empty": F.array().cast(RINGS),
        "repeated": F.array(ring([a, b, b, c, d])),
        "nested": F.array(shell, box(x0 + 2, y0 + 2, x0 + 4, y0 + 4, part=1)),
        "touching": F.array(shell, ring([point(x0 + 2, y0), point(x0 + 2, y0 + 2), point(x0 + 4, y0 + 2)], hole=True)),
        "overlap": F.array(shell, box(*spur, part=1)),
        "twice": F.array(ring([a, b, c, d, a, b, c, d])),
        "crossing": F.array(shell, box(*spur, hole=True)),
    }
    kind = F.coalesce(*[F.when(i % n == 0, F.lit(k)) for n, k in RAW_KINDS], F.lit("ok"))
    out = p.withColumn("_kind", kind)
    chosen = F.col("rings")
    for k, r in rings.items():
        chosen = F.when(F.col("_kind") == k, r).otherwise(chosen)
    z = F.when(F.col("_kind") == "z", F.lit(7.0))
    return out.select("id", "desc_subclass", "sigla_uf", wkb_from_rings(chosen, z).alias("geometry"))


def combs(spark: SparkSession, sf_dir: str, teeth: int = 2500) -> DataFrame:
    """Shapes of 4 x ``teeth`` + 2 vertices from ``nation``: id; a bar of 8 x 2 km with teeth 1 m wide
    and 2 km high every 3 m on its top (FIXTURES.md part B)."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    n = n.select("id", ((F.col("id") % 5) * 8000).cast("double").alias("_x"), (F.floor(F.col("id") / 5) * 8000).cast("double").alias("_y"))
    top = f"""flatten(transform(sequence({teeth} - 1, 0, -1), t -> array(
        named_struct('x', _x + 3 * t + 1, 'y', _y + 2000), named_struct('x', _x + 3 * t + 1, 'y', _y + 4000),
        named_struct('x', _x + 3 * t, 'y', _y + 4000), named_struct('x', _x + 3 * t, 'y', _y + 2000))))"""
    pts = f"""concat(array(named_struct('x', _x, 'y', _y), named_struct('x', _x + 8000, 'y', _y), named_struct('x', _x + 8000, 'y', _y + 2000)),
        {top}, array(named_struct('x', _x, 'y', _y)))"""
    return with_shape(n.selectExpr("id", f"array(named_struct('part', 0, 'hole', false, 'pts', {pts})) AS rings"), "rings")


def long_combs(spark: SparkSession, sf_dir: str, teeth: int = 25_000) -> DataFrame:
    """Shapes of 4 x ``teeth`` + 2 vertices as rings: id, rings; a bar of 3 x ``teeth`` by 2,000 m with teeth 1 m wide and 2 km high
    every 3 m on its top. Of every ninth the middle tooth's top corners change places (FIXTURES.md part C)."""
    from ..operators.spatial_join import spread
    n = spread(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")))
    n = n.select("id", ((F.col("id") % 5) * 8000).cast("double").alias("_x"), (F.floor(F.col("id") / 5) * 8000).cast("double").alias("_y"))
    swapped = f"int(id % 9 = 4 AND t = {teeth // 2})"
    top = f"""flatten(transform(sequence({teeth} - 1, 0, -1), t -> array(
        named_struct('x', _x + 3 * t + 1, 'y', _y + 2000), named_struct('x', _x + 3 * t + 1 - {swapped}, 'y', _y + 4000),
        named_struct('x', _x + 3 * t + {swapped}, 'y', _y + 4000), named_struct('x', _x + 3 * t, 'y', _y + 2000))))"""
    far = f"_x + {3 * teeth}"
    pts = f"""concat(array(named_struct('x', _x, 'y', _y), named_struct('x', {far}, 'y', _y), named_struct('x', {far}, 'y', _y + 2000)),
        {top}, array(named_struct('x', _x, 'y', _y)))"""
    return n.selectExpr("id", f"array(named_struct('part', 0, 'hole', false, 'pts', {pts})) AS rings")


def prepared(df: DataFrame, keep_rings: bool = False) -> DataFrame:
    """Shape columns (edges, box, area), built once per layer.

    The fixture layers already carry them (native expressions); any other
    layer gets them from its rings.
    """
    if "edges" not in df.columns:
        return with_shape(df, "rings", drop_rings=not keep_rings)
    return df if keep_rings else df.drop("rings")
