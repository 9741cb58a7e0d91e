"""Scalar functions, windows, validity, WKB and relational helpers."""
import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from canopy.functions import projection as P
from canopy.functions import validity as V
from canopy.functions import wkb as W
from canopy.functions.geometry import RINGS, area, drop_empty, percent
from canopy.functions.scalars import dmy_text_year, replace_values, size_band
from canopy.operators.relational import asc_pg, concat_layers, desc_pg, value_counts
from canopy.plans import alerts as qa
from shapes import poly, rect


def test_text_dates(spark):
    vals = ["03-07-98 10:11:12", "03-07-12 10:11:12", "03-07-2012 10:11:12", "03/07/69 00:00:00", "03-07-70", None,
            "31-02-20 00:00:00"]
    df = spark.createDataFrame([(v,) for v in vals], "d string")
    got = [r[0] for r in df.select(dmy_text_year(F.col("d"))).collect()]
    assert got == [1998, 2012, 2012, 2069, 1970, None, None]


def test_size_bands(spark):
    vals = [0.5, 1.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 2000.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "ha double")
    got = [r[0] for r in df.select(size_band(F.col("ha"))).collect()]
    assert got == ["1000-5000 ha", "1-10 ha", "1-10 ha", "10-50 ha", "50-100 ha", "100-500 ha", "500-1000 ha",
                   "1000-5000 ha", "1000-5000 ha"]


def test_lag_and_moving_average_by_row_within_year(spark):
    m = spark.createDataFrame([(2020, 1, 1.0), (2020, 2, 2.0), (2020, 3, 6.0), (2020, 4, 1.0), (2021, 1, 5.0)],
                              "ano int, mes int, area_desmatada double")
    mom = qa.month_over_month(m).collect()
    assert [r["desmatamento_anterior"] for r in mom] == [None, 1.0, 2.0, 6.0, None]
    assert [r["variacao_percentual"] for r in mom] == [None, 100.0, 200.0, pytest.approx(-83.3333333), None]
    ma = qa.moving_average_3(m).collect()
    assert [r["media_movel_3meses"] for r in ma] == [1.0, 1.5, 3.0, 3.0, 5.0]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == [None, None, 150.0]


def test_null_ordering_like_postgres(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert [r[0] for r in df.orderBy(asc_pg("v")).collect()] == [1, 3, None]
    assert [r[0] for r in df.orderBy(desc_pg("v")).collect()] == [None, 3, 1]


def test_projection_published_points(spark):
    df = spark.createDataFrame([(-54.0, 0.0), (-54.0, -10.0), (-70.35, -8.16)], "lon double, lat double")
    x, y = P.polyconic_xy(F.col("lon"), F.col("lat"))
    got = [(round(r[0], 3), round(r[1], 3)) for r in df.select(x, y).collect()]
    assert got == [(5000000.0, 10000000.0), (5000000.0, 8894145.167), (3198724.647, 9061168.847)]


def test_reproject_rules(spark):
    df = spark.createDataFrame([(1, poly(rect(-54, -10, 1, 1)))], f"id long, rings {RINGS.simpleString()}")
    with pytest.raises(ValueError):
        P.reproject(df, None)
    with pytest.raises(ValueError):
        P.reproject(df, 31983)
    assert P.reproject(df, 5880).first()["rings"] == df.first()["rings"]
    out = P.reproject(df, 4674).first()["rings"][0]["pts"][0]
    assert (round(out["x"], 3), round(out["y"], 3)) == (5000000.0, 8894145.167)


def _rings_df(spark, rows):
    return spark.createDataFrame(rows, f"id long, rings {RINGS.simpleString()}")


def test_validity_reason_and_repair(spark):
    bow = [{"part": 0, "hole": False, "pts": [{"x": x, "y": y} for x, y in
                                               [(0.0, 0.0), (10.0, 8.0), (10.0, 0.0), (0.0, 8.0), (0.0, 0.0)]]}]
    df = _rings_df(spark, [(1, bow), (2, poly(rect(0, 0, 4, 4))), (3, None), (4, [])])
    v = {r["id"]: r["ok"] for r in df.select("id", V.is_valid("rings").alias("ok")).collect()}
    assert v == {1: False, 2: True, 3: None, 4: True}
    reasons = V.invalid_reasons(df, "id").collect()
    assert [(r["id"], r["reason"]) for r in reasons] == [(1, "Self-intersection[5 4]")]
    fixed = df.withColumn("f", V.make_valid("rings"))
    got = {r["id"]: (r["a"], r["ok"]) for r in fixed.select("id", area(F.col("f")).alias("a"),
                                                           V.is_valid("f").alias("ok")).collect()}
    assert got[1] == (40.0, True) and got[2] == (16.0, True) and got[3] == (None, None)
    clean, counts = V.validate_layer(df)
    assert counts.first().asDict() == {"invalid_before": 1, "invalid_after": 0, "final_count": 3}
    assert sorted(r["id"] for r in clean.collect()) == [1, 2, 4]
    assert [r["id"] for r in drop_empty(df).collect()] == [1, 2, 3]


def test_wkb_roundtrip_and_headers(spark):
    # a big-endian Polygon Z and an EWKB with SRID, written here with struct
    xy = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    be_z = struct.pack(">BIII", 0, 1003, 1, 4) + b"".join(struct.pack(">ddd", x, y, 7.0) for x, y in xy)
    ewkb = struct.pack("<BII", 1, 3 | 0x20000000, 5880) + struct.pack("<II", 1, 4) + \
        b"".join(struct.pack("<dd", x, y) for x, y in xy)
    df = spark.createDataFrame([(1, bytearray(be_z)), (2, bytearray(ewkb)), (3, None)], "id long, g binary")
    rows = df.select("id", W.geom_type("g").alias("t"), W.has_z("g").alias("z"),
                     W.rings_from_wkb("g").alias("r")).collect()
    assert [(r["t"], r["z"]) for r in rows] == [("Polygon", True), ("Polygon", False), (None, None)]
    assert [(p["x"], p["y"]) for p in rows[0]["r"][0]["pts"]] == xy
    two_d = df.select(W.force_2d("g").alias("g2")).collect()
    assert bytes(two_d[0]["g2"])[:5] == struct.pack("<BI", 1, 3) and two_d[2]["g2"] is None
    m = _rings_df(spark, [(1, poly(rect(0, 0, 1, 1)) + [dict(poly(rect(5, 5, 1, 1))[0], part=1)])])
    w = m.select(W.wkb_from_rings("rings").alias("g")).first()["g"]
    assert struct.unpack("<BI", bytes(w)[:5]) == (1, 6)
    back = m.select(W.rings_from_wkb(W.wkb_from_rings("rings")).alias("r")).first()["r"]
    assert back == m.first()["rings"]


def test_concat_relabel_value_counts(spark):
    with pytest.raises(ValueError):
        concat_layers([])
    a = spark.createDataFrame([(1, "Muita Alta"), (2, "Alta")], "id long, Import_bio string")
    b = spark.createDataFrame([(3, "Muita Alta", 7)], "id long, Import_bio string, extra int")
    s = replace_values(concat_layers([a, b]), "Import_bio")
    assert s.count() == 3 and "extra" in s.columns
    vc = [(r[0], r[1]) for r in value_counts(s, "Import_bio").collect()]
    assert vc == [("Muito Alta", 2), ("Alta", 1)]


def test_vectorised_decoder_equals_per_row_decoder():
    import pyarrow as pa
    from canopy.functions.wkb import _PA_RINGS, _rings_to_arrow, decode_batch, decode_rings, encode_batch
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        if i % 7 == 0:
            rows.append(None)
            continue
        rr = []
        for k in range(1 + (i % 3 == 0)):
            x = list(rng.random(5) * 1e6)
            y = list(rng.random(5) * 1e7)
            rr.append({"part": 0, "hole": k > 0, "pts": [{"x": a, "y": b} for a, b in zip(x + x[:1], y + y[:1])]})
        rows.append(rr if i % 11 else [])
    w = encode_batch(pa.array(rows, _PA_RINGS), np.where(np.arange(500) % 4 == 0, 7.0, np.nan))
    for part in (w, w.slice(9, 200)):
        ref = _rings_to_arrow([None if b is None else decode_rings(b) for b in part.to_pylist()])
        assert decode_batch(part).to_pylist() == ref.to_pylist()
