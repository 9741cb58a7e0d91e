"""Layer preparation flows on the fixture layers."""
from pyspark.sql import functions as F

from canopy.functions.wkb import wkb_from_rings
from canopy.plans import ingest, layers as L
from canopy.plans.registry import priority_layer
from conftest import SF01
from shapes import poly, rect


def _raw(df, drop=()):
    return df.withColumn("geometry", wkb_from_rings(F.col("rings"))).drop(
        "rings", "edges", "x0", "y0", "x1", "y1", "area", *drop)


def test_embargo_flow_keeps_shapes_within_states(spark):
    emb = _raw(L.embargo(spark, SF01))
    st = _raw(L.states(spark, SF01)).withColumnRenamed("id", "state_id")
    out, counts = ingest.prepare_embargo(emb, st, 5880)
    assert counts.first().asDict() == {"invalid_before": 0, "invalid_after": 0, "final_count": 1500}
    assert out.count() == 1379                     # FIXTURES.md: the within-join keeps 1,379 of 1,500
    assert {"objectid", "dat_embarg", "uf", "srid", "geometry", "edges", "area"} <= set(out.columns)
    assert out.where(F.col("srid") != 5880).count() == 0


def test_priority_flow_matches_registered_layer(spark):
    biomes = [_raw(b) for b in L.priority_biomes(spark, SF01)]
    out = ingest.prepare_priority(biomes, 5880)
    ref = priority_layer(spark, SF01)
    a = {(r["id"], r["Import_bio"], r["area"]) for r in out.select("id", "Import_bio", "area").collect()}
    b = {(r["id"], r["Import_bio"], r["area"]) for r in ref.select("id", "Import_bio", "area").collect()}
    assert a == b and "Muita Alta" not in {x[1] for x in a}


def test_reprojection_in_flow(spark):
    from canopy.functions.geometry import RINGS
    df = spark.createDataFrame([(1, poly(rect(-54.0, -10.0, 0.5, 0.5)))], f"id long, rings {RINGS.simpleString()}")
    out = ingest.prepare_layer(df.withColumn("geometry", wkb_from_rings("rings")).drop("rings"), 4674).first()
    assert out["srid"] == 5880
    corners = {(round(e["ax"], 3), round(e["ay"], 3)) for e in out["edges"]}
    assert (5000000.0, 8894145.167) in corners     # the (-54, -10) vertex, published value
    assert 3.0e9 < out["area"] < 3.2e9             # about 0.5 x 0.5 degrees near 10 S, in m2


def test_embargo_flow_refuses_mixed_crs(spark):
    import pytest
    emb = _raw(L.embargo(spark, SF01))
    st = _raw(L.states(spark, SF01)).withColumnRenamed("id", "state_id")
    with pytest.raises(ValueError):
        ingest.prepare_embargo(emb, st, 5880, states_srid=4674)
