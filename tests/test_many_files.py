"""Many files of a few schemas are read by one scan for each schema."""
import pytest
from pyspark.sql import functions as F

from canopy.functions.wkb import wkb_from_rings
from canopy.sources.layers_io import find_layers, read_source, read_sources
from canopy.sources.writers import write_files
from shapes import poly, rect


@pytest.mark.parametrize("kind", ["shp", "gpkg"])
def test_one_scan_for_each_schema(spark, tmp_path, kind):
    made = spark.createDataFrame([(i, poly(rect(i, 0, 2, 2))) for i in range(60)], "id long, rings array<struct<part:int,hole:boolean,pts:array<struct<x:double,y:double>>>>")
    made = made.select("id", F.lit("c").alias("name"), wkb_from_rings(F.col("rings")).alias("geometry"))
    write_files(made, F.concat(F.lit("a_"), (F.col("id") % 20).cast("string")), str(tmp_path), kind)
    write_files(made.withColumn("note", F.lit("x")), F.lit("b"), str(tmp_path), kind)
    found = find_layers(str(tmp_path))
    got = read_sources(spark, found)
    assert len(found) == 21 and len(got) == 2
    # the plan does not grow with the files
    assert all(len(d._jdf.queryExecution().optimizedPlan().toString()) < 5000 for d in got)
    for d in got:
        names = {r[0] for r in d.select("_layer").distinct().collect()}
        want = [read_source(spark, p, n) for name, p, n in found if name in names]
        whole = want[0]
        for w in want[1:]:
            whole = whole.unionByName(w)
        assert d.schema == whole.schema
        assert sorted(map(repr, d.collect())) == sorted(map(repr, whole.collect()))
