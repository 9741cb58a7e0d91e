"""Q01, Q12 and Q17's joins as box theta joins and as grid joins: seconds, pairs and shuffled bytes.

Usage: python tools/measure_joins.py [sf_dir] [repeats]

The theta form joins on the four box comparisons (a nested loop) and then runs the same pair kernel; the grid form is
``spatial_join``. Shuffled bytes come from Spark's event log, written to a scratch folder.
"""
from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from canopy.functions import overlay as ov  # noqa: E402
from canopy.operators import spatial_join as SJ  # noqa: E402
from canopy.plans import layers as L  # noqa: E402
from canopy.session import RECOMMENDED_CONF  # noqa: E402


def theta(left, right, lid, rid):
    side = lambda df, p, i: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("edges", "area", "x0", "y0", "x1", "y1")], F.col(i).alias(f"{p}_id"))
    a, b = side(SJ.spread(left), "l", lid), side(right, "r", rid)
    met = a.join(b, (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1")))
    pairs = SJ.pair_overlay_batched(met, [])
    return pairs.where(ov.intersects(F.col("edge_contact"), F.col("inter_area"), F.col("l_area"), F.col("r_area")))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    repeats = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    log = tempfile.mkdtemp(prefix="canopy-events-")
    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "16g")
    for k, v in {**RECOMMENDED_CONF, "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.rolling.enabled": "false",
                 "spark.eventLog.compress": "false"}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    p = lambda f: L.prepared(f(spark, sf))
    joins = {"Q01": (p(L.alerts), p(L.parcels).withColumnRenamed("id", "rid"), "id", "rid"),
             "Q12": (p(L.embargo), p(L.parcels).withColumnRenamed("id", "rid"), "objectid", "rid"),
             "Q17": (p(L.alerts), p(L.embargo), "id", "objectid")}
    out: dict = {}
    marks = []
    for name, (left, right, lid, rid) in joins.items():
        for form in ("grid", "theta"):
            times = []
            for _ in range(repeats):
                t = time.time()
                df = theta(left, right, lid, rid) if form == "theta" else SJ.spatial_join(left, right, left_id=lid, right_id=rid, left_cols=[], right_cols=[])
                n = df.count()
                times.append(time.time() - t)
                marks.append((f"{name} {form}", t * 1000, time.time() * 1000))
            out[f"{name} {form}"] = {"seconds": round(statistics.median(times), 2), "least": round(min(times), 2), "most": round(max(times), 2), "pairs": n,
                                     "pairs_per_sec": round(n / statistics.median(times))}
    spark.stop()
    for f in glob.glob(f"{log}/*"):
        for line in open(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and (m := e.get("Task Metrics")):
                for key, a, z in marks:
                    if a <= e["Task Info"]["Launch Time"] <= z:
                        out[key]["shuffle_bytes"] = out[key].get("shuffle_bytes", 0) + m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    for key, v in out.items():
        v["shuffle_bytes"] = v.get("shuffle_bytes", 0) // repeats
        print(key, json.dumps(v))


if __name__ == "__main__":
    main()
