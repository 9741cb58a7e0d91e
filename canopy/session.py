"""Session helpers.

Library code never creates its own session; it takes the caller's. These
helpers exist for tests, the benchmark and the driver contract.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the overlay plans rely on. AQE re-plans joins from runtime sizes
# (broadcast only below the threshold, otherwise sort-merge) and splits
# skewed join partitions; the session time zone is pinned so year/month of
# timestamps do not depend on the host.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# JVM flag for driver and executors: let HotSpot JIT-compile generated
# methods above 8000 bytes of bytecode. Fused overlay stages (cell explode +
# join + projections) exceed that and otherwise run in the bytecode
# interpreter, several times slower. Must be set when the JVMs start
# (spark-submit --conf / cluster defaults), not on a running session.
JIT_HUGE_METHODS = "-XX:-DontCompileHugeMethods"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "canopy") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("CANOPY_DRIVER_MEMORY", "16g"))
         .config("spark.driver.extraJavaOptions", JIT_HUGE_METHODS)
         .config("spark.executor.extraJavaOptions", JIT_HUGE_METHODS)
         # catalog tables of local runs go to a scratch folder, not the cwd
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="canopy-warehouse-")))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local session
    without that setting (a test) gets a scratch folder of its own; on a
    cluster a folder of one machine would lose files, so that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="canopy-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/canopy-{name}-{uuid.uuid4().hex}"
