"""Spark session helpers.

Cluster settings (executor sizing, shuffle partitions, checkpoint folder) come from
the session the caller hands in; ``get_spark`` only fills gaps for local runs and tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session defaults for local runs. On a cluster the submitter's settings win: we only
# set a key when it is not already set.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "flowlens") -> SparkSession:
    """Local session for tests, bench and the CLI (UI off, AQE on, UTC)."""
    master = master or os.environ.get("FLOWLENS_MASTER", "local[8]")
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("FLOWLENS_DRIVER_MEMORY", "16g")))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...), and we use
    it as is. Only when nothing is configured on a local master (tests) do we make a
    scratch folder; a cluster session without the setting fails fast.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local"):
            # a machine-local folder is not shared by executors and dies with the host
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)"
                               " for this cluster session")
        conf_dir = tempfile.mkdtemp(prefix="flowlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
