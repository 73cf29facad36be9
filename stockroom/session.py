"""Spark session and checkpoint-directory handling.

Library code never creates its own session on a cluster: it takes the one it is
given.  ``get_spark`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold), coalesces
# small shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the size check behind every automatic broadcast (measured at runtime by AQE)
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for large inputs (tens of TB on hundreds of executors): input splits
# and post-shuffle partitions of ~256 MB, a high initial shuffle partition
# count that AQE coalesces down, and skew splitting above 1 GB per partition.
SCALE_CONF = {
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1GB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "stockroom", extra: dict | None = None, scale: bool = False) -> SparkSession:
    """Build (or reuse) a session with the settings the library expects.

    ``scale=True`` adds ``SCALE_CONF`` (cluster sizing for large inputs).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if scale:
        conf.update(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    On a cluster the directory must be shared storage named by the
    ``spark.checkpoint.dir`` setting; it is read from the session.  Only a
    local-mode session (tests, bench) without that setting gets a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset conf raises on some versions
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "(HDFS/S3/ABFS) so checkpoints survive executor loss")
    scratch = tempfile.mkdtemp(prefix="stockroom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so that Python functions run wherever the driver was started.

    Spark copies the file to every executor and puts it on the workers' path;
    a session gets it once.
    """
    sc = spark.sparkContext
    if getattr(sc, "_stockroom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(prefix="stockroom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(os.path.join(top, "stockroom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
        if os.path.exists(os.path.join(top, "corpus_pipeline.py")):
            out.write(os.path.join(top, "corpus_pipeline.py"), "corpus_pipeline.py")
    sc.addPyFile(path)
    sc._stockroom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (checkpoint to shared storage).

    Used between rounds of iterative jobs and before reusing a frame whose
    partitioning came from sampling, so that a lost executor recomputes from
    the checkpoint rather than re-sampling a different split.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_unused(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that are gone.

    Spark does so when the driver's JVM collects garbage, which a small heap may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
