"""Spark session defaults for local runs and tests.

On a cluster the session comes from the launcher; nothing here overrides a
setting that is already present. Only the checkpoint folder is filled in when
it is unset (tests, local runs), using a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # remove checkpoint files once the checkpointed DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "faretrail", **conf: str) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Read from the session. Only for a local master (tests, local runs) and
    only when it is unset is a fresh scratch folder created; on a cluster an
    unset folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            # A machine-local folder is not shared by executors: refuse instead.
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
        current = tempfile.mkdtemp(prefix="faretrail-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from the copy.

    Used where one intermediate result feeds several branches of a plan: the
    branches read the copy instead of recomputing the scan, shuffle and
    windows each. The copy is Parquet under ``spark.checkpoint.dir`` (shared
    storage on a cluster): it survives executor loss, cuts the lineage, and
    each branch reads only the columns it uses.
    """
    return df.sparkSession.read.parquet(write_stage(df))


def write_stage(df) -> str:
    """Write ``df`` as Parquet under the shared checkpoint folder; return the path.

    For intermediates read by several branches of one plan: each branch reads
    the files independently (columnar, so each reads only its columns), and
    the copy survives executor loss.
    """
    import uuid

    base = checkpoint_dir(df.sparkSession)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir is not set")
    path = base.rstrip("/") + f"/faretrail-stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path
