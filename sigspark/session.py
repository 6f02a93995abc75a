"""Session helpers.

The library never creates a cluster session on its own: callers pass a
``SparkSession``.  ``local_session`` is for tests, benches and the smoke
entry only.  ``checkpoint_dir`` reads the shared folder the cluster names
in ``spark.checkpoint.dir`` and only falls back to a fresh temporary folder
when nothing is configured (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sigspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session (tests, benches) without the setting gets a
    fresh temporary folder; on a cluster a machine-local folder would not be
    visible to other executors, so a missing setting is an error there.
    """
    path = spark.conf.get(_CKPT_KEY, None)
    master = spark.conf.get("spark.master", "")
    sc = None
    try:  # classic sessions; a Spark Connect client has no SparkContext
        sc = spark.sparkContext
        path = path or sc.getConf().get(_CKPT_KEY, None)
        master = sc.master
    except Exception:  # noqa: BLE001
        sc = None
    if not path:
        if str(master) != "local" and not str(master).startswith("local["):  # local-cluster and a remote client have executors of their own
            raise RuntimeError(f"set {_CKPT_KEY} to a shared folder (e.g. on HDFS or object storage)")
        path = tempfile.mkdtemp(prefix="sigspark-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table.

    Each call gets its own folder, so concurrent runs never overwrite each other.
    """
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def reuse(df: DataFrame) -> DataFrame:
    """Persist an intermediate that several branches of one plan read.

    Spark does not share a subtree between branches of a plan (column pruning
    makes the copies differ), so without this every branch recomputes it from
    the sources.  MEMORY_AND_DISK spills instead of failing; partitions lost
    with an executor are recomputed from lineage.
    """
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The plan is persisted first: an eager checkpoint runs one job to count
    and another to write the files, and without the persist the second one
    would compute the whole plan again.
    """
    checkpoint_dir(df.sparkSession)
    p = reuse(df)
    out = p.checkpoint(eager=True)
    p.unpersist()
    return out
