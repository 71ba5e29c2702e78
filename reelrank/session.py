"""Session helpers: a local session for tests and benchmarks, and the shared
scratch location for lineage cuts and round-trip writes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "reelrank") -> SparkSession:
    """A local[N] session for tests and the benchmark.

    Library code never builds sessions; callers on a cluster bring their own.
    The UI stays off and the checkpoint directory is only set when the
    environment left it unset.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # FP-Growth and ALS shuffle RDDs inside Spark ML: Kryo is faster there.
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        # Only reached in local runs where nothing configured one (tests).
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelrank-ckpt-"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names (``spark.checkpoint.dir``
    or ``SparkContext.setCheckpointDir``), or None when none is set."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        return spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key raises on some versions
        return None


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder.

    On a cluster the checkpoint folder must be configured (it is the shared
    storage every executor sees); a machine-local folder is only used in
    local mode when nothing is configured.
    """
    base = checkpoint_dir(spark)
    if base is None:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; configure a shared folder "
                "(e.g. on HDFS or object storage) for scratch tables")
        base = tempfile.mkdtemp(prefix="reelrank-scratch-")
    return f"{base.rstrip('/')}/reelrank-{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Cut lineage through reliable checkpoint storage when it is configured.

    Never uses local checkpoints: those die with their executor.  Without a
    configured folder the frame is persisted to memory and disk in local mode;
    on a cluster, where both passes of a caller must see the same rows after a
    lost executor, that raises.
    """
    from pyspark import StorageLevel

    if checkpoint_dir(df.sparkSession):
        if not df.sparkSession.sparkContext.getCheckpointDir():
            df.sparkSession.sparkContext.setCheckpointDir(checkpoint_dir(df.sparkSession))
        return df.checkpoint(eager=True)
    if not _is_local(df.sparkSession):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def env_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
