"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str, master: str | None = None, **conf: object) -> SparkSession:
    """A session with a UTC clock and adaptive execution; `conf` keys use `_` for `.`.

    Nothing here fixes cluster sizes: partition counts and memory stay with
    spark-submit, and AQE coalesces or splits shuffle partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "static")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """The folder every executor can see: `spark.checkpoint.dir`, or the checkpoint
    folder the application has set.

    Only a local session without either gets a temporary folder; a machine-local
    path would not survive the loss of an executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakewright-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; every call gives another one.

    The application has a folder of its own there, which is deleted when it ends.
    """
    context = spark.sparkContext
    own = f"{_shared_root(spark)}/lakewright-{context.applicationId}"
    if getattr(context, "_lakewright_scratch", None) != own:
        place = context._jvm.org.apache.hadoop.fs.Path(own)
        files = place.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        context._lakewright_scratch = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let DataFrame.checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))
