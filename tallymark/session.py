"""Session settings and durable cut points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallymark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: there the
    driver and the executors are one process, so a local path is shared by all.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="tallymark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at ``path``, in whatever store it names?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, tasks_per_core: int = 3) -> DataFrame:
    """Give a scan enough tasks for work that is heavy per row, such as rule matching.

    A table of many files already has them and is left alone.  A few large row groups
    would keep most cores idle, so only then are the rows dealt out again.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    return scan if scan.rdd.getNumPartitions() >= wanted else scan.repartition(wanted)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh path in the shared folder and read it back.

    For a table several steps read: its lineage is evaluated once, survives the loss of
    executors, and is read back with column pruning and known sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
