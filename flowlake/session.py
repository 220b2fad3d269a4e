"""Session set-up and the shared folder used for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster supplies ``master`` itself."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else a private local one.

    The local fallback is for tests on ``local[*]``; on any other master a missing setting
    is an error, because a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="flowlake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"flowlake-{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder and read back: the plan is cut and survives lost executors.

    The store is Parquet, so a later pass reads the columns it needs; the rows are computed once.
    """
    return store(df)[0]


def store(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """:func:`cut_lineage` with the folder of the store, for :func:`remove_folder`."""
    path = new_folder(df.sparkSession, "stage")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a store that no DataFrame still to be computed reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
