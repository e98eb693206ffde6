"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a few numbers or names that every executor may hold.
SMALL_TABLE_ROWS = 1_000_000
_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a local one is made, but only for a local master: on a cluster
    each machine would write to a folder of its own, and tables would come back empty.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tablelore-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; the driver deletes it when it ends."""
    path = f"{shared_folder(spark)}/tablelore-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again.

    The files outlive lost executors, so nothing above is computed a second time. The
    driver deletes them when it ends.
    """
    path = f"{temporary_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_whole(table: DataFrame, rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """A narrow written table, marked for broadcast if it has at most ``rows`` rows.

    Beyond that a join shuffles both sides. Written, because its rows are counted here.
    """
    return F.broadcast(table) if table.count() <= rows else table
