"""Session settings the operators rely on; all can be changed at run time."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text work costs far more than its bytes: small shuffles are not merged into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # a key with a third of the rows is split by AQE even where that costs one more shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # batches for Python hold whole texts; fewer rows keep a worker small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

_OWN_FOLDERS: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above and return the session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the space that spark.checkpoint.dir names; all executors must see it.

    Where the setting is missing, a session on one machine uses its warehouse folder; any other
    session raises, as a machine-local folder would lose rows. What a session wrote goes when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    own = f"{base.rstrip('/')}/recordloom-{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame that is read several times, and read it back.

    The plan behind it is not run again, a lost executor costs no re-run, and later steps read
    only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession)}/cut"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all tasks before costly work on them.

    Packed files of short rows are few splits, however many rows they hold.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release(*frames: DataFrame) -> None:
    """Delete what `cut` wrote for these frames; nothing may read them, or frames made of them, any more."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nobody holds any more; its own timer is half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
