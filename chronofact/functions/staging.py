"""Cutting lineage with tables written to the folder that driver and executors share.

All tables of an application lie below one folder of ``spark.checkpoint.dir``: ``discard`` removes one as
soon as nothing reads it any more, ``clear`` removes what is left.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from chronofact.errors import StagingError

#: Estimated bytes a file of a staged table holds at least, once every core has a file to write.
FILE_BYTES = 64 << 20
#: Bytes of a staged table's row groups. A task holds one while it writes or reads it; a file of several groups is read
#: by several tasks.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only one process that is driver and executor may go without."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise StagingError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        place = tempfile.mkdtemp(prefix="chronofact-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/chronofact-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sized(df: DataFrame) -> DataFrame:
    """df in no more partitions than its estimated bytes fill, but at least one for each core.

    The estimate is Catalyst's, which for joins is far too high: those keep the partitions that they have.
    """
    spark = df.sparkSession
    about = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(int(min(1 << 30, max(spark.sparkContext.defaultParallelism, -(-about // FILE_BYTES)))))


def stage(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the written table; files bounds its files where the caller knows the size."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    (sized(df) if files is None else df.coalesce(files)).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for f in frames:
        if path := getattr(f, "staged_at", None):
            _delete(f.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all staged tables of the application; results that still read them can't be used any more."""
    with contextlib.suppress(StagingError):
        _delete(spark, _root(spark))
