"""Writing tables so that readers never see half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_staged(df: DataFrame, target: str, partitions: tuple[str, ...] = ()) -> None:
    """``df`` as parquet at ``target``: written beside it first, then put in its place. An
    earlier table stays readable until the new one is whole. Works on any Hadoop file system."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staging, old = f"{target}.new", f"{target}.old"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(staging)
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(old), True)
    if fs.exists(path(target)):
        fs.rename(path(target), path(old))
    if not fs.rename(path(staging), path(target)):
        raise OSError(f"{staging} could not be put in place")
    fs.delete(path(old), True)
    spark.catalog.refreshByPath(target)
