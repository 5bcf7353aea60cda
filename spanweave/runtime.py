"""Session helpers: one place that knows about shared storage and table paths."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "6g", shared: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine; ``shared`` is its folder for cut lineage."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def ensure_shared(spark: SparkSession) -> str:
    """The shared folder for cut lineage. The cluster's own setting wins; a folder
    is chosen here only where none is set, as in tests on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spanweave-")
    sc.setCheckpointDir(folder)
    return folder


#: Estimated bytes from which an estimate is no more than products of earlier estimates.
UNLIKELY = 1 << 50


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage that
    survives the loss of executors.

    A checkpoint keeps the estimated size of its plan. In loops of joins these estimates
    multiply from round to round until planning drowns in them, so absurd ones are dropped."""
    ensure_shared(df.sparkSession)
    out = df.checkpoint(eager=True)
    if row_bytes_estimate(out) < UNLIKELY:
        return out
    rows = out._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), df.sparkSession)


def row_bytes_estimate(df: DataFrame) -> int:
    """Catalyst's own size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
