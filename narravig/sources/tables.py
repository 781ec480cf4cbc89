"""Reading the input tables and the folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of the directory; only ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than that, as with small files; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the session has none and runs in one process, as in tests, a local folder is set, which goes when the process ends; on
    a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if folder is None:
            folder = tempfile.mkdtemp(prefix="narravig-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with its lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
