"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a Python worker is sent at once at most: texts of any length come with them.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch for the session, so that what a worker holds doesn't grow with a partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def apart(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast, whatever Spark takes its size to be."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where that is unset, a temporary folder takes its place."""
    sc = spark.sparkContext
    put = sc.getConf().get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc.master.startswith("local") else None)
    if not put:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        put = "file://" + tempfile.mkdtemp(prefix="pagemere-")
        sc.setCheckpointDir(put)
    return put.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written, which cuts the lineage; it is deleted when the application ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
