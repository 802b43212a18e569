"""Shared pieces of the training-data operators: tables, folders and bounded broadcasts.

Tables live in the folder in ``spark.checkpoint.dir``.  An operator drops those that its result doesn't read; those
it reads are deleted when the application ends; products (archives, shards, media, token ids) stay.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its columns, that an operator broadcasts after measuring it.
BROADCAST_BYTES = 32 << 20
#: Most rows of an Arrow batch: some hundred long texts fit a worker's memory.
BATCH_ROWS = 512

_own_dir: dict[str, str] = {}
_caches: list[dict] = []


def only(*caches: dict) -> None:
    """A Python worker serves many stages; it keeps one operator's word caches at a time."""
    for cache in caches:
        if not any(c is cache for c in _caches):
            _caches.append(cache)
    for c in _caches:
        if not any(c is cache for cache in caches):
            c.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) a temporary folder takes its place; on a cluster it must be set.
    """
    sc = spark.sparkContext
    put = sc.getConf().get("spark.checkpoint.dir", None)
    if not put:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        put = _own_dir.get(sc.applicationId)
        if put is None:
            put = _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="pagemere-")
        sc.setCheckpointDir(put)
    return put


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver found it, and bounds their batches of long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Intermediate tables in the shared folder; each can be dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        on_workers(spark)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame, what: str, codec: str = "zstd", product: bool = False) -> DataFrame:
        """The table as written; its shuffles' files go at once, for nothing reads them again."""
        self.n += 1
        path = f"{self.base}/{self.n}-{what}"
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        if not product:
            fs, p = self._path(path)
            fs.deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pagemere_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and (path := getattr(t, "_pagemere_path", None)):
                fs, p = self._path(path)
                fs.delete(p, True)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or with marks at its end until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its measured size is within ``limit``; else leaves the plan to Spark."""
    return F.broadcast(df) if n_bytes <= limit else df
