"""Session helper and the few run-time services that every operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC; cluster settings (master, memory, partitions) are left to the caller."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from ``spark.checkpoint.dir``.

    Only on a local master, where one machine holds everything, a temporary folder stands in for it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


_scopes: list[list[str]] = []


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are removed at its end, so results must be written or collected before; others go when the application ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p, fs = _path(spark, path)
            fs.delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with their lineage cut, kept as Parquet in the shared checkpoint folder.

    A written table holds columns and compresses; a checkpoint of the row RDD would hold every row as an object.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
