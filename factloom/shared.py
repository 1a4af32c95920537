"""The folder that driver and executors share, and cutting lineage into it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder; a
    cluster gets an error, as its executors could not see one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if sc.master != "local" and not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        base = sc.getCheckpointDir()
    return base


#: Folders that were made below the shared folder and not deleted yet.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    where = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        _made.append(where.get())
    return out


def cut_rdd(spark: SparkSession, rdd: RDD) -> RDD:
    """As cut, for an RDD: a partition is read record by record. It is computed twice, as Spark does for a checkpoint."""
    shared_dir(spark)
    rdd.checkpoint()
    rdd.count()
    if rdd.getCheckpointFile():
        _made.append(rdd.getCheckpointFile())
    return rdd


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut, but as a Parquet table: its size is known, so a small one is broadcast in a join."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what was cut or written inside it. Results that are read later must be written elsewhere before it ends."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete_path(spark, path)
