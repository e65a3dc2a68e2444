"""Files that a query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(base)
    out = f"{base.rstrip('/')}/readloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, out))
    return out


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back, where several queries follow."""
    out = path(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


@contextlib.contextmanager
def passing():
    """What is made within goes at the end, where the same process makes more again and again."""
    before = len(_made)
    try:
        yield
    finally:
        clear(before)


@atexit.register
def clear(least: int = 0) -> None:
    while len(_made) > least:
        spark, out = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            return
