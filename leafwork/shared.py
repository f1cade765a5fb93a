"""Shared scratch space and staged tables.

Everything an operator has to write on the way (staged tables, merged files) goes to the folder the session names in
``spark.checkpoint.dir``, which all executors can reach; a cluster session without that setting is
refused, and a local one, as in tests, gets a folder of its own. ``clear`` removes what earlier
calls have written, for long sessions; the rest goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPENED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="leafwork-")  # one process: every task is on this machine
        spark.conf.set("spark.checkpoint.dir", at)
        _OPENED.setdefault(at, spark)
    return at.rstrip("/") if "://" in at else "file://" + at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/leafwork-{name}-{uuid.uuid4().hex}"
    _OPENED[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the scratch of all earlier calls. Frames made before it can no longer be read."""
    for path in [p for p, s in _OPENED.items() if s is spark]:
        delete(spark, path)
        del _OPENED[path]


def _clear() -> None:
    for path, spark in _OPENED.items():
        try:
            delete(spark, path)
        except Exception:  # the JVM is gone already: the folder's owner clears it
            return


atexit.register(_clear)
