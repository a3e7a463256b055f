"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is made only where none is set and Spark runs in one process; on a
    cluster each executor would write to its own disk, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tunerline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path under the root; deleted by clear(), or at exit while Spark still runs."""
    path = f"{root(spark)}/tunerline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: what several branches use is computed once, and no lineage grows."""
    path, schema = place(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def clear() -> None:
    """Delete all such tables; results that still read them must have been written."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # Spark has been stopped
            return


atexit.register(clear)
