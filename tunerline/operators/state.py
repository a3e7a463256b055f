"""Versioned Parquet snapshots: state is read from the latest and written as the next, never in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, root: str) -> int:
    """Number of the latest complete snapshot, 0 without one."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return 0
    found = [0]
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(_fs(spark, f"{root}/{name}/_SUCCESS")[1]):
            found.append(int(name[1:]))
    return max(found)


def read(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The latest snapshot, or an empty table."""
    n = version(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v{n}") if n else spark.createDataFrame([], schema)


def write(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write the next snapshot and drop those older than the last keep ones. Readers of the latest are not disturbed."""
    spark = df.sparkSession
    n = version(spark, root) + 1
    df.write.mode("overwrite").parquet(f"{root}/v{n}")
    fs, _ = _fs(spark, root)
    for old in range(max(1, n - keep - 3), n - keep + 1):
        fs.delete(_fs(spark, f"{root}/v{old}")[1], True)
    return n
