"""What the text operators share: scratch tables, size-checked broadcasts, worker state."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its settled table is at most this large on disk (packed columns; rows in memory take up to ten times as much); beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local one is made only where the session names none and runs in one
    process (tests); on a cluster executors would lose what each writes to its own disk, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tunerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def lean(spark: SparkSession) -> None:
    """Let no Arrow batch for Python take more than ARROW_BYTES: texts are there several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column (columns differ by more than case)."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n = "_" + n
        out.append(n)
    return out


#: The scratch tables of each open Scratch, innermost last.
_scopes: list[list] = []


class Scratch:
    """Deletes at its end the scratch tables that were made within it, but those that keep() names."""

    def __enter__(self):
        self.made: list[Settled] = []
        _scopes.append(self.made)
        return self

    def keep(self, table: Settled) -> Settled:
        self.made.remove(table)
        return table

    def __exit__(self, *_):
        _scopes.remove(self.made)
        for x in self.made:
            x.drop()


class Settled:
    """A table written to the scratch folder: cuts lineage, survives lost executors, knows its size. A result that is
    computed later still reads such tables; whoever has written it can delete them with a Scratch around both."""

    def __init__(self, df: DataFrame, name: str, few: bool = False, share: int = 0):
        """few: the rows are few for the partitions that they come from; write no more files than the cluster has cores.
        share: write one file for so many shuffle partitions, but at least one for each core."""
        self.spark = df.sparkSession
        lean(self.spark)
        self.path = f"{scratch_root(self.spark)}/tunerline/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        if few or share:
            files = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share if share else 1
            df = df.coalesce(max(files, self.spark.sparkContext.defaultParallelism))
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        _left[self.path] = self
        if _scopes:
            _scopes[-1].append(self)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def bytes(self) -> int:
        fs, path = self._fs()
        return fs.getContentSummary(path).getLength()

    def side(self) -> DataFrame:
        """The table as a join's small side: with a broadcast hint if its size allows, else without (shuffle join)."""
        return F.broadcast(self.df) if self.bytes() <= BROADCAST_BYTES else self.df

    def drop(self) -> None:
        """Delete the files; only for tables whose readers have been written already."""
        fs, path = self._fs()
        fs.delete(path, True)
        _left.pop(self.path, None)


#: Tables not yet deleted, by path.
_left: dict[str, Settled] = {}


def clear() -> None:
    """Delete all scratch tables that are left; results that still read them must have been written. Also done at exit, while Spark still runs."""
    for x in list(_left.values()):
        try:
            x.drop()
        except Exception:  # Spark has been stopped
            return


atexit.register(clear)


def thinned(rows: DataFrame, by: str, counts: DataFrame, keep: int, h: str) -> DataFrame:
    """rows with enough of each value of by left to choose keep from: those whose hash h is in the first 4 * keep / count
    part of its range. counts: by, count. Windows over the result then sort few rows, however large the input."""
    part = F.pmod(F.col(h), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return rows.join(counts, by).where(part * F.col("count") < 4 * keep).drop("count")


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary Arrow array, side by side, and where each value begins, with the end of the last; null values have none."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), ends.astype(np.int64)


def bucket4(col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; the fold with remainder 2 is held out."""
    return F.crc32(F.col(col).cast("string")) % 4


#: State that a Python worker keeps between tasks (encoders, automata), by a key that the driver made. Workers outlive a
#: stage, so the state of another operator is dropped first: its memory would add to this one's.
_worker: dict = {}


def worker_state(key: str, make=None):
    """The worker's state for key, built once; without make the worker just lets go of what it holds."""
    if key not in _worker:
        _worker.clear()
        if make is None:
            return None
        _worker[key] = make()
    return _worker[key]
