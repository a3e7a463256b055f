"""Incremental loading: content hashes, replacement by source, upserts, the memo, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.operators.scratch import settle


def content_hash(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, digest: order-independent. 120 bits of each row's md5 in two halves: both are added up (38 digits), so equal
    rows don't cancel, and the first is combined by exclusive or as well; tasks do so before the shuffle."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    half = lambda at: F.conv(F.substring(F.md5(text), at, 15), 16, 10)
    total = lambda at: F.sum(half(at).cast("decimal(28,0)"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", F.bit_xor(half(1).cast("long")).cast("string"), total(1).cast("string"), total(16).cast("string")).alias("digest"))


def changed(now: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """Rows of now (from content_hash) whose digest or count differs from the stored one, or that have none."""
    old = stored.select(*by, F.col("n").alias("_n"), F.col("digest").alias("_d"))
    return now.join(old, by, "left").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d")))).drop("_n", "_d")


def replace_source(table: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """table with the rows of the replaced sources (source_id) taken from new; a source without new rows ends empty."""
    return table.join(replaced.select("source_id").distinct(), "source_id", "left_anti").unionByName(new.join(replaced.select("source_id").distinct(), "source_id", "left_semi"))


def ingest(table: DataFrame, rows: DataFrame, attempts: DataFrame, stored: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, hashes, replaced) after a cycle: one job over all sources, each failing alone.

    rows: what was read; attempts: source_id, error; stored: source_id, n, digest of the last cycle. Sources without an
    error whose content differs are replaced, those that gave no rows end empty; failed and unchanged ones keep their
    last good rows and hashes. replaced: source_id of those that changed."""
    good = attempts.where("error is null").select("source_id").distinct()
    now = good.join(content_hash(rows, ["source_id"], columns), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"))
    new = settle(changed(now, stored, ["source_id"]), "changed-sources")  # all three results read it
    return replace_source(table, rows, new), upsert(stored, new.select(*stored.columns), ["source_id"]), new.select("source_id")


def write_replacing(new: DataFrame, path: str, replaced: list[str]) -> None:
    """The same on a Parquet table partitioned by source_id: partitions of the replaced sources are overwritten, and removed where new has no rows."""
    spark = new.sparkSession
    here = new.where(F.col("source_id").isin(replaced))
    here.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)
    full = {r[0] for r in here.select("source_id").distinct().collect()}  # no more than the named sources
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for source in set(replaced) - full:
        p = fs_path(f"{path}/source_id={source}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old with other keys."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def upsert_partial(old: DataFrame, new: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """Full outer join: of a row that both have, the updated columns come from new and the rest stay."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    pick: list[Column] = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in [c for c in old.columns if c not in keys]:
        first = F.col("n._n") if c in updated else F.col("o._o").isNull()
        pick.append(F.when(first, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full").select(*pick)


def merge_memo(memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memo and the fresh rows of keys it lacks."""
    return memo.unionByName(fresh.join(memo.select("normalized_key"), "normalized_key", "left_anti").select(*memo.columns))


def put(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The key/value table (key, value) with one entry set."""
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def bump(version: DataFrame, changed_sources: DataFrame) -> DataFrame:
    """version: one row; one more if any source changed."""
    return version.select((F.col("version") + F.lit(0 if changed_sources.isEmpty() else 1)).alias("version"))
