"""Small relational pieces: lookups in maps, paths, lists flattened, pending migrations, top rows, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a key, null for others."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def split_path(path: Column) -> Column:
    """struct(head, rest): up to the first slash, and what follows it."""
    parts = F.split(path, "/")
    return F.struct(F.get(parts, F.lit(0)).alias("head"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("rest"))


def flatten(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element of an array column; rows without any go. The other columns stay."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias(name))


def pending(available: DataFrame, applied: DataFrame, key: str = "file") -> DataFrame:
    """key, step: the migrations that haven't run, numbered in the order of their names. They are files of a program, so one sort of them all is small."""
    return available.join(applied.select(key), key, "left_anti").select(key, F.row_number().over(Window.orderBy(key)).cast("long").alias("step"))


def top(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows: each task keeps n of its own."""
    return rows.orderBy(*order).limit(n)


def parse(body: Column, schema: str) -> Column:
    """A JSON document as a struct, null fields where it lacks them."""
    return F.from_json(body, schema)


def render(*columns: Column | str) -> Column:
    """A JSON document of the columns; null ones are left out."""
    return F.to_json(F.struct(*columns))
