"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut_lineage  # noqa: F401  the operators' own name for it

#: White space of the contracts: blank and the code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with over one of so many rows is hot.
HOT = 256


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``rows`` with ``table``, which has each ``key`` once and, in ``weight``, how many rows have it.

    The table's rows of hot keys, HOT of them at most, are broadcast, so that their rows stay where they are; the rest is joined as Spark sees fit. ``total`` is the number of rows.
    """
    keys = [key] if isinstance(key, str) else key
    least = (rows.count() if total is None else total) // HOT + 1
    hot = table.where(F.col(weight) >= least)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table.where(F.col(weight) < least), keys, how)
    return rest.unionByName(rows.join(F.broadcast(hot), keys).select(rest.columns))


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows of ``docs``, and its size in rows or in KB of text, whichever is more: what buckets of rows that carry their text are cut by."""
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return rows, max(rows, (size or 0) >> 10)


def bucket_bits(rows: int, rows_per_bucket: int) -> int:
    """Bits for so many even buckets that each holds about ``rows_per_bucket`` rows (or bytes)."""
    return min(28, max(0, (max(rows, 1) // max(rows_per_bucket, 1)).bit_length()))


def prefix_sums(df: DataFrame, group: str, order: str, ties: Sequence[str], value: str, bits: int, out: str, sums: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its ``group``.

    ``order`` is a column of 32 or more lowercase hex digits, evenly spread; ``ties`` order equal ones.
    A group is cut by the leading bits of ``order`` into 2**bits buckets; the sums of buckets are
    accumulated in a small table, and only rows of one bucket are ever sorted together, so that
    a group of any size is spread over all tasks. ``sums`` may name a narrower frame with the
    columns group, order and value, from which the sums of buckets are taken.
    """
    bucket = F.shiftright(F.conv(F.substring(order, 1, 7), 16, 10).cast("long"), 28 - bits)
    per_bucket = (df if sums is None else sums).select(group, value, bucket.alias("_bucket")).groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(F.col(group).alias("_group"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_bucket", bucket)
    placed = placed.join(offsets, (placed[group] == F.col("_group")) & (placed["_bucket"] == F.col("_of")))
    return placed.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_group", "_of", "_offset", "_bucket")
