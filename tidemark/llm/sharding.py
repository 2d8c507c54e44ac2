"""Rendezvous hashing of record keys over weighted shards, in built-in functions only.

A shard's score for a key is -ln(u) / weight, with u uniform in (0, 1) from a hash of key and shard;
the least score wins. Shard s gets its weight's part of the keys, and a shard that is added
takes keys only into itself, since no other score changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_bits, prefix_sums, volume

SHARDS = 24
ROWS_PER_BUCKET = 20_000
#: Of rows that carry their text: rows, or KB of text.
DOCUMENTS_PER_BUCKET = 4_096


def _score(keys: Sequence[str | Column], shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def assign_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float], out: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds ``out``, the shard of each row's key, and ``grown``, its shard were there one shard more.

    Rows with equal keys share a shard. A null key is a key as any other. A column that has the
    name of ``out`` or ``grown`` already is replaced. An empty frame stays empty.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    best = F.array_min(F.array(*[_score(keys, s, w) for s, w in enumerate(weights)]))
    df = df.withColumn("_best", best)
    if grown:
        df = df.withColumn(grown, F.least(F.col("_best"), _score(keys, len(weights), grown_weight))["shard"])
    return df.withColumn(out, F.col("_best")["shard"]).drop("_best")


def add_slots(df: DataFrame, keys: Sequence[str], rows_per_shard: int, shard: str = "shard", out: str = "slot", rows_per_bucket: int = ROWS_PER_BUCKET, spread: str | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each shard, in an order that the keys' hashes give.

    Rows with equal keys get neighbouring slots in any order, unless the column ``spread`` tells them apart: then they are spread over the shard,
    so that no task sorts all rows of one key. No shard is sorted as a whole: ``rows_per_shard``, the rows
    of a large shard, says into how many buckets each one is cut.
    """
    order = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in [*keys, *([spread] if spread else [])]]))
    df = df.withColumn("_order", order).withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(df, shard, "_order", [], "_one", bucket_bits(rows_per_shard, rows_per_bucket), out).drop("_order", "_one")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with shard and slot, by doc_id.

    Rows that repeat a doc_id share its shard; null doc_ids share one. Columns named shard or slot are replaced.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    # The row is packed, so that no column of it clashes with those made on the way.
    packed = docs.select("doc_id", F.xxhash64("text").alias("_spread"), F.struct(*[docs[c] for c in kept]).alias("_row"))
    weights = weights or [1.0] * n_shards
    sharded = assign_shards(packed, ["doc_id"], weights)
    largest = max(weights) / sum(weights)
    return add_slots(sharded, ["doc_id"], int(volume(docs)[1] * largest), rows_per_bucket=DOCUMENTS_PER_BUCKET, spread="_spread").select("_row.*", "shard", "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: law ``key`` over 24 shards; a null text has the size 8 and the checksum of none, 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = assign_shards(rows, ["doc_id"], [1.0] * SHARDS, grown="grown_shard")
    return add_slots(rows, ["doc_id"], docs.count() // SHARDS, spread="text_crc32").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
