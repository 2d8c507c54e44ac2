"""Exact dedup by binary-fuse filters over immutable snapshots.

Rows are dealt into batches, of which all but the last are immutable snapshots. Duplicates within a batch are grouped by
themselves. Each snapshot has static filters over its digests, one for each shard of
digests; they screen the digests of later batches, and only those that a filter lets through join the snapshots' exact digests. What
shares a digest goes into one bucket, where the texts' bytes are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, join_hot

BATCHES = 4
#: Digests of a batch that one filter holds.
FILTER_KEYS = 1 << 18
#: So many candidate digests of 8 bytes are broadcast at most; more are joined by a shuffle.
BROADCAST_DIGESTS = 1 << 17


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 over key + seed."""
    h = keys + np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuseFilter:
    """A static filter of 8 bits a key: three slots in neighbouring segments whose XOR is the key's fingerprint."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
        first = ((hashes >> np.uint64(32)) * np.uint64(segments * segment) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(segment - 1)
        second = (first + segment) ^ ((hashes >> np.uint64(18)) & mask).astype(np.int64)
        third = (first + 2 * segment) ^ (hashes & mask).astype(np.int64)
        return np.stack([first, second, third])

    @staticmethod
    def _prints(hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        wanted = int(round(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))))
        segments = max(1, -(-wanted // segment) - 2)
        for seed in range(1, 201):
            hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
            slots, size = cls._slots(hashes, segment, segments), (segments + 2) * segment
            count, held = np.bincount(slots.ravel(), minlength=size), np.zeros(size, np.int64)
            for row in slots:
                np.bitwise_xor.at(held, row, np.arange(n))
            rounds, left, queue = [], n, np.flatnonzero(count == 1)
            while len(queue):
                # Keys that stand alone in a slot go, all at once; each takes that slot, later ones depend on none of it.
                key, at = np.unique(held[queue], return_index=True)
                rounds.append((key, queue[at]))
                left -= len(key)
                for row in slots:
                    np.subtract.at(count, row[key], 1)
                    np.bitwise_xor.at(held, row[key], key)
                touched = np.unique(slots[:, key])
                queue = touched[count[touched] == 1]
            if left == 0:
                table, prints = np.zeros(size, np.uint8), cls._prints(hashes)
                for key, slot in reversed(rounds):
                    value = prints[key]
                    for row in slots:
                        value = value ^ table[row[key]]
                    table[slot] = value  # the slot itself is 0 until now
                return cls(seed, segment, segments, table)
        raise RuntimeError("no seed peels these keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        hashes = _mix(keys.astype(np.uint64), self.seed * 0x9E3779B97F4A7C15 % (1 << 64))
        a, b, c = self._slots(hashes, self.segment, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._prints(hashes)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuseFilter:
        return cls(*np.frombuffer(data, "<i8", 3).tolist(), np.frombuffer(data, np.uint8, offset=24))


def normalised(text: Column) -> Column:
    """Each run of blanks and code points 9 to 13 becomes one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def snapshot_filters(groups: DataFrame, shards: int) -> DataFrame:
    """(snapshot, shard, filter) from the digests (batch, digest) of snapshots."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuseFilter.build(frame["digest"].to_numpy().view(np.uint64))
        return pd.DataFrame({"snapshot": frame["batch"].iloc[:1], "shard": frame["shard"].iloc[:1], "filter": [made.to_bytes()]})

    return groups.select("batch", "digest", _shard(shards)).groupBy("batch", "shard").applyInPandas(build, "snapshot int, shard int, filter binary")


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("digest", 20), F.lit(shards)).cast("int").alias("shard")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Of ``incoming`` (batch, digest), the digests that a filter of an earlier snapshot lets through: all that are in one, few others."""

    def probe(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        digests, batch = mine["digest"].to_numpy(), mine["batch"].to_numpy()
        passed = np.zeros(len(mine), bool)
        for snapshot, data in zip(theirs["snapshot"], theirs["filter"]):
            later = np.flatnonzero((batch > snapshot) & ~passed)
            passed[later] = BinaryFuseFilter.from_bytes(data).contains(digests[later].view(np.uint64))
        return pd.DataFrame({"batch": batch[passed], "digest": digests[passed]})

    return incoming.select("batch", "digest", _shard(shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "batch int, digest long")


def exact_duplicates(docs: DataFrame, batch: Column, batches: int = BATCHES, filter_keys: int = FILTER_KEYS, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs`` (doc_id and text; other columns are left out).

    ``batch`` deals the rows into snapshots 0 to batches - 2 and the new batch. Texts are equal if they are after
    normalising white space; null counts as empty. The row with the least doc_id stays; of rows that repeat that doc_id too, one.
    If all doc_ids of a group are null, keep_id is null and one of its rows stays.
    """
    text = normalised(F.col("text"))
    rows = cut_lineage(docs.select("doc_id", batch.cast("int").alias("batch"), F.xxhash64(text).alias("digest"), F.sha2(text, 256).alias("text_sha256")))
    groups = cut_lineage(rows.groupBy("batch", "digest").agg(F.count("*").alias("n")))
    shards = 1 << max(0, (groups.count() // (filter_keys * batches)).bit_length())
    filters = cut_lineage(snapshot_filters(groups.where(F.col("batch") < batches - 1), shards))
    passed = screen(groups.where(F.col("batch") > 0), filters, shards)
    earlier = groups.select(F.col("batch").alias("snapshot"), F.col("digest").alias("known"))
    across = passed.join(earlier, (F.col("digest") == F.col("known")) & (F.col("snapshot") < F.col("batch"))).select("digest")
    candidates = cut_lineage(across.unionByName(groups.where("n > 1").select("digest")).distinct())
    # Exact buckets: the bytes of texts that share a digest are compared by grouping them. Copies meet in the map tasks already.
    small = candidates.count() <= broadcast_digests
    texts = docs.select("doc_id", text.alias("text")).withColumn("digest", F.xxhash64("text"))
    texts = texts.join(F.broadcast(candidates) if small else candidates, "digest", "left_semi")
    buckets = texts.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    buckets = cut_lineage(buckets.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    keys = ["digest", "text_sha256"]
    found = rows.join(F.broadcast(buckets), keys, "left") if small else join_hot(rows, buckets, keys, "group_size", how="left")
    single = F.col("group_size").isNull()
    found = found.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("first"))
    # Rows of the least doc_id: one, unless the table repeats it.
    repeated = found.where(F.col("first") & (F.col("group_size") > 1)).groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times")).where("times > 1").select(F.col("text_sha256").alias("sha"))
    many = cut_lineage(repeated)
    if many.isEmpty():
        return found.select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
    marked = found.join(many, F.col("text_sha256") == F.col("sha"), "left")
    once = marked.where(F.col("first") & F.col("sha").isNotNull()).groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count("*").alias("times"))
    once = once.select("doc_id", "keep_id", "group_size", F.explode(F.expr("transform(sequence(1L, times), k -> k = 1L)")).alias("kept"), "text_sha256")
    rest = marked.where(~F.col("first") | F.col("sha").isNull()).select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
    return rest.unionByName(once)


def write_snapshot(docs: DataFrame, path: str, filter_keys: int = FILTER_KEYS) -> None:
    """Stores what later batches need of ``docs`` (doc_id, text), which must not change: ``path``/digests (digest, keep_id, group_size) and ``path``/filters (snapshot, shard, filter, shards)."""
    digest = F.xxhash64(normalised(F.col("text"))).alias("digest")
    docs.select(digest, "doc_id").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).write.parquet(f"{path}/digests")
    groups = docs.sparkSession.read.parquet(f"{path}/digests").select(F.lit(0).alias("batch"), "digest")
    shards = 1 << max(0, (groups.count() // filter_keys).bit_length())
    snapshot_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")


def screen_batch(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ``docs`` (doc_id, text) that the stored filters of a snapshot let through: all that it holds, and one of 256 others. Nothing else of the snapshot is read."""
    filters = docs.sparkSession.read.parquet(f"{path}/filters")
    shards = filters.agg(F.max("shards")).first()[0] or 1
    incoming = docs.select(F.lit(1).alias("batch"), F.xxhash64(normalised(F.col("text"))).alias("digest")).distinct()
    return screen(incoming, filters, shards).select("digest")


def later_duplicates(docs: DataFrame, path: str, known: DataFrame) -> DataFrame:
    """doc_id, keep_id, known, kept and text_sha256 for each row of a new batch (doc_id, text) against the snapshot in ``path`` of the rows ``known``.

    Of texts that the snapshot has, keep_id is its least doc_id and no row of the batch stays; other copies within the batch are as in ``exact_duplicates``.
    Digests that pass the filters join the snapshot's; only texts of those that are there are compared, by their bytes.
    """
    text = normalised(F.col("text"))
    hits = cut_lineage(screen_batch(docs, path).join(docs.sparkSession.read.parquet(f"{path}/digests").select("digest"), "digest", "left_semi"))
    candidates = known.select("doc_id", text.alias("text")).withColumn("digest", F.xxhash64("text")).join(hits, "digest", "left_semi")
    theirs = candidates.groupBy("digest", "text").agg(F.min("doc_id").alias("known_id"))
    mine = docs.select(text.alias("text")).withColumn("digest", F.xxhash64("text")).join(hits, "digest", "left_semi").distinct()
    both = mine.join(theirs, ["digest", "text"]).select(F.sha2("text", 256).alias("text_sha256"), "known_id", F.lit(True).alias("known"))
    own = exact_duplicates(docs, F.lit(0), 1)
    found = own.join(both, "text_sha256", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return found.select("doc_id", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"), "known", (F.col("kept") & ~F.col("known")).alias("kept"), "text_sha256")


def op9_exactdedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest; a hash of doc_id deals the rows into three snapshots and a new batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs.select("doc_id", "text"), F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
