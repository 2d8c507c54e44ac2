"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target of words and a schedule: a weight over training time 0 to 1, linear
between evenly spaced knots. Its integral is the source's cumulative demand. The source's
documents stand in an order that a hash of doc_id gives, read twice over at most; the one whose words the demand
reaches at time t gets the training position t. Sorting by position interleaves the sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_bits, cut_lineage, join_hot, prefix_sums, word_count
from tidemark.operators.ordered import Running, running

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (3, 1, 2)
#: Schedules of the sources in the same order, repeating: flat, rising, falling.
SCHEDULES = ((1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
ROWS_PER_BUCKET = 4_096


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row per source: _source (key), source_size, _rows, _index and target.

    The sources share 150% of all sizes by weight; a target stops at 2 times its source's size,
    and the excess is shared again. So the targets are min(cap, level x weight) with one level:
    sources that stop are those of the least cap per weight, found by running sums over the
    sources. These may be many, such as domains: they are ranked by ranges, and only sums come to the driver.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"), F.count("*").alias("_rows"))
    per = running(per.withColumn("_none", F.col("source").isNull()), ["_none", "source"], {"_index": Running(F.sum, F.lit(1).cast("long"))})
    per = per.withColumn("_index", F.coalesce("_index", F.lit(0)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_index") % len(weights) + 1).cast("int"))
    per = cut_lineage(per.withColumn("_weight", weight))
    total, shares = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    ranked = running(per.withColumn("_ratio", 2.0 * F.col("source_size") / F.col("_weight")), ["_ratio", "_index"], {"_capped": Running(F.sum, 2 * F.col("source_size")), "_used": Running(F.sum, F.col("_weight"))})
    ranked = ranked.withColumn("_capped", F.coalesce("_capped", F.lit(0))).withColumn("_left", F.lit(shares) - F.coalesce("_used", F.lit(0)))
    # The level, were all sources before this one at their caps; it holds from the first source that it leaves below its cap.
    fits = 2 * F.col("source_size") * 2 * F.col("_left") > F.col("_weight") * (F.lit(3 * total) - 2 * F.col("_capped"))
    level = ranked.agg(F.min(F.when(fits, F.struct("_capped", "_left")))).first()[0]
    target = 2.0 * F.col("source_size")
    if level is not None:
        share = (F.col("_weight") * F.lit(3 * total - 2 * level["_capped"])).cast("double") / F.lit(float(2 * level["_left"]))
        target = F.least(share, target)
    return per.select("_source", "source_size", "_rows", "_index", target.alias("target"))


def _time(share: Column, schedule: Sequence[float]) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole."""
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    wanted, done, out = share * F.lit(sum(areas)), 0.0, None
    for k, area in enumerate(areas):
        rest, slope = F.greatest(wanted - F.lit(done), F.lit(0.0)), (schedule[k + 1] - schedule[k]) / step
        root = F.sqrt(F.greatest(F.lit(schedule[k] ** 2) + 2 * slope * rest, F.lit(0.0)))
        here = F.lit(k * step) + F.coalesce(F.try_divide(2 * rest, F.lit(schedule[k]) + root), F.lit(0.0))
        out = here if out is None else F.when(wanted < F.lit(done), out).otherwise(here)
        done += area
    return out


def curriculum(docs: DataFrame, rows: int, sized: DataFrame | None = None, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """All rows and columns of ``docs`` (it has doc_id, source and size), with source_size, target and positions.

    positions: the training position of each time that the mix takes the document, 0 to 2 of them.
    A pass over a document is taken if its middle word lies before the target, so that the taken words of
    a source differ from its target by half a document at most. Null sources make one source, the last. Rows that
    repeat a doc_id count as documents of their own; equal ones stand side by side. Documents without doc_id stand together,
    unless a column _spread tells them apart. Empty documents take no words. ``sized``
    may be a stored frame of doc_id, source and size (and _spread), for the sums. ``rows`` says into how many buckets a source is cut.
    """
    if any(len(s) < 2 or min(s) < 0 or max(s) <= 0 for s in schedules):
        raise ValueError("a schedule has two knots at least, none below 0, one above")
    keyed = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))).withColumn("_order", F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), *spread, F.lit("")))))
    spread = [F.col("_spread").cast("string")] if "_spread" in docs.columns else []
    docs, narrow = keyed(docs), keyed(sized if sized is not None else docs.select("doc_id", "source", "size", *(["_spread"] if spread else [])))
    targets = source_targets(narrow, weights)
    placed = prefix_sums(docs, "_source", "_order", ["doc_id", "size"], "size", bucket_bits(rows, rows_per_bucket), "_before", narrow)
    placed = join_hot(placed.drop("source_size", "target", "positions"), targets, "_source", "_rows", rows).drop("_rows")
    times = []
    for epoch in (0, 1):
        middle = (F.col("source_size") * epoch + F.col("_before")).cast("double") + F.col("size") / 2.0
        share = F.coalesce(F.try_divide(middle, F.col("target")), F.lit(0.0))
        time = F.coalesce(*[F.when(F.col("_index") % len(schedules) == k, _time(share, s)) for k, s in enumerate(schedules)])
        times.append(F.when(middle < F.col("target"), time))
    return placed.withColumn("positions", F.array_compact(F.array(*times))).drop("_source", "_order", "_before", "_index", "_spread")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each position, sorted by it over all partitions."""
    rows = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text")))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, one row per document, and the training positions of its two readings, -1 where there is none.

    The mix itself is built and stored, a row for each reading in training order; what is taken, and where, is read back from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = cut_lineage(with_size(docs).select("doc_id", "source", "size", F.monotonically_increasing_id().alias("_row")))
    mixed = cut_lineage(curriculum(sized, sized.count(), sized.drop("_row")))
    mix = cut_lineage(in_training_order(mixed.select("_row", "doc_id", "size", "positions")))
    read = mix.groupBy("_row").agg(F.count("*").alias("_times"), F.sum("size").alias("taken"), F.min("position").alias("_first"), F.max("position").alias("_last"))
    first, second = F.coalesce("_first", F.lit(-1.0)), F.when(F.col("_times") > 1, F.col("_last")).otherwise(-1.0)
    taken = F.coalesce("taken", F.lit(0)).cast("long")
    return mixed.join(read, "_row", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"), second.alias("second_position"))


def _position_sql(middle: str) -> str:
    """The position of a reading by the schedules: flat, rising or falling, whose integrals over 0 to 1 are all 1."""
    share = f"coalesce(({middle}) / nullif(t.target, 0), 0.0::DOUBLE)"
    bend = lambda start, area, sign: (
        f"CASE WHEN {share} < {area} THEN 2 * {share} / ({start}::DOUBLE + sqrt(greatest({start * start}::DOUBLE + {sign}2.0::DOUBLE * {share}, 0.0::DOUBLE))) "
        f"ELSE 0.5::DOUBLE + 2 * ({share} - {area}::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + {sign}2.0::DOUBLE * ({share} - {area}::DOUBLE), 0.0::DOUBLE))) END"
    )
    return f"CASE WHEN {middle} < t.target THEN CASE t.n % 3 WHEN 0 THEN 2 * {share} / 2.0::DOUBLE WHEN 1 THEN {bend(0.5, 0.375, '')} ELSE {bend(1.5, 0.625, '-')} END ELSE -1.0::DOUBLE END"


_FIRST, _SECOND = "CAST(before AS DOUBLE) + p.size / 2.0::DOUBLE", "CAST(t.source_size + before AS DOUBLE) + p.size / 2.0::DOUBLE"

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM i),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(2 * source_size) OVER r, 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS BIGINT) AS open_weight
  FROM w WINDOW r AS (ORDER BY 2.0::DOUBLE * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT capped, open_weight FROM c WHERE 2 * source_size * 2 * open_weight > weight * (3 * total - 2 * capped) ORDER BY capped, open_weight LIMIT 1),
t AS (SELECT c.source, c.source_size, c.n, CASE WHEN l.capped IS NULL THEN 2.0::DOUBLE * source_size
    ELSE least(CAST(weight * (3 * total - 2 * l.capped) AS DOUBLE) / CAST(2 * l.open_weight AS DOUBLE), 2.0::DOUBLE * source_size) END AS target
  FROM c LEFT JOIN l ON true),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
  CAST(p.size * (CASE WHEN {_FIRST} < t.target THEN 1 ELSE 0 END + CASE WHEN {_SECOND} < t.target THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  {_position_sql(_FIRST)} AS first_position, {_position_sql(_SECOND)} AS second_position
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
