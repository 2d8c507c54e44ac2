"""The corpus pipeline: stages over documents, each one of the operators in tidemark.llm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, sharding, simhash
from tidemark.llm.common import cut_lineage, volume


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, source and text beside the whole row, whose columns then can't clash with those that an operator adds."""
    return docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undecided or scored too low.

    Null texts and those without a letter go. Each row counts for itself, whether it repeats another or lacks its doc_id; equal texts fare alike. All
    columns stay as they are, whatever their names. Where no row has a language, nothing is learned and every row goes; an empty table stays empty.
    """
    model = langid.train(docs)
    return langid.accepted(langid.identify(_packed(docs), model)).select("_row.*")


def _row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that tell the rows of ``docs`` apart by all columns but maps, which can't be hashed."""
    hashable = [docs[f.name] for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    values = [x for c in hashable for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(k), *values).alias(f"_key_{k}") for k in (0, 1)]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of copies, edited ones too, one row: that with its least doc_id (nulls last); of rows that repeat that doc_id, the one of least hash.

    Rows without doc_id and rows that share one are told apart by their other columns, so that no text is lost with them; of rows that agree in everything one stays.
    All texts without words, null ones too, make one group. All columns stay as they are; an empty table stays empty.
    """
    keys = _row_keys(docs)
    kept = simhash.edited_copies(docs.select(F.isnull("doc_id").alias("_none"), "doc_id", *keys, "text"), ["_none", "doc_id", "_key_0", "_key_1"])
    rows = docs.select(*keys, F.struct(*[docs[c] for c in docs.columns]).alias("_row")).join(kept.select("least._key_0", "least._key_1"), ["_key_0", "_key_1"], "left_semi")
    return rows.dropDuplicates(["_key_0", "_key_1"]).select("_row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents.

    Null texts and those without words stay; each row counts for itself, repeated or not. All columns stay as they are. Without benchmark, or without documents, nothing changes.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_verdict(decontaminate.find_contamination(_packed(docs), benchmark))
    return found.where("NOT contaminated").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents none to two times, in the order of their training positions.

    Null sources make one source, the last. Documents without words take no room: they come as often as their place asks. Rows that repeat a doc_id are documents of their own;
    those without one are ordered by a hash of their text. Equal positions go by doc_id. All columns stay as they are; an empty table stays empty.
    """
    spread = F.xxhash64("text").alias("_spread")
    sized = cut_lineage(mixing.with_size(docs.select("doc_id", "source", spread, "text")).drop("text"))
    packed = mixing.with_size(_packed(docs).withColumn("_spread", spread)).drop("text")
    return mixing.in_training_order(mixing.curriculum(packed, volume(docs)[1], sized)).select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot, both by doc_id; columns of these names are replaced, all others stay as they are.

    Rows that repeat a doc_id, and all without one, share a shard. Slots count from 0 in each shard without gaps. Texts don't matter, null or not; an empty table stays empty.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, storing what each returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
