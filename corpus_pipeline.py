"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlake.llm import bpe, lines, mixing, quality, simhash
from pitlake.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occurred before; a document of which no word is left goes, n_chars follows the text."""
    out = lines.dedup_lines(docs).where("n_removed = 0 or text rlike '[^ \\t\\n\\x0B\\f\\r]'")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group, once."""
    near = simhash.near_duplicates(docs)
    return docs.join(near.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix, small sources repeated to meet their weights."""
    return mixing.mix(docs).select(*COLUMNS, "place").repartitionByRange("place").sortWithinPartitions("place").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode(docs, keep=["doc_id", "source"], digests=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
