"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] = (), order: list[str] = ()) -> None:
    """A Zstandard Parquet snapshot that appears as a whole; an existing one is an error, for snapshots don't change."""
    out = df.sortWithinPartitions(*order) if order else df
    out.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_manifested(df: DataFrame, manifest: DataFrame, key: str, path: str) -> None:
    """Write exactly the manifest's rows; any missing or repeated one is an error and nothing is written."""
    chosen = df.join(manifest.select(key).distinct(), key, "left_semi")
    have = chosen.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first()
    want = manifest.select(key).distinct().count()
    if not have["n"] == have["d"] == want:
        raise ValueError(f"the manifest has {want} ids, the table {have['n']} rows of {have['d']}")
    write_snapshot(chosen, path, order=[key])


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON lines of a declared schema."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("r"))
    return raw.where("r._bad is null").select("r.*").drop("_bad"), raw.where("r._bad is not null").select(F.col("value").alias("line"))
