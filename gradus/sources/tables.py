"""Driver tables: one parquet file (or folder) per table under an ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fan_out(df: DataFrame) -> int | None:
    """Partitions to deal a table of a single file over, before CPU-heavy steps; None for a table of
    several files, whose scan is wide by itself. Reads the file list only."""
    return df.sparkSession.sparkContext.defaultParallelism if len(df.inputFiles()) == 1 else None
