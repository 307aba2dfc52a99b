"""Small column helpers used across operators and query bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column to ``digits`` (outputs are compared at 6 digits)."""
    scale = float(10 ** digits)
    # round(x * 10^d) / 10^d (+0.0 turns -0.0 into 0.0): the same IEEE steps give the
    # same double in any SQL engine, unlike round(x, d) whose half-way handling differs
    cols = [(F.round(F.col(f.name) * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def md5_order(*parts) -> "F.Column":
    """Deterministic, partition-independent pseudo-random order key: md5 of the
    concatenated parts (same value in any SQL engine that has md5)."""
    return F.md5(F.concat(*[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts]))


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows round-robin over ``partitions`` before a step that is CPU-heavy per row
    (one file with one row group arrives in one partition); None leaves the input's own splits,
    the choice for tables of many files."""
    return df if partitions is None else df.repartition(partitions)
