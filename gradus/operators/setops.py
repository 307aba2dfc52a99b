"""Set operators and file-set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_missing(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected minus actual (distinct)."""
    return expected.subtract(actual)


def resume_union(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Prior rows followed by new rows, matched by column name."""
    return prior.unionByName(new)


def manifest_check(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """S3: one-row manifest report: expected and found counts, number missing,
    all_found, and found ids that were not expected. The missing ids themselves
    are rows of ``set_missing`` (never collected into one value)."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    f = found.select(key).distinct().withColumn("_f", F.lit(True))
    j = e.join(f, key, "full")
    return j.agg(F.sum(F.when(F.col("_e"), 1).otherwise(0)).cast("long").alias("expected_count"),
                 F.sum(F.when(F.col("_e") & F.col("_f"), 1).otherwise(0)).cast("long").alias("found_count"),
                 F.sum(F.when(F.col("_e") & F.col("_f").isNull(), 1).otherwise(0)).cast("long").alias("n_missing"),
                 (F.sum(F.when(F.col("_e") & F.col("_f").isNull(), 1).otherwise(0)) == 0).alias("all_found"),
                 F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)).cast("long").alias("n_unexpected"))


def distinct_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str], value: str | None = None) -> DataFrame:
    """U4: first row per key by ``order`` (deterministic, unlike dropDuplicates); then,
    if ``value`` is given, drop keys whose first row has a NULL/empty value.
    Implemented as ``min_by`` over a struct, i.e. a partial aggregation, so a key
    holding a third of the rows is still combined map-side."""
    k = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in k]
    ordk = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(*k).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_r"))
    out = first.select(*k, *[F.col(f"_r.{c}").alias(c) for c in rest])
    if value is not None:
        out = out.filter(F.col(value).isNotNull() & (F.length(F.col(value)) > 0))
    return out


__all__ = ["set_missing", "resume_union", "manifest_check", "distinct_first"]
