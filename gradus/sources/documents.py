"""Nested JSON outputs (S6, T2): lists of a category or a split, with their metadata and validation.

A list has no bound, so it is not one JSON value: a document holds about ``LIST_ROWS`` entries at
most, and a long list is several documents numbered by ``part``. The entries are dealt to the parts of
their list by a hash of their key, so a hot category is written by many tasks. The metadata is one
document, as it is of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gradus.functions.ranking import join_on
from gradus.operators.split import leakage_audit
from gradus.sources.scratch import written

# Entries of one JSON document on average: the bound of an aggregated array
LIST_ROWS = 10_000


def list_documents(df: DataFrame, by: Sequence[str], key: str, columns: Sequence[str],
                   rows: int = LIST_ROWS) -> DataFrame:
    """(by..., part, entries ARRAY<STRUCT<columns>>): the rows of every list (NULL is a list too), about
    ``rows`` entries a document, sorted by the entries. The rows are written first, as they are
    counted and then dealt. Rows that share their key share a part: keys should be (nearly) unique."""
    df = written(df.select(*dict.fromkeys([*by, key, *columns])), "list-rows")
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("_parts"))
    dealt = join_on(df, sizes, by).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")))
    entry = F.struct(*columns)
    return dealt.groupBy(*by, "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a line; nested columns stay nested and nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_lists(spark: SparkSession, path: str, by: Sequence[StructField], entry: StructType) -> DataFrame:
    """The rows of written list documents: (by..., columns of the entries)."""
    schema = StructType([*by, StructField("part", LongType()), StructField("entries", ArrayType(entry))])
    x = spark.read.schema(schema).json(path)
    return x.select(*[f.name for f in by], F.explode("entries").alias("_e")).select(*[f.name for f in by], "_e.*")


def split_metadata(split: DataFrame, parameters: dict[str, object], id_col: str = "dms_id",
                   protein: str = "protein", cluster: str = "cluster") -> DataFrame:
    """One row: the parameters of a split and ``validation`` (J6: sizes, overlaps, valid) as a struct."""
    audit = leakage_audit(split, id_col, protein, cluster)
    given: list[Column] = [F.lit(v).alias(k) for k, v in parameters.items()]
    return audit.select(*given, F.struct(*audit.columns).alias("validation"))


def write_split(split: DataFrame, path: str, parameters: dict[str, object], id_col: str = "dms_id",
                protein: str = "protein", cluster: str = "cluster", rows: int = LIST_ROWS) -> None:
    """T2's outputs below ``path``: ``lists`` (train and test ids with their category and cluster),
    ``leaks`` (clusters on both sides, the reason of an invalid split) and ``metadata``."""
    split = written(split, "split")
    write_documents(list_documents(split, ["split"], id_col, [id_col, "category", cluster], rows), f"{path}/lists")
    sides = split.groupBy(cluster).agg(F.min("split").alias("_lo"), F.max("split").alias("_hi"))
    leaks = sides.where("_lo <> _hi").select(F.lit("cluster").alias("level"), cluster)
    write_documents(list_documents(leaks, ["level"], cluster, [cluster], rows), f"{path}/leaks")
    write_documents(split_metadata(split, parameters, id_col, protein, cluster), f"{path}/metadata")


def category_documents(assays: DataFrame, path: str, category: str = "assigned_category", id_col: str = "dms_id",
                       columns: Sequence[str] = ("original_type", "matched_keywords", "confidence", "reason", "num_mutants"),
                       rows: int = LIST_ROWS) -> None:
    """T1's outputs below ``path``: ``lists`` (a category's assays with the decision log of each) and
    ``summary`` (one document a category: assays, variants)."""
    assays = written(assays, "categorized")
    write_documents(list_documents(assays, [category], id_col, [id_col, *columns], rows), f"{path}/lists")
    summary = assays.groupBy(category).agg(F.count(F.lit(1)).alias("n_assays"),
                                           F.coalesce(F.sum("num_mutants"), F.lit(0)).alias("n_variants"))
    write_documents(summary, f"{path}/summary")
