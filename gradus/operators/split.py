"""Group-aware train/test split and leakage audit.

Clusters are put in a deterministic pseudo-random order by md5(seed, category,
cluster) — identical in any engine and independent of partitioning — and the
first ``max(1, int(n * test_fraction))`` clusters of each category go to test.
The position of a cluster in that order is an exact rank computed with the
skew-safe ``rank_values`` (no whole category in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.ranking import join_on, rank_values

PRIORITY = ("stability", "binding", "expression", "activity")


def attach_cluster(items: DataFrame, clusters: DataFrame, id_col: str, out: str = "cluster") -> DataFrame:
    """Item -> cluster representative; an item absent from the cluster table is its
    own cluster. Duplicate members keep one representative (the largest, deterministic)."""
    c = clusters.groupBy("member").agg(F.max("representative").alias("_rep"))
    j = items.join(c, items[id_col] == c["member"], "left")
    return j.withColumn(out, F.coalesce(F.col("_rep"), F.col(id_col))).drop("member", "_rep")


def attach_category(rows: DataFrame, categories: DataFrame, id_col: str = "dms_id") -> DataFrame:
    """Rows -> their assay's category (inner equi-join; the category table has one
    row per assay, so AQE broadcasts it when its measured size allows)."""
    return rows.join(categories, id_col, "inner")


def md5_key(seed: int, *parts: str) -> F.Column:
    """Order key md5(seed || part1 || part2 ...) as hex text."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def _hex_rank_key(h: F.Column) -> F.Column:
    # first 15 hex digits (60 bits) as a number: an order-preserving prefix of the md5 text
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def stratified_group_split(assign: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                           mode: str = "per_category", id_col: str = "dms_id",
                           category: str = "category", cluster: str = "cluster",
                           priority: Sequence[str] = PRIORITY) -> DataFrame:
    """(id, category, cluster) -> adds ``split`` in {train, test}.

    ``per_category``: clusters are split inside each category (a cluster seen in two
    categories can land on both sides — the faithful behaviour). ``global``: each
    cluster first gets one home category (most of its assays, ties by ``priority``),
    so it is assigned exactly once and the audit finds no overlap.
    """
    if mode not in ("per_category", "global"):
        raise ValueError(f"unknown split mode: {mode}")
    pr = F.create_map(*[F.lit(x) for i, c in enumerate(priority) for x in (c, i)])
    if mode == "global":
        counts = assign.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("_n"))
        prio = F.coalesce(F.element_at(pr, F.col(category)), F.lit(len(priority)))
        home = counts.groupBy(cluster).agg(
            F.max_by(category, F.struct(F.col("_n"), -prio, F.col(category))).alias("_home"))
        units = home.select(F.col("_home").alias(category), cluster)
    else:
        units = assign.select(category, cluster).distinct()
    units = units.withColumn("_h", md5_key(seed, category, cluster)).withColumn("_k", _hex_rank_key(F.col("_h")))
    vc = units.groupBy(category, "_k").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = rank_values(vc, category, "_k")
    n_test = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(test_fraction)))).cast("long")
    ranked = ranked.withColumn("split", F.when(F.col("before") < n_test, "test").otherwise("train"))
    decided = join_on(units, ranked.select(category, "_k", "split"), [category, "_k"]).select(category, cluster, "split")
    if mode == "global":
        return assign.join(decided.select(cluster, "split"), cluster, "left")
    return assign.join(decided, [category, cluster], "left")


def leakage_audit(split: DataFrame, id_col: str = "dms_id", protein: str = "protein",
                  cluster: str = "cluster") -> DataFrame:
    """One row with assays / proteins / clusters per side, the number of ids,
    proteins and clusters found on both sides, and ``valid`` (no id and no cluster
    overlap). The split is read once: each row is exploded into its three level
    keys, aggregated per level key, then one conditional aggregation — no join."""
    keys = F.array(*[F.struct(F.lit(lvl).alias("l"), F.col(col).cast("string").alias("k"))
                     for lvl, col in (("assays", id_col), ("proteins", protein), ("clusters", cluster))])
    levels = split.select(F.explode(keys).alias("_lk"), "split") \
        .select(F.col("_lk.l").alias("_lvl"), F.col("_lk.k").alias("_key"), "split")
    per_key = levels.groupBy("_lvl", "_key").agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("_tr"),
        F.max(F.when(F.col("split") == "test", 1).otherwise(0)).alias("_te"))

    def total(lvl: str, c: F.Column) -> F.Column:
        return F.sum(F.when(F.col("_lvl") == lvl, c).otherwise(0)).cast("long")

    both = F.col("_tr") * F.col("_te")
    out = per_key.agg(total("assays", F.col("_tr")).alias("train_assays"),
                      total("assays", F.col("_te")).alias("test_assays"),
                      total("proteins", F.col("_tr")).alias("train_proteins"),
                      total("proteins", F.col("_te")).alias("test_proteins"),
                      total("clusters", F.col("_tr")).alias("train_clusters"),
                      total("clusters", F.col("_te")).alias("test_clusters"),
                      total("assays", both).alias("n_id_overlap"),
                      total("proteins", both).alias("n_protein_overlap"),
                      total("clusters", both).alias("n_cluster_overlap"))
    return out.withColumn("valid", (F.col("n_id_overlap") == 0) & (F.col("n_cluster_overlap") == 0))


def overlapping(split: DataFrame, col: str) -> DataFrame:
    """U1 on a split: values of ``col`` present in both train and test."""
    # one read of the split: a value overlaps when it has rows on both sides
    per = split.groupBy(col).agg(F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("_tr"),
                                 F.max(F.when(F.col("split") == "test", 1).otherwise(0)).alias("_te"))
    return per.filter((F.col("_tr") == 1) & (F.col("_te") == 1)).select(col)


def id_in_split(items: DataFrame, split: DataFrame, side: str, id_col: str = "dms_id") -> DataFrame:
    """Keep the items whose id is on the given side of the split (left semi join)."""
    ids = split.filter(F.col("split") == side).select(id_col)
    return items.join(ids, id_col, "left_semi")
