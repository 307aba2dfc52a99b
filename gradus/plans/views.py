"""Bindings of the driver tables to the domain views (see FIXTURES.md, part 2).

Each view is a lazy DataFrame over the given parquet tables; nothing is
materialised, so the operators built on top prune and push down into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions.ranking import row_positions
from gradus.operators.score import AMINO
from gradus.sources.tables import table

# Fixed values of the harness binding (FIXTURES.md):
# row key of lineitem used for every tie-break
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "l_quantity", "l_shipdate"]


def v_assay(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("num_mutants"))
    return (part.join(counts, part.p_partkey == counts.l_partkey, "left")
            .select(F.col("p_partkey").alias("dms_id"), F.col("p_partkey").alias("file_order"),
                    F.col("p_name").alias("uniprot_id"),
                    F.when(F.col("p_type").isin("SMALL", "PROMO"), F.lit("OrganismalFitness"))
                     .otherwise(F.col("p_type")).alias("coarse_type"),
                    F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("phenotype"),
                    F.col("num_mutants")))


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("dms_id"), *LINE_KEY,
                     F.col("l_extendedprice").alias("dms_score"),
                     (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("pred"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("dms_score_bin"))


v_variant = v_pred


def v_model_pred(spark: SparkSession, d: str) -> DataFrame:
    """Long predictions of three models; an unpivot (explode of a 3-element array), not a join."""
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    models = F.explode(F.array(
        F.struct(F.lit("quantity").alias("model"), F.col("l_quantity").alias("pred")),
        F.struct(F.lit("discount").alias("model"), F.col("l_discount").alias("pred")),
        F.struct(F.lit("tax").alias("model"), F.col("l_tax").alias("pred"))))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_partkey").alias("dms_id"), F.col("p_type").alias("category"),
                    F.col("l_extendedprice").alias("y"), *LINE_KEY, models.alias("m"))
            .select("m.model", "dms_id", "category", "y", F.col("m.pred").alias("pred"), *LINE_KEY))


def v_model_items(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column, list[str]]:
    """The rows of ``v_model_pred`` before the models are unpivoted: items, array of predictions, its columns."""
    part = table(spark, d, "part").select("p_partkey", "p_type")
    preds = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    li = table(spark, d, "lineitem")
    items = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("dms_id"), F.col("p_type").alias("category"), F.col("l_extendedprice").alias("y"), *preds.values())
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in preds.items()])
    return items, models, list(preds.values())


def v_list(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("list_id"), "l_orderkey", "l_linenumber", "l_suppkey",
                     "l_shipdate", "l_extendedprice", "l_quantity",
                     (F.col("l_extendedprice") / F.lit(100000.0)).alias("y_true"),
                     (F.col("l_quantity") / F.lit(50.0)).alias("y_pred"),
                     F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("valid"))


def v_token(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    aa = F.lit(AMINO)
    tok = F.concat(F.substring(aa, (F.col("l_suppkey") % 20).cast("int") + 1, 1),
                   F.col("l_quantity").cast("int").cast("string"),
                   F.substring(aa, (F.col("l_partkey") % 20).cast("int") + 1, 1))
    return li.select(F.col("l_orderkey").alias("item"), tok.alias("tok"))


def v_mutant(spark: SparkSession, d: str) -> DataFrame:
    """Colon-joined multi-mutants, one per order (an order holds at most 7 lines)."""
    return (v_token(spark, d).groupBy("item")
            .agg(F.array_join(F.array_sort(F.collect_list("tok")), ":").alias("mutant")))


def v_vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("idx", "v")) \
            .withColumn("v", F.col("v").cast("double"))


def v_tau(spark: SparkSession, d: str) -> DataFrame:
    """Task vector per label = class mean - global mean, one row per (property, idx)."""
    vec = v_vec(spark, d)
    cls = vec.groupBy("label", "idx").agg(F.avg("v").alias("cv"))
    glob = vec.groupBy("idx").agg(F.avg("v").alias("gv"))
    return (cls.join(glob, "idx")
            .select(F.col("label").alias("property"), "idx", (F.col("cv") - F.col("gv")).alias("v")))


def v_lowrank(spark: SparkSession, d: str) -> DataFrame:
    """Low-rank factors over all embeddings: 4 properties, prefix = vec_id div 8,
    A for (vec_id div 4) even, B for odd; each 64-vector is an 8x8 matrix."""
    vec = v_vec(spark, d)
    return vec.select((F.col("vec_id") % 4).cast("int").alias("property"),
                      F.floor(F.col("vec_id") / 8).cast("int").alias("prefix"),
                      F.when(F.floor(F.col("vec_id") / 4) % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("matrix"),
                      F.floor(F.col("idx") / 8).cast("int").alias("r"),
                      (F.col("idx") % 8).cast("int").alias("c"), "v")


def v_trainlog(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    daily = (ev.groupBy(F.col("event_type").alias("property"),
                        F.to_date(F.date_trunc("day", "ts")).alias("d"))
             .agg(F.avg("value").alias("val")))
    w = Window.partitionBy("property").orderBy("d")
    return daily.select("property", F.row_number().over(w).cast("int").alias("epoch"), "val")


def v_steplog(spark: SparkSession, d: str) -> DataFrame:
    """Steps numbered inside each (property, day) by time: exact positions from value ranges, so a
    day of any length is numbered by many tasks."""
    ev = table(spark, d, "events")
    x = ev.select(F.col("event_type").alias("property"), F.to_date(F.date_trunc("day", "ts")).alias("epoch"),
                  F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), "event_id", F.col("value").alias("loss"))
    x = row_positions(x, ["property", "epoch"], "_us", ["event_id"], "step")
    return x.select("property", "epoch", F.col("step").cast("int").alias("step"), "loss",
                    F.concat(F.lit("step_"), F.col("event_id").cast("string")).alias("name"))


def v_seq(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.col("lang").alias("category"), "source", "text", "n_chars")
