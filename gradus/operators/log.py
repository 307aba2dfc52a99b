"""Training-log analytics (W6-W8, P10, W7) over append-only logs.

Per-property windows run over one row per epoch (bounded); step-level running
means use block prefix sums (block totals aggregated, offsets over the blocks,
in-block windows of at most ``block`` rows), so a long epoch is never one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions.ranking import join_on


def best_epoch_early_stop(log: DataFrame, group: str = "property", epoch: str = "epoch", metric: str = "val",
                          patience: int = 5) -> DataFrame:
    """Per group the epoch where early stopping fires (first epoch with
    epochs-since-best >= patience; NULL if never), the best epoch and value among the
    epochs that ran (strict improvement over the running best), and epochs run. A NULL group is a
    group; one exchange in all."""
    w_prev = Window.partitionBy(group).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_cur = Window.partitionBy(group).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = log.withColumn("_prev", F.max(metric).over(w_prev)) \
        .withColumn("improved", F.col("_prev").isNull() | (F.col(metric) > F.col("_prev")))
    x = x.withColumn("_last", F.max(F.when(F.col("improved"), F.col(epoch))).over(w_cur)) \
        .withColumn("epochs_since", (F.col(epoch) - F.col("_last")).cast("int"))
    fired = F.when(F.col("epochs_since") >= patience, F.col(epoch))
    x = x.withColumn("stop_epoch", F.min(fired).over(Window.partitionBy(group)))  # in the exchange of the windows before
    ran = x.filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return ran.groupBy(group).agg(
        F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"),
        F.max(metric).alias("best_val"), F.first("stop_epoch").alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"))


def running_mean(df: DataFrame, group: Sequence[str], pos: str, value: str, out: str = "running_loss",
                 block: int = 4096) -> DataFrame:
    """Mean of ``value`` over positions 1..pos inside each group (pos is a dense
    1-based step number), by block prefix sums."""
    g = list(group)
    b = F.floor((F.col(pos) - 1) / block).cast("long")
    x = df.withColumn("_blk", b)
    tot = x.groupBy(*g, "_blk").agg(F.sum(value).alias("_bs"), F.count(F.lit(1)).alias("_bc"))
    wb = Window.partitionBy(*g).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*g, "_blk", F.coalesce(F.sum("_bs").over(wb), F.lit(0.0)).alias("_os"),
                     F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_oc"))
    wi = Window.partitionBy(*g, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_s", F.sum(value).over(wi)).withColumn("_c", F.count(F.lit(1)).over(wi))
    x = join_on(x, tot, g + ["_blk"])
    return x.withColumn(out, (F.col("_os") + F.col("_s")) / (F.col("_oc") + F.col("_c"))) \
            .drop("_blk", "_s", "_c", "_os", "_oc")


def latest_and_retention(listing: DataFrame, group: str, name: str = "name", keep_last: int = 3,
                         prefix: str = "step_") -> DataFrame:
    """Per group, parse the step number from names ``<prefix>N``; mark the highest
    as ``latest``, the next ``keep_last``-1 as ``keep`` and every older one as
    ``remove`` (a list — nothing is deleted). Unparsable names are ignored.
    Top-n is a ``row_number() <= n`` filter (partial top-n before the shuffle); the
    rest is an anti join."""
    num = F.regexp_extract(F.col(name), f"^{prefix}([0-9]+)$", 1)
    x = listing.select(group, name, num.alias("_n")).filter(F.col("_n") != "") \
        .withColumn("step_num", F.col("_n").cast("long")).drop("_n")
    w = Window.partitionBy(group).orderBy(F.col("step_num").desc(), F.col(name).desc())
    top = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep_last)
    top = top.withColumn("action", F.when(F.col("_r") == 1, F.lit("latest")).otherwise(F.lit("keep"))).drop("_r")
    kept = top.select(F.col(group).alias("_g"), F.col(name).alias("_name"))
    rest = x.join(kept, x[group].eqNullSafe(kept["_g"]) & (x[name] == kept["_name"]), "left_anti").withColumn("action", F.lit("remove"))
    return top.unionByName(rest)


def lr_multiplier(step: Column, total: Column, warmup_ratio: float = 0.1, num_cycles: float = 0.5) -> Column:
    """P10: cosine-with-warmup multiplier of optimizer step 0..total-1: step/warmup during
    warm-up, then max(0, 0.5 (1 + cos(pi * 2 * cycles * progress)))."""
    warm = F.floor(total * F.lit(float(warmup_ratio)))
    s = step.cast("double")
    prog = (s - warm) / F.greatest(F.lit(1), total - warm).cast("double")
    return F.when(step < warm, s / F.greatest(F.lit(1), warm).cast("double")) \
        .otherwise(F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi) * 2.0 * num_cycles * prog))))


def lr_schedule(steps: DataFrame, group: str, step: str, warmup_ratio: float = 0.1, num_cycles: float = 0.5) -> DataFrame:
    """P10 on a step log: the rows with ``lr_mult``; a run's length is the number of its log rows."""
    total = steps.groupBy(group).agg(F.count(F.lit(1)).alias("_total"))
    return join_on(steps, total, [group]).withColumn("lr_mult", lr_multiplier(F.col(step), F.col("_total"), warmup_ratio, num_cycles)).drop("_total")


def total_optimizer_steps(n_variants: int, list_size: int, epochs: int, accum: int) -> int:
    """steps/epoch = max(1, n div list_size); total = steps * epochs div accum."""
    return (max(1, n_variants // list_size) * epochs) // accum
