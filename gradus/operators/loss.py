"""List-wise ranking losses as aggregates.

Lists of every size take the same plans: positions and running sums come from the
skew-safe primitives of ``gradus.functions.ranking``, and the pairwise hinge loss is
summed without forming a pair of a long list. Only J7, whose result is the pairs, grows with their
number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions.ranking import join_on, per_size, rank_values, row_positions, running_sums, sorted_sums, value_counts
from gradus.sources.scratch import written

EPS = 1e-10
#: Items of a list whose pairs are formed for the hinge loss.
SMALL = 128


def suffix_logsumexp(df: DataFrame, list_id: str, y_true: str, y_pred: str, key: Sequence[str],
                     mask: str | None = None) -> DataFrame:
    """For each item, the sum of exp(pred - list max) over the items at or after it
    in descending true-score order (ties by ``key``, NULL scores last), masked items
    contributing 0. Adds ``_mx`` (list max over all items, masked ones too) and ``suffix``.

    Lists are read from the end: the sum over the items behind an item, and its own."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    behind = [F.col(y_true).asc_nulls_first(), *[F.col(c).desc_nulls_first() for c in key]]

    def sums(d: DataFrame, cut: bool) -> DataFrame:
        if cut:
            x = join_on(d, d.groupBy(list_id).agg(F.max(y_pred).alias("_mx")), [list_id])
        else:  # a list is in one task for its sums anyhow
            x = d.withColumn("_mx", F.max(y_pred).over(Window.partitionBy(list_id)))
        x = x.withColumn("_e", F.exp(F.col(y_pred) - F.col("_mx")) * m)
        return sorted_sums(x, list_id, behind, {"_e": "_after"}, cut)

    x = per_size(df, list_id, sums)
    return x.withColumn("suffix", F.col("_after") + F.col("_e")).drop("_e", "_after", "_after_all")


def listmle_loss(df: DataFrame, list_id: str, y_true: str, y_pred: str, key: Sequence[str],
                 mask: str | None = None, eps: float = EPS) -> DataFrame:
    """Plackett-Luce negative log-likelihood per list, divided by the number of
    valid items (at least 1). Returns (list_id, n_valid, loss)."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    x = suffix_logsumexp(df, list_id, y_true, y_pred, key, mask)
    term = (F.log(F.col("suffix") + F.lit(eps)) - (F.col(y_pred) - F.col("_mx"))) * m
    return x.groupBy(list_id).agg(F.sum(m).cast("long").alias("n_valid"),
                                  (F.sum(term) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"))


def mse_loss(df: DataFrame, list_id: str, y_true: str, y_pred: str, mask: str | None = None) -> DataFrame:
    """Mean squared error per list over the valid items (NULL when none)."""
    x = df if mask is None else df.filter(F.col(mask) == 1)
    return x.groupBy(list_id).agg(F.count(F.lit(1)).alias("n_valid"),
                                  F.avg(F.pow(F.col(y_pred) - F.col(y_true), 2)).alias("loss"))


def pair_selfjoin(df: DataFrame, list_id: str, y_true: str, y_pred: str, item: Sequence[str]) -> DataFrame:
    """Ordered pairs (i, j) inside a list with true_i > true_j — an equi-join on the
    list id with a range predicate. The pairs are the result, so it grows with their number:
    meant for the ranking lists of W5 (``list_size`` items). The hinge loss doesn't use it."""
    a = df.select(list_id, *[F.col(c).alias(f"i_{c}") for c in item],
                  F.col(y_true).alias("yt_i"), F.col(y_pred).alias("yp_i"))
    b = df.select(list_id, *[F.col(c).alias(f"j_{c}") for c in item],
                  F.col(y_true).alias("yt_j"), F.col(y_pred).alias("yp_j"))
    return a.join(b, list_id).filter(F.col("yt_i") > F.col("yt_j"))


def pairwise_hinge_loss(df: DataFrame, list_id: str, y_true: str, y_pred: str, item: Sequence[str] = (),
                        margin: float = 1.0) -> DataFrame:
    """A10: mean over ordered pairs with true_i > true_j of max(0, margin - (p_i - p_j));
    a list without such pairs has loss 0 (the mask is ignored, as in the reference).

    The pairs of a list of up to ``SMALL`` items are formed and summed where its items lie, so an item
    moves once. In a longer list no pair is formed. With r the rank of the true score, r_i > r_j holds at exactly one bit
    where the ranks part: above it they agree, i has a 1 and j a 0. So the items are dealt to
    one cell per bit, (bit, higher bits of r), and a cell's pairs are i's against j's without
    any further condition on the true score: over the values p_j and p_i - margin in order,
    running counts and sums of the j's that are larger give each i its total. The work is
    items x bits, and a cell of any size is cut by the ranges of the sorted table."""
    d = df.select(F.col(list_id).alias("_l"), F.col(y_true).cast("double").alias("_t"), F.col(y_pred).cast("double").alias("_p"))
    full = d.filter(F.col("_t").isNotNull() & F.col("_p").isNotNull())

    def by_pairs(own: DataFrame) -> DataFrame:
        """(_l, n_pairs, _sum) of short lists: both sides of the join and its sums stay where the items were dealt."""
        x = own.alias("i").join(own.alias("j"), "_l").where(F.col("i._t") > F.col("j._t"))
        gap = F.lit(float(margin)) - (F.col("i._p") - F.col("j._p"))
        return x.groupBy("_l").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.greatest(gap, F.lit(0.0))).alias("_sum"))

    def totals(own: DataFrame, cut: bool) -> DataFrame:
        if cut:
            return by_bits(own, True)
        own = own.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("_l")))
        short = F.col("_l").isNotNull() & (F.col("_k") <= SMALL)
        return by_pairs(own.where(short).drop("_k")).unionByName(by_bits(own.where(~short).drop("_k"), False))

    def by_bits(own: DataFrame, cut: bool) -> DataFrame:
        r = rank_values(value_counts(own, "_l", "_t"), "_l", "_t", cut=cut)
        x = join_on(own, r.select("_l", "_t", F.col("before").cast("long").alias("_r"), "n"), ["_l", "_t"])
        bits = F.greatest(F.ceil(F.log2(F.col("n").cast("double"))), F.lit(1)).cast("int")
        x = x.select("_l", "_p", "_r", F.explode(F.sequence(F.lit(0), bits - 1)).alias("_bit"))
        one = F.expr("shiftright(_r, _bit)").bitwiseAND(F.lit(1)) == 1
        x = x.select("_l", "_bit", F.expr("shiftright(_r, _bit + 1)").alias("_cell"), "_p", one.alias("_i"))
        v = F.when(F.col("_i"), F.col("_p") - F.lit(float(margin))).otherwise(F.col("_p"))
        cells = x.groupBy("_l", "_bit", "_cell", v.alias("_v")).agg(
            F.sum(F.when(F.col("_i"), 0).otherwise(1)).alias("_nj"), F.sum(F.when(F.col("_i"), 0.0).otherwise(F.col("_p"))).alias("_sj"),
            F.sum(F.when(F.col("_i"), 1).otherwise(0)).alias("_ni"), F.sum(F.when(F.col("_i"), F.col("_p")).otherwise(0.0)).alias("_si"))
        c = running_sums(cells, ["_l", "_bit", "_cell"], "_v", {"_nj": "_bn", "_sj": "_bs"}, cut)
        n_after, s_after = F.col("_bn_all") - F.col("_bn") - F.col("_nj"), F.col("_bs_all") - F.col("_bs") - F.col("_sj")
        got = F.col("_ni") * (n_after * F.lit(float(margin)) + s_after) - F.col("_si") * n_after
        # a pair is met in one cell only, so the cells count the pairs too
        return c.groupBy("_l").agg(F.sum(F.col("_ni") * (F.col("_bn_all"))).alias("n_pairs"), F.sum(got).alias("_sum"))

    out = join_on(d.select("_l").distinct(), per_size(full, "_l", totals), ["_l"], "left")
    n = F.coalesce(F.col("n_pairs"), F.lit(0)).cast("long")
    return out.select(F.col("_l").alias(list_id), n.alias("n_pairs"),
                      F.when(n > 0, F.greatest(F.col("_sum") / n, F.lit(0.0))).otherwise(F.lit(0.0)).alias("loss"))


def loss_by_name(name: str):
    """The loss operator for a name; unknown names raise ValueError."""
    table = {"listmle": listmle_loss, "mse": mse_loss, "pairwise_hinge": pairwise_hinge_loss}
    if name not in table:
        raise ValueError(f"no ranking loss is called {name!r}; there are {', '.join(table)}")
    return table[name]


def mean_over_lists(per_list: DataFrame, name: str) -> DataFrame:
    """Batch mean of per-list losses -> one row (loss_name, value, n_lists)."""
    return per_list.agg(F.lit(name).alias("loss_name"), F.avg("loss").alias("value"),
                        F.count(F.lit(1)).alias("n_lists"))


def split_sizes(variants: DataFrame, dataset: str, list_size: int = 32, assay: str = "dms_id") -> DataFrame:
    """Per dataset the number of assays and variants and the steps per epoch
    max(1, total_variants div list_size)."""
    return variants.groupBy(dataset).agg(
        F.countDistinct(assay).alias("n_assays"), F.count(F.lit(1)).alias("total_variants")) \
        .withColumn("steps_per_epoch", F.greatest(F.lit(1), F.floor(F.col("total_variants") / list_size)).cast("long"))


def _md5_num(*parts: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def ranking_list_plan(variants: DataFrame, steps: DataFrame, assay: str, item: Sequence[str],
                      list_size: int = 32, seed: int = 42, epoch: int = 0) -> DataFrame:
    """The ranking lists of one epoch of training steps, without steps x assay rows.

    Step s picks assay number md5(seed, s) mod A (assays numbered by id). Each assay's
    items are permuted by md5(seed, epoch, assay, item) and cut into consecutive
    lists of ``list_size``; the k-th step that picks an assay gets its list
    k mod n_lists (every list of an assay is used before one repeats; an assay
    with at most ``list_size`` items is used whole). Positions are exact, by ``row_positions``
    (skew-safe, no join back); assays of any type are numbered from a range-sorted table.
    Returns (step, assay, list_no, item...).
    """
    assays = variants.groupBy(assay).agg(F.count(F.lit(1)).alias("n_items"))
    assays = written(sorted_sums(assays.withColumn("_1", F.lit(1).cast("long")), [], [F.col(assay).asc_nulls_last()], {"_1": "a_idx"})
                     .select(assay, "n_items", "a_idx", F.col("a_idx_all").alias("n_assays")), "assays")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("step").cast("string"))), 1, 7), 16, 10).cast("long")
    st = steps.select("step", F.pmod(drawn, assays.agg(F.max("n_assays")).scalar()).alias("a_idx"))
    st = row_positions(st.join(assays.select(assay, "a_idx", "n_items"), "a_idx"), assay, "step", [], "k")
    st = st.withColumn("list_no", F.pmod(F.col("k") - 1, F.ceil(F.col("n_items") / F.lit(list_size)).cast("long")))
    perm = variants.select(assay, *item).withColumn(
        "_h", _md5_num(F.lit(seed), F.lit(epoch), F.col(assay), *[F.col(c) for c in item]))
    items = row_positions(perm, assay, "_h", item, "pos") \
        .withColumn("list_no", F.floor((F.col("pos") - 1) / list_size).cast("long"))
    return st.select("step", assay, "list_no").join(items.select(assay, "list_no", *item), [assay, "list_no"])
