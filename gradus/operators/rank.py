"""Per-group ranking metrics.

All metrics are computed from pre-aggregated value-count tables and exact rank
offsets (``gradus.functions.ranking``), so no operator needs a whole group in one
task; per-group results are joined on the group key (one small row per group,
which AQE broadcasts when its measured size allows).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions import ranking
from gradus.functions.ranking import _cols, discount_sum_rows, join_on, mid_rank, per_size, rank_values, ranked_rows, value_counts
from gradus.sources.scratch import written

PROPERTIES = ("stability", "binding", "expression", "activity")


# ---------------------------------------------------------------- W1 / W2
def avg_rank(df: DataFrame, group: str | Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average (fractional) rank of ``value`` inside each group; ties share the
    mean of their positions; NULL values get a NULL rank. In groups larger than a task the ranks
    of the distinct values are joined back on (group, value); AQE splits a hot key of the rows."""
    g = _cols(group)

    def ranks(d: DataFrame, cut: bool) -> DataFrame:
        if not cut:  # NULL values are the last, so they don't move the others
            return ranked_rows(d, g, value, [], "_r", cut=False).withColumn(out, F.when(F.col(value).isNotNull(), mid_rank("_r"))) \
                .drop("_r_pos", "_r_start", "_r_cnt", "n")
        r = rank_values(value_counts(d.filter(F.col(value).isNotNull()), g, value), g, value, cut=True) \
            .select(*g, value, F.col("avg_rank").alias(out))
        return join_on(d, r, [*g, value], "left")

    return per_size(df, g, ranks)


def normalize_scores(df: DataFrame, group: str | Sequence[str], score: str, method: str = "minmax",
                     out: str = "score_norm") -> DataFrame:
    """Per-group min-max / z-score / rank normalisation.

    min-max: (s-min)/(max-min), 0.5 when max-min < 1e-8; z-score: population std,
    0 when std < 1e-8; rank: average rank / n. Group statistics are aggregated
    (partial aggregation, skew-safe) and joined back, not windowed.
    """
    g = _cols(group)
    s = F.col(score).cast("double")
    if method == "minmax":
        st = df.groupBy(*g).agg(F.min(s).alias("_mn"), F.max(s).alias("_mx"))
        rng = F.col("_mx") - F.col("_mn")
        val = F.when(rng < 1e-8, F.lit(0.5)).otherwise((s - F.col("_mn")) / rng)
        return join_on(df, st, g, "left").withColumn(out, F.when(s.isNotNull(), val)).drop("_mn", "_mx")
    if method == "zscore":
        st = df.groupBy(*g).agg(F.avg(s).alias("_mu"), F.stddev_pop(s).alias("_sd"))
        val = F.when(F.col("_sd") < 1e-8, F.lit(0.0)).otherwise((s - F.col("_mu")) / F.col("_sd"))
        return join_on(df, st, g, "left").withColumn(out, F.when(s.isNotNull(), val)).drop("_mu", "_sd")
    if method == "rank":
        n = df.groupBy(*g).agg(F.count(score).alias("_n"))
        return join_on(avg_rank(df, g, score, "_ar"), n, g, "left").withColumn(out, F.col("_ar") / F.col("_n")).drop("_ar", "_n")
    raise ValueError(f"no normalisation is called {method!r}")


# ---------------------------------------------------------------- A2
def spearman_by_group(df: DataFrame, group: str | Sequence[str], y: str, p: str,
                      out: str = "spearman") -> DataFrame:
    """A2: Spearman rho per group = Pearson correlation of average ranks.

    n < 2 -> NULL; a constant side -> 0.0 (the evaluation convention). Rows with
    a NULL on either side are ignored. Returns (group..., n_variants, spearman).
    Rows are ranked by one side, then by the other, without a join; in groups larger than a task equal pairs are counted first."""
    g = _cols(group)
    return _spearman(_ranked_pairs(df, g, y, p), g, out, "_c")


def _ranked_pairs(df: DataFrame, g: list[str], y: str, p: str) -> DataFrame:
    """(group, y, p, _c: how many rows) with the ranks of both sides."""
    def both(d: DataFrame, cut: bool) -> DataFrame:
        x = d.groupBy(*g, y, p).agg(F.count(F.lit(1)).alias("_c")) if cut else d.withColumn("_c", F.lit(1).cast("long"))
        return ranked_rows(ranked_rows(x, g, y, [p], "_y", "_c", cut=cut), g, p, [y], "_p", "_c", cut=cut)

    return per_size(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*dict.fromkeys([*g, y, p])), g, both)


def spearman_by_model(df: DataFrame, group: str | Sequence[str], y: str, models: Column, columns: Sequence[str],
                      out: str = "spearman") -> DataFrame:
    """A2 for several predictions of the same items, one row an item: (labels..., group..., n_variants, spearman).

    ``models`` is an array of structs (labels..., pred) made of ``columns``. The measured value is ranked
    once a group, before the rows are multiplied by the models; the models then stay in the partitions
    of their group, so only the items are moved, dealt so that a task makes about ``TASK_ROWS`` rows of them
    (their own size wouldn't tell Spark what they grow to). In a group where a model lacks a prediction the rows of
    a model differ: such groups alone are ranked a model at a time. Rows without ``y`` are ignored."""
    g = _cols(group)
    gap = F.exists(models, lambda m: m["pred"].isNull())
    labels = [f.name for f in df.select(models.alias("_m")).schema["_m"].dataType.elementType.fields if f.name != "pred"]
    lg = [*labels, *g]

    def of_models(x: DataFrame, *kept: str) -> DataFrame:
        return x.select(*g, y, *kept, F.explode(models).alias("_m")) \
            .select(*[F.col(f"_m.{c}").alias(c) for c in labels], *g, y, *kept, F.col("_m.pred").alias("_pred"))

    def ranks(x: DataFrame, cut: bool, made: int) -> DataFrame:
        if cut:
            gaps = x.where(gap).select(*g).distinct()
            whole, some = join_on(x, gaps, g, "left_anti"), join_on(x, gaps, g, "left_semi")
        else:
            if made > ranking.TASK_ROWS:
                x = x.repartition(-(-made // ranking.TASK_ROWS), *g)
            x = x.withColumn("_gap", F.max(gap).over(Window.partitionBy(*g)))
            whole, some = x.where(~F.col("_gap")), x.where("_gap")
        ties = [c for c in columns if c not in g and c != y]
        a = of_models(ranked_rows(whole, g, y, ties, "_y", cut=cut), "_y_start", "_y_cnt")
        b = ranked_rows(of_models(some).where("_pred is not null"), lg, y, ["_pred"], "_y", cut=cut)
        both = [ranked_rows(z.select(*lg, y, "_pred", "_y_start", "_y_cnt"), lg, "_pred", [y], "_p", cut=cut) for z in (a, b)]
        return both[0].unionByName(both[1])

    rows = df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*g, y, *columns]))
    return _spearman(per_size(rows, g, ranks, F.size(models)), lg, out, None)


def _spearman(x: DataFrame, g: list[str], out: str, weight: str | None, *extra: F.Column) -> DataFrame:
    m = (F.col("n") + 1) / F.lit(2.0)
    dy, dp = mid_rank("_y") - m, mid_rank("_p") - m
    c = F.lit(1) if weight is None else F.col(weight)
    a = x.groupBy(*g).agg(F.max("n").alias("n_variants"), F.sum(c * dy * dp).alias("_sxy"),
                          F.sum(c * dy * dy).alias("_sxx"), F.sum(c * dp * dp).alias("_syy"), *extra)
    rho = (F.when(F.col("n_variants") < 2, F.lit(None).cast("double"))
           .when((F.col("_sxx") > 0) & (F.col("_syy") > 0), F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy")))
           .otherwise(F.lit(0.0)))
    return a.withColumn(out, rho).drop("_sxy", "_sxx", "_syy")


def spearman_pvalue(res: DataFrame, rho: str = "spearman", n: str = "n_variants",
                    out: str = "spearman_pval") -> DataFrame:
    """A2p: two-sided p-value of rho with a t distribution of n-2 degrees of freedom,
    on the one-row-per-group result. Undefined -> 1.0, n < 2 -> NULL.
    Vectorised over Arrow batches (regularised incomplete beta by continued fraction)."""
    @F.pandas_udf("double")
    def pval(r: pd.Series, nn: pd.Series) -> pd.Series:
        import numpy as np

        from gradus.functions.special import t_two_sided_p
        r = r.astype("float64").to_numpy()
        nn = nn.astype("float64").to_numpy()
        outv = np.full(len(r), np.nan)
        ok = nn >= 2
        outv[ok] = t_two_sided_p(r[ok], nn[ok])
        outv[ok & ~np.isfinite(outv)] = 1.0
        return pd.Series(np.where(ok, outv, np.nan))

    return res.withColumn(out, F.when(F.col(n) >= 2, pval(F.col(rho), F.col(n))))


# ---------------------------------------------------------------- A3
def _k_col(n: F.Column, k_fraction: float) -> F.Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(k_fraction)))).cast("long")


def ndcg_by_group(df: DataFrame, group: str | Sequence[str], y: str, p: str,
                  k_fraction: float = 0.1) -> DataFrame:
    """A3: NDCG with linear gain and log2 discount, prediction ties averaged,
    full list (``ndcg``) and cut at k = max(1, int(n*k_fraction)) (``ndcg_10``).
    NULL when n < 2 or a relevance is negative; 0 when the ideal gain is 0."""
    g = _cols(group)
    x = written(_ranked_pairs(df, g, y, p), "ranks")
    for name in ("_y", "_p"):  # the same tie blocks from the other end
        x = x.withColumn(f"{name}_start", F.col("n") - F.col(f"{name}_start") - F.col(f"{name}_cnt"))
    return _ndcg(x.withColumn("_gain", F.col(y) * F.col("_c")), g, y, k_fraction)


def _ndcg(x: DataFrame, g: list[str], y: str, k_fraction: float) -> DataFrame:
    """From rows ranked in descending order on both sides; ``_gain`` is a row's relevance."""
    def gains(name: str, gain: F.Column, *extra: F.Column) -> DataFrame:
        # prediction-order tie blocks carry the sum of their relevance
        b = x.groupBy(*g, f"{name}_start", f"{name}_cnt", "n").agg(gain.alias("_sum"), *extra)
        b = b.withColumn("_k", _k_col(F.col("n"), k_fraction))
        return discount_sum_rows(b, f"{name}_start", f"{name}_cnt", {"_d": None, "_dk": "_k"})

    dcg = gains("_p", F.sum("_gain")).groupBy(*g).agg(F.sum(F.col("_sum") / F.col("_p_cnt") * F.col("_d")).alias("_dcg"),
                                                      F.sum(F.col("_sum") / F.col("_p_cnt") * F.col("_dk")).alias("_dcgk"))
    idcg = gains("_y", F.first(y)).groupBy(*g).agg(F.sum(F.col("_sum") * F.col("_d")).alias("_idcg"),
                                                   F.sum(F.col("_sum") * F.col("_dk")).alias("_idcgk"),
                                                   F.max("n").alias("_n"), F.min("_sum").alias("_miny"))
    j = join_on(idcg, dcg, g, "left")
    bad = (F.col("_n") < 2) | (F.col("_miny") < 0)

    def ratio(num: str, den: str) -> F.Column:
        return (F.when(bad, F.lit(None).cast("double"))
                .when(F.col(den) == 0, F.lit(0.0)).otherwise(F.col(num) / F.col(den)))

    return j.select(*g, ratio("_dcg", "_idcg").alias("ndcg"), ratio("_dcgk", "_idcgk").alias("ndcg_10"))


# ---------------------------------------------------------------- A4 / O2
def topk_recall(df: DataFrame, group: str | Sequence[str], y: str, p: str, key: Sequence[str],
                k_fraction: float = 0.1) -> DataFrame:
    """A4: |true top-k ∩ predicted top-k| / k, k = max(1, int(n*k_fraction)).
    Ties are broken by ``key`` ascending (deterministic); ``key`` identifies a row.
    Rows get their position in one order, then in the other; no join."""
    g = _cols(group)
    a = _ranked_both(df, g, y, p, key).groupBy(*g).agg(*_top_counts(k_fraction))
    return a.select(*g, _recall())


def _ranked_both(df: DataFrame, g: list[str], y: str, p: str, key: Sequence[str]) -> DataFrame:
    """The rows with both values, ranked in descending order on both sides."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*dict.fromkeys([*g, y, p, *key]))
    ties = [c for c in key if c not in g]
    return per_size(d, g, lambda x, cut: ranked_rows(ranked_rows(x, g, y, ties, "_y", descending=True, cut=cut), g, p, ties, "_p",
                                                     descending=True, cut=cut))


def _top_counts(k_fraction: float) -> list[F.Column]:
    k = _k_col(F.col("n"), k_fraction)
    both = (F.col("_y_pos") < k) & (F.col("_p_pos") < k)
    return [F.max(k).alias("_k"), F.sum(F.when(both, 1).otherwise(0)).alias("_h")]


def _recall() -> F.Column:
    return (F.col("_h") / F.col("_k")).alias("top_10_recall")


def topk_items(df: DataFrame, group: str | Sequence[str], score: str, key: Sequence[str],
               k: int = 10) -> DataFrame:
    """O2: the k highest-scoring rows per group (ties by ``key``); ``row_number() <= k``
    becomes a partial top-k before the shuffle (WindowGroupLimit)."""
    g = _cols(group)
    w = Window.partitionBy(*g).orderBy(F.col(score).desc(), *key)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


# ---------------------------------------------------------------- A5
def auc_by_group(df: DataFrame, group: str | Sequence[str], label: str, score: str,
                 out: str = "auc") -> DataFrame:
    """A5: ROC-AUC per group by the Mann-Whitney statistic with average ranks.
    Defined only when the 0/1 label takes both values in the group, else NULL."""
    g = _cols(group)
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = [F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
              F.sum(F.when(~F.col(label).isin(0, 1), 1).otherwise(0)).alias("_oth")]
    r = per_size(d, g, lambda x, cut: rank_values(value_counts(x, g, score, *counts), g, score, cut=cut))
    a = r.groupBy(*g).agg(F.sum("_pos").alias("_p"), F.max("n").alias("_n"),
                          F.sum("_oth").alias("_o"),
                          F.sum(F.col("_pos") * F.col("avg_rank")).alias("_sr"))
    neg = F.col("_n") - F.col("_p")
    auc = (F.col("_sr") - F.col("_p") * (F.col("_p") + 1) / F.lit(2.0)) / (F.col("_p") * neg)
    ok = (F.col("_p") > 0) & (neg > 0) & (F.col("_o") == 0)
    return a.select(*g, F.when(ok, auc).alias(out))


# ---------------------------------------------------------------- A1
def assay_metrics(df: DataFrame, group: str | Sequence[str], y: str, p: str, label: str | None,
                  key: Sequence[str], k_fraction: float = 0.1) -> DataFrame:
    """A1: every ranking metric per group, one row per group: A2 with its p-value, A3, A4 and A5.
    Rows are ranked once in each order; the ranked rows are written and shared by the metrics."""
    g = _cols(group)
    x = written(_ranked_both(df, g, y, p, key), "ranks")
    out = _spearman(x, g, "spearman", None, *_top_counts(k_fraction))
    out = spearman_pvalue(out).select(*g, "n_variants", "spearman", "spearman_pval", _recall())
    out = join_on(out, _ndcg(x.withColumn("_gain", F.col(y)), g, y, k_fraction), g, "left")
    out = out.select(*g, "n_variants", "spearman", "spearman_pval", "ndcg", "ndcg_10", "top_10_recall")
    if label is None:
        return out.withColumn("auc", F.lit(None).cast("double"))
    return join_on(out, auc_by_group(df, g, label, p), g, "left")


# ---------------------------------------------------------------- A6 / A7
def cross_property_matrix(pred: DataFrame, categories: Sequence[str], model: str = "model",
                          group: str = "dms_id", category: str = "category", y: str = "y",
                          p: str = "pred") -> DataFrame:
    """Mean per-assay Spearman for every model (rows) x category (columns).
    NULL Spearman values are skipped by the mean; the columns come from the given
    category list, so no extra job discovers them."""
    return _matrix(spearman_by_group(pred, [model, group, category], y, p), categories, model, category)


def cross_property_matrix_shared(items: DataFrame, categories: Sequence[str], models: Column, columns: Sequence[str],
                                 model: str = "model", group: str = "dms_id", category: str = "category",
                                 y: str = "y") -> DataFrame:
    """A6 from one row an item and an array of its predictions (``spearman_by_model``): the measured
    value is ranked once for all models."""
    return _matrix(spearman_by_model(items, [group, category], y, models, columns), categories, model, category)


def _matrix(sp: DataFrame, categories: Sequence[str], model: str, category: str) -> DataFrame:
    # the pivot as conditional averages over the given categories: one partial
    # aggregation and one exchange (a pivot() would add a second aggregation step)
    return sp.groupBy(model).agg(*[F.avg(F.when(F.col(category) == c, F.col("spearman"))).alias(c.lower())
                                   for c in categories])


def category_summary(decisions: DataFrame, categories: Sequence[str], min_assays: int = 8,
                     category: str = "assigned_category") -> DataFrame:
    """Assays per category (zero for empty ones), warning below ``min_assays``,
    and the confidence histogram."""
    spark = decisions.sparkSession
    cats = spark.createDataFrame([(c, i) for i, c in enumerate(categories)],
                                 "category string, priority int")
    counts = decisions.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n_assays"),
        F.sum(F.when(F.col("confidence") == "high", 1).otherwise(0)).cast("long").alias("n_high"),
        F.sum(F.when(F.col("confidence") == "medium", 1).otherwise(0)).cast("long").alias("n_medium"),
        F.sum(F.when(F.col("confidence") == "low", 1).otherwise(0)).cast("long").alias("n_low"))
    j = F.broadcast(cats).join(counts, "category", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("category", z("n_assays"), (F.coalesce(F.col("n_assays"), F.lit(0)) < min_assays)
                    .alias("below_min"), z("n_high"), z("n_medium"), z("n_low"))
