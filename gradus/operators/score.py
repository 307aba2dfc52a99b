"""Zero-shot scoring and pooling.

Scores are a join of parsed mutations against a log-probability table keyed by
position (one row per position holding the whole token vector), so each
mutation needs one equi-join and two array lookups; the table is small per
protein and AQE broadcasts it when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import parsing
from gradus.functions.ranking import join_on
from gradus.operators.rank import spearman_by_group
from gradus.sources.scratch import written

# Fixed value: token alphabet of the log-prob table (index = position in this string), also used by
# the harness views to make mutation tokens
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def log_softmax(vec: Column) -> Column:
    """P9 (array form): log-probabilities of a logit vector, max-shifted for stability.
    Per-row scalars (max, log-sum-exp) are spread with ``array_repeat`` and zipped,
    so no lambda re-evaluates them per element."""
    v = F.transform(vec, lambda x: x.cast("double"))
    n = F.size(vec)
    zm = F.arrays_zip(v.alias("x"), F.array_repeat(F.array_max(v), n).alias("m"))
    lse = F.aggregate(zm, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m")),
                      lambda acc, e: F.struct((acc["s"] + F.exp(e["x"] - e["m"])).alias("s"), e["m"].alias("m")),
                      lambda acc: acc["m"] + F.log(acc["s"]))
    zl = F.arrays_zip(v.alias("x"), F.array_repeat(lse, n).alias("l"))
    return F.transform(zl, lambda e: e["x"] - e["l"])


def token_index(letter: Column, alphabet: str = AMINO) -> Column:
    """0-based index of a one-letter token in the alphabet, -1 when unknown."""
    return F.when(F.length(letter) == 1, F.instr(F.lit(alphabet), letter) - 1).otherwise(F.lit(-1))


def score_lookup(terms: DataFrame, logp: DataFrame, pos: str = "pos", key: Sequence[str] = ()) -> DataFrame:
    """Attach log-probabilities of the wild-type and mutant tokens to each mutation
    term (left join on position [+ protein key]); missing positions and unknown letters give
    NULLs, which add 0 to a score."""
    on = list(key) + [pos]
    return terms.join(logp, on, "left") \
        .withColumn("lp_wt", element_or_null(F.col("logp"), token_index(F.col("wt")))) \
        .withColumn("lp_mut", element_or_null(F.col("logp"), token_index(F.col("mut")))) \
        .drop("logp")


def element_or_null(arr: Column, idx0: Column) -> Column:
    return F.when((idx0 >= 0) & (idx0 < F.size(arr)), F.element_at(arr, idx0 + 1))


def used_positions(logp: DataFrame, terms: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of the table that some term looks up, written: Spark knows what is left and broadcasts it
    where it is small, so that the terms of a few positions aren't dealt by position."""
    return written(logp.join(terms.select(*on).distinct(), list(on), "left_semi"), "logp")


def zero_shot_score(mutants: DataFrame, logp: DataFrame, item: str = "item", mutant: str = "mutant",
                    pos_col: str = "pos", logp_col: str = "logp", key: Sequence[str] = ()) -> DataFrame:
    """score = sum over the mutations of logp[pos, mut] - logp[pos, wt].

    No mutations -> 0.0; a position outside the table or an unknown letter adds 0
    and is counted in ``n_skipped``. ``logp`` has one row per (key..., position) with
    the log-probability vector. Returns (key..., item, zero_shot_score, n_mutations, n_skipped).
    """
    k = list(key)
    parsed = written(mutants.select(*k, item, parsing.parse_mutations(F.col(mutant)).alias("ts")), "mutations")
    logp = used_positions(logp, parsed.select(*k, F.explode("ts.pos").alias(pos_col)), k + [pos_col])
    terms = parsed.select(*k, item, F.explode_outer("ts").alias("t")) \
                   .select(*k, item, F.col("t.wt").alias("wt"), F.col("t.pos").alias(pos_col),
                           F.col("t.mut").alias("mut"))
    table = logp.select(*k, F.col(pos_col), F.col(logp_col).alias("_lp"))
    j = terms.join(table, k + [pos_col], "left")
    d = element_or_null(F.col("_lp"), token_index(F.col("mut"))) - \
        element_or_null(F.col("_lp"), token_index(F.col("wt")))
    return j.groupBy(*k, item).agg(
        F.coalesce(F.sum(F.coalesce(d, F.lit(0.0))), F.lit(0.0)).alias("zero_shot_score"),
        F.count(F.col(pos_col)).alias("n_mutations"),
        F.sum(F.when(F.col(pos_col).isNotNull() & d.isNull(), 1).otherwise(0)).cast("long").alias("n_skipped"))


def zero_shot_summary(scored: DataFrame, group: str, y: str, score: str = "zero_shot_score") -> DataFrame:
    """Per assay Spearman of the zero-shot score against the measured score."""
    return spearman_by_group(scored, group, y, score)


def remaining_work(expected: DataFrame, done: DataFrame, key: str, total: str) -> DataFrame:
    """Per assay the rows still to score: total - rows already done (left join of
    done counts); finished assays are skipped. ``done`` holds one row per finished row."""
    dc = done.groupBy(key).agg(F.count(F.lit(1)).alias("done"))
    x = expected.join(dc, key, "left").withColumn("done", F.coalesce(F.col("done"), F.lit(0)).cast("long"))
    x = x.withColumn("remaining", F.greatest(F.lit(0), F.col(total) - F.col("done")).cast("long"))
    return x.filter(F.col("remaining") > 0)


def smallest_remaining_first(pending: DataFrame, key: str, n: int = 5) -> DataFrame:
    """O1: the ``n`` pending assays with least remaining work (ties by key)."""
    return pending.orderBy(F.col("remaining").asc(), F.col(key).asc()).limit(n)


def zero_shot_attach(rows: DataFrame, scores: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Evaluation rows joined to stored scores; rows of unscored assays drop out."""
    return rows.join(scores, on, "inner")


# ---------------------------------------------------------------- P12 pooling
def mean_pool(vecs: DataFrame, group: str, order: str, idx: str = "idx", v: str = "v",
              mask: str | None = None) -> DataFrame:
    """Mean of the token vectors of each group, leaving out the first position
    (lowest ``order``, masked or not) and masked rows; the denominator is floored at 1e-8.
    A group without any such position gives 0. The first position is one small row per group."""
    first = vecs.groupBy(group).agg(F.min(order).alias("_first"))
    x = join_on(vecs, first, [group])
    use = F.col(order) > F.col("_first")
    if mask is not None:
        use = use & (F.col(mask) == 1)
    a = x.groupBy(group, idx).agg(F.sum(F.when(use, F.col(v)).otherwise(0.0)).alias("_s"),
                                  F.sum(F.when(use, 1).otherwise(0)).alias("_n"))
    return a.select(group, idx, (F.col("_s") / F.greatest(F.col("_n"), F.lit(1e-8))).alias(v))


def cls_pool(vecs: DataFrame, group: str, order: str, idx: str = "idx", v: str = "v") -> DataFrame:
    """The vector at the first position of each group."""
    return vecs.groupBy(group, idx).agg(F.min_by(v, order).alias(v))


# ---------------------------------------------------------------- P11 head
def head_weights(dim: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Deterministic small ranking-head weights from a rule (for scoring tests and
    the harness binding); real weights are passed in the same layout."""
    i = np.arange(dim)[:, None]
    j = np.arange(hidden)[None, :]
    w1 = np.sin((i + 1) * (j + seed) * 0.37) / np.sqrt(dim)
    b1 = np.cos(np.arange(hidden) * 0.11) * 0.01
    gamma = 1.0 + 0.1 * np.sin(np.arange(hidden))
    beta = 0.05 * np.cos(np.arange(hidden))
    w2 = np.cos((np.arange(hidden) + seed) * 0.53)[:, None] / np.sqrt(hidden)
    b2 = np.array([0.1])
    return {"w1": w1, "b1": b1, "gamma": gamma, "beta": beta, "w2": w2, "b2": b2}


# The rational approximation 7.1.26 of Abramowitz and Stegun for erf (error below 1.5e-7)
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: np.ndarray) -> np.ndarray:
    t = 1.0 / (1.0 + ERF_P * np.abs(x))
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / np.sqrt(2.0)))


def head_forward(x: np.ndarray, w: dict[str, np.ndarray], eps: float = 1e-5) -> np.ndarray:
    """dense -> GELU (erf) -> layer norm -> dense, dropout off (inference)."""
    h = _gelu(x @ w["w1"] + w["b1"])
    mu = h.mean(axis=1, keepdims=True)
    var = h.var(axis=1, keepdims=True)
    h = (h - mu) / np.sqrt(var + eps) * w["gamma"] + w["beta"]
    return (h @ w["w2"] + w["b2"])[:, 0]


def head_score(df: DataFrame, vec: str, id_col: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """Batch scoring of pooled vectors with a broadcast ranking head; one numpy
    matmul per Arrow batch (mapInPandas). Returns (id, score)."""
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast({k: np.asarray(v, dtype="float64") for k, v in weights.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = bw.value
        for b in batches:
            if len(b) == 0:
                continue
            x = np.stack([np.asarray(v, dtype="float64") for v in b[vec]])
            yield pd.DataFrame({id_col: b[id_col].to_numpy(), "score": head_forward(x, w)})

    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double"
    return df.select(id_col, vec).mapInPandas(run, schema)


def logp_table(vectors: DataFrame, pos: str, vec: str) -> DataFrame:
    """P9 applied to a (position, logits) table -> (position, logp ARRAY<DOUBLE>)."""
    return vectors.select(F.col(pos).alias("pos"), log_softmax(F.col(vec)).alias("logp"))


__all__ = ["log_softmax", "score_lookup", "zero_shot_score", "zero_shot_summary", "remaining_work",
           "smallest_remaining_first", "zero_shot_attach", "mean_pool", "cls_pool", "head_score",
           "logp_table"]
