"""Weight-vector algebra (V1-V13, J9, J10, A12) on long and row-blocked tables.

Long form: (property, [prefix, matrix,] r, c, v) — one row per element.
Low-rank products are never formed by an element-level triple join: the
factored Gram identities give norms and inner products of B@A from r x r
Gram matrices (V5, V7); when the product itself is needed (V3, V4), each B row
meets its A factor as one row block (an r x in matrix, bounded by the rank).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradus.functions.ranking import join_on, rank_values
from gradus.sources.scratch import written

EPS = 1e-8


# ---------------------------------------------------------------- V1 / V2
def task_vector(finetuned: DataFrame, base: DataFrame, key: Sequence[str], v: str = "v",
                name: str | None = None, keep: str = "lora_") -> DataFrame:
    """V1: fine-tuned minus base per element (inner join on the element key); with a
    ``name`` column, only parameters whose name contains ``keep`` (adapter form)."""
    k = list(key)
    f = finetuned if name is None else finetuned.filter(F.col(name).contains(keep))
    b = base.select(*k, F.col(v).alias("_b"))
    return f.join(b, k).withColumn(v, F.col(v) - F.col("_b")).drop("_b")


def vector_summary(vecs: DataFrame, group: str = "property", v: str = "v", layer: str | None = None) -> DataFrame:
    """V2: per vector the parameter count, L2 norm and (optionally) layer count."""
    aggs = [F.count(F.lit(1)).alias("n_params"), F.sqrt(F.sum(F.col(v) * F.col(v))).alias("l2_norm")]
    if layer:
        aggs.append(F.countDistinct(layer).alias("n_layers"))
    return vecs.groupBy(group).agg(*aggs)


# Fixed value: adapter tensor names end in ".lora_A[.<adapter>].weight" / ".lora_B[...]"
LORA_NAME = r"^(.*)\.lora_([AB])(\.[A-Za-z0-9_]+)?\.weight$"


def lora_parts(name: str = "name") -> tuple[F.Column, F.Column]:
    """(prefix, matrix) of an adapter tensor name, with or without the adapter segment
    (``.default``); both NULL for other names, so they never pair up by accident."""
    pre = F.regexp_extract(F.col(name), LORA_NAME, 1)
    mat = F.regexp_extract(F.col(name), LORA_NAME, 2)
    return F.when(mat != "", pre), F.when(mat != "", mat)


# ---------------------------------------------------------------- row blocks
def to_row_blocks(long: DataFrame, key: Sequence[str], row: str = "r", col: str = "c", v: str = "v") -> DataFrame:
    """(key..., r, c, v) -> (key..., r, vals ARRAY<DOUBLE>) ordered by c. A block is one
    matrix row (its length is the matrix width)."""
    k = list(key)
    return long.groupBy(*k, row).agg(F.array_sort(F.collect_list(F.struct(F.col(col), F.col(v)))).alias("_cv")) \
        .select(*k, row, F.transform("_cv", lambda s: s[v]).alias("vals"))


def weights_pair(lowrank: DataFrame, key: Sequence[str] = ("property", "prefix")) -> DataFrame:
    """A and B factors of the same (property, prefix): ``complete``, ``missing_A``
    or ``missing_B`` (full outer join of the two factor sets)."""
    k = list(key)
    a = lowrank.filter(F.col("matrix") == "A").select(*k).distinct().withColumn("_a", F.lit(True))
    b = lowrank.filter(F.col("matrix") == "B").select(*k).distinct().withColumn("_b", F.lit(True))
    j = a.join(b, k, "full")
    st = F.when(F.col("_a") & F.col("_b"), "complete").when(F.col("_a"), "missing_B").otherwise("missing_A")
    return j.select(*k, st.alias("status"))


def materialize_delta(lowrank: DataFrame, scale: float = 1.0, key: Sequence[str] = ("property", "prefix")) -> DataFrame:
    """V3: delta = scale * B @ A per (property, prefix) with complete pairs, as row blocks
    (key..., r, vals). Each B row is joined with its A factor (r x in, one row per key)."""
    k = list(key)
    a_rows = to_row_blocks(lowrank.filter(F.col("matrix") == "A"), k)
    a_mat = a_rows.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("r", "vals"))).alias("_am")) \
        .select(*k, F.transform("_am", lambda s: s["vals"]).alias("amat"))
    b_rows = to_row_blocks(lowrank.filter(F.col("matrix") == "B"), k)
    j = b_rows.join(a_mat, k)
    width = F.size(F.element_at("amat", 1))
    zipped = F.arrays_zip(F.col("vals").alias("b"), F.col("amat").alias("a"))
    # out[j] = sum_k b[k] * A[k][j]: fold the rank dimension over whole A rows
    prod = F.aggregate(zipped, F.array_repeat(F.lit(0.0), width),
                       lambda acc, e: F.zip_with(acc, e["a"], lambda x, y: x + e["b"] * y))
    return j.select(*k, "r", F.transform(prod, lambda x: x * F.lit(float(scale))).alias("vals"))


def explode_blocks(blocks: DataFrame, key: Sequence[str], row: str = "r") -> DataFrame:
    """Row blocks -> long (key..., r, c, v)."""
    return blocks.select(*key, row, F.posexplode("vals").alias("c", "v"))


def compose(lowrank: DataFrame, coefficients: Mapping, scale: float = 1.0, first_property=None,
            prop: str = "property") -> DataFrame:
    """V4: sum_p alpha_p * (B_p @ A_p) per prefix (negative alpha = negation).
    Prefixes come from the first property (smallest id unless given); a property
    missing a prefix is skipped there; a property without a coefficient is an error
    (checked with one scalar action)."""
    spark = lowrank.sparkSession
    coef = spark.createDataFrame([(k, float(v)) for k, v in coefficients.items()],
                                 f"{prop} {lowrank.schema[prop].dataType.simpleString()}, alpha double")
    missing = lowrank.select(prop).distinct().join(coef, prop, "left_anti").limit(1).count()
    if missing:
        raise ValueError("missing scaling coefficient for a property")
    delta = materialize_delta(lowrank, scale, [prop, "prefix"])
    if first_property is None:
        first = lowrank.agg(F.min(prop).alias(prop))
    else:
        first = spark.createDataFrame([(first_property,)], f"{prop} {lowrank.schema[prop].dataType.simpleString()}")
    prefixes = lowrank.join(F.broadcast(first), prop).select("prefix").distinct()
    d = delta.join(F.broadcast(coef), prop).join(prefixes, "prefix", "left_semi")
    # a matrix row of every property (as many as coefficients at most) is added up as blocks
    rows = d.select("prefix", "r", F.transform("vals", lambda x: x * F.col("alpha")).alias("vals")) \
        .groupBy("prefix", "r").agg(F.collect_list("vals").alias("_rows"))
    zero = F.lit(0.0)
    total = F.aggregate("_rows", F.array().cast("array<double>"),
                        lambda acc, e: F.zip_with(acc, e, lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero)))
    return explode_blocks(rows.select("prefix", "r", total.alias("vals")), ["prefix"])


# ---------------------------------------------------------------- V5 / V7 factored forms
def _gram_dots(lowrank: DataFrame, key: Sequence[str], prop: str | None = None) -> DataFrame:
    """(key..., p1, p2, dot) of two properties' deltas, p1 <= p2: <B1A1, B2A2> = sum((B1ᵀB2) ∘ (A1A2ᵀ))
    without forming B @ A; without ``prop`` the key's own delta with itself. The factors of a key (a layer)
    move once, as they are, and meet in one group. Complete pairs only: both properties have both factors.
    NULL elements add nothing; a dot of them alone is NULL."""
    k = list(key)
    own = F.lit(0) if prop is None else F.col(prop)
    x = lowrank.where(F.col("matrix").isin("A", "B")).select(*k, own.alias("_p"), (F.col("matrix") == "B").alias("_b"), "r", "c", F.col("v").cast("double").alias("v"))
    x = x.dropna(subset=[*k, "_p", "r", "c"])

    def dots(name: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r, c, is_b = (t[n].to_numpy() for n in ("r", "c", "_b"))
        held = ~t["v"].is_null().to_numpy()
        v = np.where(held, t["v"].to_numpy(), 0.0)
        props, p = np.unique(t["_p"].to_numpy(), return_inverse=True)
        ranks, rank = np.unique(np.where(is_b, c, r), return_inverse=True)
        along = np.where(is_b, r, c)
        sides = []
        for m in (is_b, ~is_b):
            rows, at = np.unique(along[m], return_inverse=True)
            where, shape = (p[m], at, rank[m]), (len(props), len(rows), len(ranks))
            value, known, there = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
            np.add.at(value, where, v[m])
            np.logical_or.at(known, where, held[m])
            there[where] = True
            sides.append((value, known, there))
        first, second, dot = [], [], []
        for i in range(len(props)):
            for j in range(i, len(props)):
                gram, some, meets = 1.0, True, True
                for value, known, there in sides:
                    both = known[i][:, :, None] & known[j][:, None, :]
                    gram = gram * np.where(both, value[i][:, :, None] * value[j][:, None, :], 0.0).sum(axis=0)
                    some = some & both.any(axis=0)
                    meets = meets & (there[i][:, :, None] & there[j][:, None, :]).any(axis=0)
                if np.any(meets):
                    first.append(i)
                    second.append(j)
                    dot.append(float(gram[some].sum()) if np.any(some) else None)
        kind = t.schema.field("_p").type
        return pa.table([*[pa.array([n.as_py()] * len(dot), n.type) for n in name], pa.array(props[first].tolist(), kind),
                         pa.array(props[second].tolist(), kind), pa.array(dot, pa.float64())], names=[*k, "p1", "p2", "dot"])

    fields = [x.schema[c] for c in k] + [T.StructField(n, x.schema["_p"].dataType) for n in ("p1", "p2")]
    return x.groupBy(*k).applyInArrow(dots, T.StructType([*fields, T.StructField("dot", T.DoubleType())]))


def _norm(dot: Column) -> Column:
    return F.sqrt(F.greatest(dot, F.lit(0.0)))


def delta_norm_factored(lowrank: DataFrame, key: Sequence[str] = ("property", "prefix"), scale: float = 1.0) -> DataFrame:
    """V5: ||scale * B @ A||_F = |scale| * sqrt(sum((BᵀB) ∘ (AAᵀ))) without forming B @ A."""
    return _gram_dots(lowrank, key).select(*key, (F.lit(abs(scale)) * _norm(F.col("dot"))).alias("frob_norm"))


def delta_cosine_factored(lowrank: DataFrame, prop: str = "property", eps: float = EPS) -> DataFrame:
    """V7: cosine between the deltas of two properties over all shared prefixes; pairs p1 <= p2 are
    computed and mirrored."""
    return _cosine_from_dots(_gram_dots(lowrank, ["prefix"], prop).groupBy("p1", "p2").agg(F.sum("dot").alias("dot")), eps)


def _cosine_from_dots(dots: DataFrame, eps: float) -> DataFrame:
    """Cosines from the upper-triangle dot products (p1 <= p2): the norms come from
    the diagonal through two windows over the small dot table (read once), and the
    lower triangle is produced by exploding each off-diagonal row into both orders."""
    diag = F.when(F.col("p1") == F.col("p2"), F.col("dot"))
    x = dots.withColumn("_n1", F.sqrt(F.max(diag).over(Window.partitionBy("p1")))) \
            .withColumn("_n2", F.sqrt(F.max(diag).over(Window.partitionBy("p2"))))
    cos = F.col("dot") / (F.greatest(F.col("_n1"), F.lit(eps)) * F.greatest(F.col("_n2"), F.lit(eps)))
    both = F.when(F.col("p1") == F.col("p2"), F.array(F.struct(F.col("p1").alias("a"), F.col("p2").alias("b")))) \
        .otherwise(F.array(F.struct(F.col("p1").alias("a"), F.col("p2").alias("b")),
                           F.struct(F.col("p2").alias("a"), F.col("p1").alias("b"))))
    return x.select(F.explode(both).alias("_pp"), cos.alias("cosine")) \
        .select(F.col("_pp.a").alias("p1"), F.col("_pp.b").alias("p2"), "cosine")


def cosine_matrix(vecs: DataFrame, prop: str = "property", key: Sequence[str] = ("idx",), v: str = "v",
                  eps: float = EPS) -> DataFrame:
    """V6: N x N cosine similarity of flattened vectors (long form), eps-floored norms;
    only p1 <= p2 is computed (join on the element key), then mirrored."""
    k = list(key)
    x = vecs.select(F.col(prop).alias("p1"), *k, F.col(v).alias("v1"))
    y = vecs.select(F.col(prop).alias("p2"), *k, F.col(v).alias("v2"))
    dots = x.join(y, k).filter(F.col("p1") <= F.col("p2")).groupBy("p1", "p2") \
        .agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))
    return _cosine_from_dots(dots, eps)


# ---------------------------------------------------------------- V12
def layer_profile(lowrank: DataFrame, prop: str = "property", layer: str = "prefix") -> DataFrame:
    """Per layer the number of properties with a delta, the mean and largest norm, and the mean
    cosine between the deltas of two properties (NULL with fewer than two). Norms and inner products
    come from Gram matrices, so no delta is formed."""
    found = written(_gram_dots(lowrank, [layer], prop), "dots")  # norms are the dots of a property with itself
    norms = found.where("p1 = p2").select(F.col("p1").alias(prop), layer, _norm(F.col("dot")).alias("frob_norm"))
    dots = found.where("p1 < p2").withColumnRenamed("dot", "_dot")
    n1 = norms.select(layer, F.col(prop).alias("p1"), F.greatest("frob_norm", F.lit(EPS)).alias("_n1"))
    n2 = norms.select(layer, F.col(prop).alias("p2"), F.greatest("frob_norm", F.lit(EPS)).alias("_n2"))
    cos = dots.join(n1, [layer, "p1"]).join(n2, [layer, "p2"]).groupBy(layer) \
        .agg(F.avg(F.col("_dot") / (F.col("_n1") * F.col("_n2"))).alias("mean_cosine"))
    per = norms.groupBy(layer).agg(F.count(F.lit(1)).alias("n_properties"), F.avg("frob_norm").alias("mean_norm"),
                                   F.max("frob_norm").alias("max_norm"))
    return per.join(cos, layer, "left").select(F.col(layer).alias("layer"), "n_properties", "mean_norm", "max_norm", "mean_cosine")


# ---------------------------------------------------------------- J10
# How adapter prefixes relate to the names of base weights
ADAPTER_HEAD, WEIGHT_TAIL = "base_model.model.", ".weight"


def base_name(prefix: Column) -> Column:
    """``base_model.model.X`` -> ``X.weight``."""
    return F.concat(F.regexp_replace(prefix, "^" + ADAPTER_HEAD.replace(".", r"\."), ""), F.lit(WEIGHT_TAIL))


def weights_apply(base: DataFrame, lowrank: DataFrame, scaling: float = 1.0, prop: str = "property",
                  prefix: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """Base weights (name, r, c, v) + scaling * B @ A, per property, by the rewritten name.

    Returns the new weights (property, name, r, c, v) of every base weight that a property's
    complete factor pair names, and a report (property, name, status): ``missing_A`` /
    ``missing_B`` for incomplete pairs, ``unmatched`` for complete ones without a base weight.
    The base table stays as it is."""
    k = [prop, prefix]
    d = materialize_delta(lowrank, scaling, k) \
        .select(prop, base_name(F.col(prefix)).alias("name"), "r", F.col("vals").alias("_d"))
    # a row of a base matrix meets the same row of the delta as one block
    rows = base.groupBy("name", "r").agg(F.collect_list(F.struct("c", "v")).alias("_cv"))
    inside = F.filter("_cv", lambda e: (e["c"] >= 0) & (e["c"] < F.size("_d")))
    added = F.transform(inside, lambda e: F.struct(e["c"].alias("c"), (e["v"] + F.get("_d", e["c"].cast("int"))).alias("v")))
    new = rows.join(d, ["name", "r"]).select(prop, "name", "r", F.inline(added))
    pairs = weights_pair(lowrank, k).select(prop, base_name(F.col(prefix)).alias("name"), "status")
    names = base.select("name").distinct()
    lost = pairs.where("status = 'complete'").join(names, "name", "left_anti").select(prop, "name", F.lit("unmatched").alias("status"))
    return new, pairs.where("status <> 'complete'").unionByName(lost)


# ---------------------------------------------------------------- V8-V13
def ensemble_predictions(preds: DataFrame, key: Sequence[str], pred: str = "pred", *extra) -> DataFrame:
    """V8: average prediction of several models per item (plus any ``extra`` aggregates)."""
    return preds.groupBy(*key).agg(F.avg(pred).alias(pred), *extra)


def ties_merge(vecs: DataFrame, top_fraction: float = 0.2, prop: str = "property", key: Sequence[str] = ("idx",),
               v: str = "v") -> DataFrame:
    """V9: trim each vector to its top ``top_fraction`` by magnitude (exact skew-safe rank),
    elect the sign of the summed survivors per element, average the agreeing ones."""
    k = list(key)
    x = vecs.withColumn("_a", -F.abs(F.col(v)))
    vc = x.groupBy(prop, "_a").agg(F.count(F.lit(1)).alias("cnt"))
    r = rank_values(vc, prop, "_a").select(prop, "_a", "before", "n")
    kept = join_on(x, r, [prop, "_a"]).filter(F.col("before") < F.floor(F.col("n") * F.lit(float(top_fraction))))
    sign = kept.groupBy(*k).agg(F.signum(F.sum(v)).alias("_s"))
    agree = kept.join(sign, k).filter(F.signum(F.col(v)) == F.col("_s"))
    merged = agree.groupBy(*k).agg(F.avg(v).alias(v))
    return vecs.select(*k).distinct().join(merged, k, "left").fillna(0.0, [v])


def _unit_hash(*parts: F.Column) -> F.Column:
    """md5 of the parts -> uniform number in [0, 1) from 60 bits."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 15), 16, 10)
    return h.cast("double") / F.lit(float(1 << 60))


def dare_merge(vecs: DataFrame, p: float = 0.5, seed: int = 42, prop: str = "property",
               key: Sequence[str] = ("idx",), v: str = "v") -> DataFrame:
    """Drop each element with probability ``p`` (deterministic md5 draw), rescale the
    survivors by 1/(1-p), and sum the vectors."""
    k = list(key)
    u = _unit_hash(F.lit(seed), F.col(prop), *[F.col(c) for c in k])
    kept = vecs.filter(u >= F.lit(float(p))).withColumn(v, F.col(v) / F.lit(1.0 - p))
    merged = kept.groupBy(*k).agg(F.sum(v).alias(v))
    return vecs.select(*k).distinct().join(merged, k, "left").fillna(0.0, [v])


def train_fraction_subset(items: DataFrame, fractions: Sequence[float], key: Sequence[str], seed: int = 42) -> DataFrame:
    """Nested deterministic subsets: an item is in the ``f`` subset iff its md5 draw
    is below f. Returns the items with a ``fraction`` column (one row per subset)."""
    u = _unit_hash(F.lit(seed), *[F.col(c) for c in key])
    fr = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    return items.withColumn("_u", u).select("*", fr).filter(F.col("_u") < F.col("fraction")).drop("_u")
