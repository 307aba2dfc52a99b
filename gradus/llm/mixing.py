"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate ``rate = epochs * total_size * weight_share / source_size``
and every document a Poisson count with that mean, found by inverting the distribution at a
hash of (seed, doc_id): the draw needs no state, is the same on every run and partitioning, and
its mean holds per document. Documents are exploded by their count and shuffled globally by a
hash of (seed, doc_id, copy).

The per-source table is the only thing that is joined; it is written first, so the planner
broadcasts it only when its measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles, where a hot source is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import rename_clashes, save

ALPHA, SEED = 0.7, 17
#: Largest mean inverted at once; a larger one is the sum of equal independent draws, as exp(-mean) would underflow.
MAX_MEAN = 500.0


def doc_size(text: Column) -> Column:
    """Bytes of the text and one for its end, so that a source of empty texts has a size."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0,
                 text: str = "text", source: str = "source") -> DataFrame:
    """(source, size, rate) from counts over all documents. ``weights`` maps sources to target
    weights (a source without one gets 0); None takes ``size ** alpha``."""
    by = docs.groupBy(F.col(source).alias("source")).agg(F.sum(doc_size(F.col(text))).cast("double").alias("size"))
    if weights is None:
        w = F.pow("size", F.lit(float(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        by = by.join(given, by["source"].eqNullSafe(given["source"]), "left").select(by["source"], "size", F.coalesce("w", F.lit(0.0)).alias("w"))
        w = F.col("w")
    by = save(by.withColumn("w", w), "mix-sizes")
    total, total_w = by.agg(F.sum("size"), F.sum("w")).first()
    if not total_w:
        return by.select("source", "size", F.lit(0.0).alias("rate"))
    rate = F.lit(float(epochs)) * F.lit(total) * F.col("w") / F.lit(total_w) / F.col("size")
    return by.select("source", "size", rate.alias("rate"))


def _cdf(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where a double reaches 1."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["all"])


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED,
                doc_id: str = "doc_id", text: str = "text", source: str = "source", added: bool = True) -> DataFrame:
    """All columns of ``docs``, each row as often as drawn, in globally shuffled order.

    With ``added``: copy (1..n_copies), n_copies, mix_key (the order); input columns of these
    names are dropped. Without: exactly the input's columns, whatever their names.
    A null source is a source of its own; null and empty texts have size 1; a null doc_id draws
    as the word ``null``; rows that repeat a doc_id share its draw, so repeated rows stay equally
    often repeated. An empty table gives an empty table. Columns on the way have names that no
    input column begins with."""
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    names = ["copy", "n_copies", "mix_key"] if added else [f"{own}_copy", f"{own}_n", f"{own}_key"]
    docs = rename_clashes(docs, names)
    rates = source_rates(docs, weights, alpha, epochs, text, source)
    draws = F.greatest(F.ceil(F.col("rate") / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    cdf = _cdf(F.col("rate") / F.col("draws"))
    rates = rates.withColumn("draws", draws).select(F.col("source").alias(f"{own}_source"), F.col("draws").alias(f"{own}_draws"), cdf.alias(f"{own}_cdf"))
    j = docs.join(save(rates, "mix-rates"), F.col(source).eqNullSafe(F.col(f"{own}_source")))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    us = F.transform(F.sequence(F.lit(1), F.col(f"{own}_draws")), lambda i: uniform(F.lit(str(seed)), key, i.cast("string")))
    n = F.aggregate(us, F.lit(0), lambda acc, u: acc + F.size(F.filter(f"{own}_cdf", lambda c: c <= u)))
    out = j.withColumn(names[1], n).where(F.col(names[1]) > 0).drop(f"{own}_source", f"{own}_draws", f"{own}_cdf")
    out = out.withColumn(names[0], F.explode(F.sequence(F.lit(1), F.col(names[1]))))
    out = out.withColumn(names[2], F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col(names[0]).cast("string")).cast("binary")))
    out = out.repartition(names[2]).sortWithinPartitions(names[2])
    return out if added else out.drop(*names)
