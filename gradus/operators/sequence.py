"""Short sequences (C1, C2): pairs by edit identity, 1 - edit distance / longer length.

Word shingles can't compare sequences without words. Here the shorter sequence of a pair is cut into
one piece more than the pair may have edits, so at least one piece stays whole in the longer one, near
its place (pigeonhole). Pieces and the substrings they may meet are equi-joined, then the edit distance
is computed in a band of the allowed edits. No pair is missed, and both stay in Spark's own functions.

How far a piece may move: the i-th of k + 1 pieces (from 0) has i pieces before it and k - i behind it.
If it is the first piece without an edit, the i pieces before it hold one edit each at least, so at
most k - i edits are left for what comes behind, and the same from the other end. A substring at place
p' can thus be left out unless |p' - p| <= i and |p' - p - (longer - shorter)| <= k - i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.columns import spread

# Fixed parameters: least edit identity of a link, and the least length ratio (as COVERAGE of texts)
IDENTITY = 0.8
COVERAGE = 0.8


def _edits(longer: F.Column, identity: float) -> F.Column:
    """Edits that a pair may have whose longer sequence has that length."""
    return F.floor(F.lit(1.0 - float(identity)) * longer + F.lit(1e-9)).cast("int")


def _pieces(s: F.Column, n: F.Column, m: F.Column, k: F.Column) -> F.Column:
    """The k + 1 pieces of a sequence of n characters for partners of m characters, as join keys.
    The first pieces are the shorter ones."""
    size = F.floor(n / (k + 1)).cast("int")
    short = k + 1 - n % (k + 1)

    def piece(i: F.Column) -> F.Column:
        i = i.cast("int")
        at = i * size + F.greatest(i - short, F.lit(0))
        return F.struct(n.alias("n"), m.alias("m"), i.alias("i"),
                        F.substring(s, at + 1, size + (i >= short).cast("int")).alias("piece"))

    return F.transform(F.sequence(F.lit(0), k), piece)


def _places(s: F.Column, n: F.Column, m: F.Column, k: F.Column) -> F.Column:
    """The substrings of a sequence of m characters that may be pieces of one of n characters."""
    size = F.floor(n / (k + 1)).cast("int")
    short = k + 1 - n % (k + 1)

    def of_piece(i: F.Column) -> F.Column:
        i = i.cast("int")
        at = i * size + F.greatest(i - short, F.lit(0))
        long = size + (i >= short).cast("int")
        first = F.greatest(F.lit(0), at - i, at + (m - n) - (k - i))
        last = F.least(m - long, at + i, at + (m - n) + (k - i))
        return F.when(first <= last, F.transform(
            F.sequence(first, F.greatest(first, last)),
            lambda p: F.struct(n.alias("n"), m.alias("m"), i.alias("i"), F.substring(s, p + 1, long).alias("piece")))) \
            .otherwise(F.array().cast("array<struct<n:int,m:int,i:int,piece:string>>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), k), of_piece)))


def edit_links(df: DataFrame, id_col: str, text: str, identity: float = IDENTITY, coverage: float = COVERAGE,
               partitions: int | None = None) -> DataFrame:
    """Every pair of sequences with edit identity >= ``identity`` (above 0.5) and shorter / longer
    length >= ``coverage``: (id, rep, distance, identity, coverage). Copies give one row each, to the
    smallest id of their sequence (distance 0); other pairs are between the smallest ids of two
    sequences, id > rep. Null and empty sequences link with nothing. A repeated id with one sequence
    counts once.

    A sequence gives (1 - identity) x length pieces for every length its partner may have, so it is
    meant for short sequences; rows stay linear in their number."""
    if not 0.5 < identity <= 1:
        raise ValueError("identity must be above 0.5 and at most 1")
    x = spread(df.select(F.col(id_col).alias("id"), F.col(text).alias("s")).where("id is not null and s <> ''"), partitions)
    same = x.groupBy("s").agg(F.min("id").alias("rep"))
    copies = x.join(same, "s").where("id <> rep").distinct() \
        .select("id", "rep", F.lit(0).alias("distance"), F.lit(1.0).alias("identity"), F.lit(1.0).alias("coverage"))
    one = same.select(F.col("rep").alias("id"), "s", F.length("s").alias("len"))
    share = max(float(identity), float(coverage))  # a length ratio below the identity can't reach it
    n, m = F.col("len"), F.col("other")
    longest = F.floor(n / F.lit(share) + F.lit(1e-9)).cast("int")
    shortest = F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int")
    pieces = one.withColumn("other", F.explode(F.sequence(n, F.greatest(n, longest)))) \
        .select("id", "s", F.explode(_pieces(F.col("s"), n, m, _edits(m, identity))).alias("key"))
    places = one.withColumn("other", F.explode(F.sequence(F.greatest(F.lit(1), shortest), n))) \
        .select("id", "s", F.explode(_places(F.col("s"), m, n, _edits(n, identity))).alias("key"))
    a = pieces.select(F.col("id").alias("ia"), F.col("s").alias("sa"), "key.*")
    b = places.select(F.col("id").alias("ib"), F.col("s").alias("sb"), "key.*")
    # sequences of one length meet in both orders: one is enough
    met = a.join(b, ["n", "m", "i", "piece"]).where((F.col("n") < F.col("m")) | (F.col("ia") < F.col("ib")))
    k = _edits(F.col("m"), identity)
    # the band of a join row is as wide as its length allows; beyond it the distance is -1
    met = met.withColumn("distance", F.when(k == 0, F.when(F.col("sa") == F.col("sb"), 0).otherwise(-1))
                         .when(k < 0, -1).otherwise(F.expr("levenshtein(sa, sb, cast(floor({} * m + 1e-9) as int))"
                                                          .format(repr(1.0 - float(identity))))))
    found = met.where("distance >= 0").select(
        F.greatest("ia", "ib").alias("id"), F.least("ia", "ib").alias("rep"), "distance",
        (1 - F.col("distance") / F.col("m")).alias("identity"), (F.col("n") / F.col("m")).alias("coverage")).distinct()
    return found.unionByName(copies)
