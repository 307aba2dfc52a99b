"""Edit-identity links against all pairs, and components by contraction."""

import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import cluster as C
from gradus.operators.sequence import edit_links


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(rows, identity, coverage):
    rows = sorted({(i, s) for i, s in rows if i is not None and s})
    first = {}
    for i, s in rows:
        first[s] = min(i, first.get(s, i))
    out = {(i, first[s], 0) for i, s in rows if i != first[s]}
    texts = sorted(first)
    for x, a in enumerate(texts):
        for b in texts[x + 1:]:
            n, m = sorted((len(a), len(b)))
            d = distance(a, b)
            if 1 - d / m >= identity - 1e-9 and n / m >= coverage - 1e-9:
                out.add((max(first[a], first[b]), min(first[a], first[b]), d))
    return out


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("ACD"))
        elif s and kind == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("ACD")
    return "".join(s)


@pytest.mark.parametrize("identity,coverage", [(0.8, 0.8), (0.55, 0.5), (0.7, 0.95), (0.9, 0.8), (1.0, 0.8)])
def test_every_pair_is_found(spark, identity, coverage):
    rng = random.Random(int(identity * 100))
    rows = [(None, "ACD"), (900, None), (901, ""), (902, "A"), (903, "A"), (904, "C"), (902, "A")]
    for i in range(12):
        base = "".join(rng.choice("ACDEFG") for _ in range(rng.randrange(1, 26)))
        rows += [(10 * i + j, mutated(rng, base, j)) for j in range(8)]
    got = edit_links(spark.createDataFrame(rows, "k long, seq string"), "k", "seq", identity, coverage).collect()
    assert len(got) == len({(r.id, r.rep) for r in got})
    assert {(r.id, r.rep, r.distance) for r in got} == expected(rows, identity, coverage)


def test_no_sequences(spark):
    x = spark.createDataFrame([], "k long, seq string")
    assert edit_links(x, "k", "seq").count() == 0
    with pytest.raises(ValueError):
        edit_links(x, "k", "seq", identity=0.5)


def test_components_by_contraction(spark):
    """A chain in shuffled order, a hub with a third of the nodes, string ids, loops and null ends."""
    n = 3000
    ids = spark.range(n).select(F.format_string("n%05d", "id").alias("id"))
    chain = spark.range(999).select(F.format_string("n%05d", F.col("id") * 7919 % 1000).alias("id"),
                                    F.format_string("n%05d", (F.col("id") + 1) * 7919 % 1000).alias("rep"))
    hub = spark.range(1000, 2000).select(F.lit("n01500").alias("id"), F.format_string("n%05d", "id").alias("rep"))
    odd = spark.createDataFrame([("n02500", "n02500"), (None, "n02501"), ("n02501", None), ("n02999", "n02998")],
                                "id string, rep string")
    got = {r.member: r.representative
           for r in C.cluster_components(ids, chain.unionByName(hub).unionByName(odd)).collect()}
    assert len(got) == n
    for i in range(n):
        root = 0 if i < 1000 else 1000 if i < 2000 else 2998 if i == 2999 else i
        assert got[f"n{i:05d}"] == f"n{root:05d}"


def test_contraction_shrinks_chain_and_hub(spark):
    for edges in (spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")),
                  spark.range(1, 4001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))):
        counts = []
        for number in range(40):
            left = edges.checkpoint()
            counts.append(left.count())
            if not counts[-1]:
                break
            edges = C._renamed(left, C._contract(left, number))
        assert counts[-1] == 0 and sum(counts) < 6 * counts[0]
        assert all(b < a for a, b in zip(counts, counts[1:]))


def test_a_hub_falls_in_one_round(spark):
    """Copies hang on one sequence: their links are gone after a round, whatever their number."""
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).checkpoint()
    for number in range(3):
        assert C._renamed(star, C._contract(star, number)).count() == 0
