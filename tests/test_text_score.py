"""Parsing, categorisation and zero-shot scoring on edge-case literals."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import parsing
from gradus.operators import score as S
from gradus.operators import text as T


@pytest.fixture(scope="module")
def mutants(spark):
    rows = [(1, "A1P:D2N"), (2, ""), (3, None), (4, "A12"), (5, "A1_5P"), (6, "WT"), (7, "C10D"), (8, "A1P::B3")]
    return spark.createDataFrame(rows, "item int, mutant string")


def test_mutation_positions_rule_a(mutants):
    got = {r.item: r.p for r in mutants.select("item", parsing.mutation_positions(F.col("mutant")).alias("p")).collect()}
    assert got[1] == [0, 1] and got[2] == [] and got[3] == []
    assert got[4] == [11]          # leading digits after the first char
    assert got[5] == [0]           # stops at the first non-digit
    assert got[6] == [] and got[7] == [9] and got[8] == [0, 2]


def test_parse_mutations_rule_b(mutants):
    got = {r.item: [(t.wt, t.pos, t.mut) for t in r.m]
           for r in mutants.select("item", parsing.parse_mutations(F.col("mutant")).alias("m")).collect()}
    assert got[1] == [("A", 0, "P"), ("D", 1, "N")]
    assert got[4] == [("A", 0, "2")]   # all digits strictly between first and last char
    assert got[5] == [("A", 14, "P")]  # every digit of the middle, '_' dropped
    assert got[2] == [] and got[3] == [] and got[6] == []
    assert got[8] == [("A", 0, "P")]   # 'B3' has no digit between first and last char


def test_categorize_rules(spark):
    rows = [(1, "MEDIUM", "x", 30), (2, "OrganismalFitness", "red ring", 30), (3, "OrganismalFitness", "red widget", 30),
            (4, "OrganismalFitness", "nothing", 30), (5, "ECONOMY", "ring", 30), (6, "MEDIUM", "x", 3),
            (7, "MEDIUM", "x", None), (8, "OrganismalFitness", "hot ring", 30)]
    df = spark.createDataFrame(rows, "dms_id int, coarse_type string, phenotype string, num_mutants long")
    got = {r.dms_id: r for r in T.categorize(df).collect()}
    assert (got[1].assigned_category, got[1].confidence) == ("stability", "high")
    # tie of one hit each: stability (ring) wins over activity (red) by priority
    assert got[2].assigned_category == "stability" and got[2].matched_keywords == ["ring"]
    assert got[3].assigned_category == "activity" and got[3].matched_keywords == ["widget", "red"]
    assert (got[4].assigned_category, got[4].confidence) == ("activity", "low")
    assert (got[5].assigned_category, got[5].confidence) == ("activity", "low")  # unknown type
    assert got[6].assigned_category == "excluded" and got[6].reason == "too_few_mutations (3 < 25)"
    assert got[7].assigned_category == "stability"  # NULL size is kept
    assert got[8].assigned_category == "stability"  # ring (priority 0) beats hot (priority 2)


def test_truncate_or_exclude(spark):
    rows = [(1, "ACDEFGHIK", "A2C"), (2, "ACDEFGHIK", "A9C"), (3, "ACD", "A9C"), (4, "ACDEFGHIK", None)]
    df = spark.createDataFrame(rows, "id int, seq string, mutant string")
    got = {r.id: (r.action, r.seq_out) for r in T.truncate_or_exclude(df, "seq", "mutant", 5).collect()}
    assert got[1] == ("truncate", "ACDEF") and got[2] == ("exclude", None)
    assert got[3] == ("keep", "ACD") and got[4] == ("truncate", "ACDEF")


def test_zero_shot_score(spark):
    import math
    logits = [[math.log(i + 1.0) for i in range(20)], [0.0] * 20]
    lp = spark.createDataFrame([(0, logits[0]), (1, logits[1])], "pos long, v array<double>") \
        .select("pos", S.log_softmax(F.col("v")).alias("logp"))
    muts = spark.createDataFrame([(1, "A1C"), (2, ""), (3, "A5C"), (4, "A1Z"), (5, "A1C:C2D")], "item int, mutant string")
    got = {r.item: r for r in S.zero_shot_score(muts, lp).collect()}
    z = sum(i + 1.0 for i in range(20))
    assert got[1].zero_shot_score == pytest.approx(math.log(2 / z) - math.log(1 / z))
    assert got[2].zero_shot_score == 0.0 and got[2].n_mutations == 0
    assert got[3].zero_shot_score == 0.0 and got[3].n_skipped == 1        # position outside the table
    assert got[4].zero_shot_score == 0.0 and got[4].n_skipped == 1        # unknown letter
    assert got[5].zero_shot_score == pytest.approx(math.log(2.0))          # second term on a flat row adds 0


def test_log_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 1000.0],)], "v array<double>")
    lp = df.select(S.log_softmax(F.col("v")).alias("l")).first().l
    import math
    assert sum(math.exp(x) for x in lp) == pytest.approx(1.0)


def test_pooling(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 0, 3.0), (1, 2, 0, 5.0), (2, 9, 0, 7.0)]
    df = spark.createDataFrame(rows, "label int, vec_id int, idx int, v double")
    mp = {r.label: r.v for r in S.mean_pool(df, "label", "vec_id").collect()}
    assert mp[1] == 4.0 and mp[2] == 0.0      # first position dropped; lone vector -> 0 / 1e-8 floor
    cp = {r.label: r.v for r in S.cls_pool(df, "label", "vec_id").collect()}
    assert cp == {1: 1.0, 2: 7.0}


def test_head_score_matches_numpy(spark):
    import numpy as np
    w = S.head_weights(4, 3)
    rows = [(i, [float(i), 1.0, -1.0, 0.5 * i]) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, vec array<double>")
    got = {r.id: r.score for r in S.head_score(df, "vec", "id", w).collect()}
    ref = S.head_forward(np.array([r[1] for r in rows]), w)
    for i in range(5):
        assert got[i] == pytest.approx(ref[i])


def test_only_used_positions_are_looked_up(spark):
    logp = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "pos int, logp array<double>")
    terms = spark.createDataFrame([(1, 3), (2, 3), (3, 70), (4, None)], "item int, pos int")
    assert [(r.pos, r.logp) for r in S.used_positions(logp, terms, ["pos"]).collect()] == [(3, [3.0, 0.0])]
