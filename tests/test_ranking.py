"""Ranking metrics on literal edge cases, brute-force references, and the equality of the
window plan and the range-sorted plan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import ranking
from gradus.functions.ranking import discount_sum_rows, rank_values, value_counts
from gradus.functions.special import t_two_sided_p
from gradus.operators import rank as R
from tests.conftest import cut_groups


def avg_ranks(x):
    x = np.asarray(x, dtype=float)
    order = np.argsort(x, kind="mergesort")
    r = np.empty(len(x))
    i = 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[order[j + 1]] == x[order[i]]:
            j += 1
        r[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return r


def spearman_ref(y, p):
    if len(y) < 2:
        return None
    a, b = avg_ranks(y), avg_ranks(p)
    if a.std() == 0 or b.std() == 0:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def ndcg_ref(y, p, k=None):
    y, p = np.asarray(y, float), np.asarray(p, float)
    n = len(y)
    if n < 2 or y.min() < 0:
        return None
    disc = 1 / np.log2(np.arange(n) + 2)
    if k is not None:
        disc[k:] = 0
    cs = np.cumsum(disc)
    vals, inv, counts = np.unique(-p, return_inverse=True, return_counts=True)
    ranked = np.zeros(len(counts))
    np.add.at(ranked, inv, y)
    ranked /= counts
    ends = np.cumsum(counts) - 1
    ds = np.diff(np.concatenate([[0.0], cs[ends]]))
    dcg = (ranked * ds).sum()
    ideal = (np.sort(y)[::-1] * disc).sum()
    return 0.0 if ideal == 0 else dcg / ideal


GROUPS = {
    "const": ([1.0, 1.0, 1.0], [1.0, 2.0, 3.0]),
    "one": ([5.0], [2.0]),
    "ties": ([1.0, 2.0, 2.0, 3.0, 3.0, 3.0], [0.5, 0.5, 1.0, 1.0, 2.0, 0.1]),
    "neg": ([-1.0, 2.0, 3.0], [1.0, 2.0, 3.0]),
    "zero": ([0.0, 0.0, 0.0, 0.0], [4.0, 3.0, 2.0, 1.0]),
    "rand": (list(np.round(np.random.default_rng(1).normal(size=40), 1)),
             list(np.round(np.random.default_rng(2).normal(size=40), 1))),
}


@pytest.fixture(scope="module")
def lit_df(spark):
    rows = [(g, i, float(y), float(p), int(y > 1)) for g, (ys, ps) in GROUPS.items()
            for i, (y, p) in enumerate(zip(ys, ps))]
    rows.append(("const", 99, None, 1.0, 0))  # NULL score is ignored
    return spark.createDataFrame(rows, "g string, i int, y double, p double, lab int")


def test_spearman_edge_cases(lit_df):
    got = {r.g: r.spearman for r in R.spearman_by_group(lit_df, "g", "y", "p").collect()}
    for g, (ys, ps) in GROUPS.items():
        ref = spearman_ref(ys, ps)
        if ref is None:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(ref, abs=1e-12), g


def test_ndcg_against_reference(lit_df):
    got = {r.g: (r.ndcg, r.ndcg_10) for r in R.ndcg_by_group(lit_df, "g", "y", "p", 0.5).collect()}
    for g, (ys, ps) in GROUPS.items():
        k = max(1, int(len(ys) * 0.5))
        for v, ref in zip(got[g], (ndcg_ref(ys, ps), ndcg_ref(ys, ps, k))):
            if ref is None:
                assert v is None, g
            else:
                assert v == pytest.approx(ref, abs=1e-12), g


def test_auc_mann_whitney(lit_df):
    got = {r.g: r.auc for r in R.auc_by_group(lit_df, "g", "lab", "p").collect()}
    for g, (ys, ps) in GROUPS.items():
        lab = np.array([int(y > 1) for y in ys])
        if lab.min() == lab.max():
            assert got[g] is None
            continue
        pos, neg = np.array(ps)[lab == 1], np.array(ps)[lab == 0]
        ref = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert got[g] == pytest.approx(ref, abs=1e-12)


def test_topk_recall_bounds_and_ties(lit_df):
    for r in R.topk_recall(lit_df, "g", "y", "p", ["i"], 0.5).collect():
        assert 0.0 <= r.top_10_recall <= 1.0


def test_ranges_do_not_change_ranks(spark, monkeypatch):
    from gradus.plans import views as V
    d = V.v_pred(spark, "/root/testdata/sf0.001")
    vc = value_counts(d, "dms_id", "pred")
    got = []
    for n in (None, 23):
        cut_groups(monkeypatch, n)
        got.append({(r.dms_id, r.pred): (r.before, r.n) for r in rank_values(vc, "dms_id", "pred").collect()})
    whole, cut = got
    assert whole == cut
    by = {}
    for (g, v), _ in sorted(whole.items()):
        by.setdefault(g, []).append(v)
    counts = {(r.dms_id, r.pred): r.cnt for r in vc.collect()}
    for g, vs in by.items():
        at = 0
        for v in vs:
            assert whole[g, v][0] == at
            at += counts[g, v]


VALUES = {
    "string": [str(i) for i in range(1, 31)] + ["a", "B", "é", "", None],
    "date": [f"20{i:02d}-0{1 + i % 9}-11" for i in range(30)] + [None],
    "decimal(20,3)": [f"{(-1) ** i * i * 7}.125" for i in range(30)] + [None],
    "timestamp": [f"2024-01-{1 + i % 28:02d} 0{i % 9}:00:00" for i in range(30)],
    "double": ["NaN", "-0.5", "1e300", "-Infinity", "7", "10", "9", None],
    "long": [str(9007199254740993 + i) for i in range(12)] + ["-3", "3", None],
}


@pytest.mark.parametrize("kind", VALUES)
def test_every_type_ranks_like_a_window(spark, monkeypatch, kind):
    """A hot group (most rows, cut into ranges) and small ones, in the type's own order."""
    from pyspark.sql.window import Window

    cut_groups(monkeypatch, 5)
    rows = [(g, v, 1 + i % 3, i) for i, v in enumerate(VALUES[kind] * 2) for g in ("hot", *(["x"] if i % 5 == 0 else []), *([None] if i % 7 == 0 else []))]
    df = spark.createDataFrame(rows, "g string, v string, w long, i long").withColumn("v", F.col("v").cast(kind)).distinct()
    vc = df.groupBy("g", "v").agg(F.sum("w").alias("cnt"))
    for down in (False, True):
        order = F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last()
        w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        want = vc.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0))).withColumn("n", F.sum("cnt").over(Window.partitionBy("g")))
        cols = ["g", F.col("v").cast("string").alias("v"), "cnt", "before", "n"]
        assert sorted(map(str, rank_values(vc, "g", "v", descending=down).select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
        got = ranking.row_positions(df, "g", "v", ["i"], "pos", descending=down)
        want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(order, "i")))
        assert sorted(map(tuple, got.select("g", "i", "pos").collect()), key=str) == sorted(map(tuple, want.select("g", "i", "pos").collect()), key=str)


@pytest.mark.parametrize("down", [False, True])
def test_ranked_rows_with_hot_ties(spark, monkeypatch, down):
    """Tie blocks and groups cut into ranges against windows; rows count a weight."""
    from pyspark.sql.window import Window

    cut_groups(monkeypatch, 9)
    rows = [(g, v, 1 + i % 4, i) for i in range(400) for g, v in ((1, 0.0 if i % 3 else float(i % 7)), (None, float("nan") if i % 2 else None)) if g or i % 5 == 0]
    df = spark.createDataFrame(rows, "g int, v double, w long, i long")
    got = ranking.ranked_rows(df, "g", "v", ["i"], "r", "w", descending=down)
    by = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last())
    upto = F.sum("w").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tie = F.sum("w").over(Window.partitionBy("g", "v"))
    pos = F.sum("w").over(by.orderBy(F.col("v").desc_nulls_last() if down else F.col("v").asc_nulls_last(), "i").rowsBetween(Window.unboundedPreceding, -1))
    want = df.select("g", "i", F.coalesce(pos, F.lit(0)), upto - tie, tie, F.sum("w").over(Window.partitionBy("g")))
    assert sorted(map(tuple, got.select("g", "i", "r_pos", "r_start", "r_cnt", "n").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_sums_without_a_group(spark, monkeypatch):
    cut_groups(monkeypatch, 4)
    df = spark.range(200).select(F.col("id"), (F.col("id") * 2).alias("x"))
    got = ranking.sorted_sums(df, [], [F.col("id").desc()], {"x": "after"}).collect()
    assert all(r.after == sum(2 * i for i in range(r.id + 1, 200)) and r.after_all == 39800 for r in got)


def test_order_of_nan_and_null(spark, monkeypatch):
    """NaN is the largest number, NULL is last in both directions, a NULL group is a group."""
    nan = float("nan")
    rows = [(g, v, c) for g in (1, None) for v, c in ((1.0, 2), (nan, 3), (None, 5), (-2.0, 1))]
    vc = spark.createDataFrame(rows, "g int, v double, cnt long")
    for n in (1, 6):
        cut_groups(monkeypatch, n)
        up = {(r.g, str(r.v)): r.before for r in rank_values(vc, "g", "v").collect()}
        down = {(r.g, str(r.v)): r.before for r in rank_values(vc, "g", "v", descending=True).collect()}
        for g in (1, None):
            assert [up[g, k] for k in ("-2.0", "1.0", "nan", "None")] == [0, 1, 3, 6]
            assert [down[g, k] for k in ("nan", "1.0", "-2.0", "None")] == [0, 3, 5, 6]


def test_avg_rank_nulls_and_ties(lit_df):
    c = {(r.g, r.i): r.rank for r in R.avg_rank(lit_df, "g", "y").collect()}
    assert c[("const", 99)] is None
    assert c[("ties", 1)] == 2.5


def test_normalize_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, s double")
    mm = {(r.g, r.s): r.score_norm for r in R.normalize_scores(df, "g", "s", "minmax").collect()}
    assert mm[("a", 1.0)] == 0.0 and mm[("a", 3.0)] == 1.0 and mm[("b", 2.0)] == 0.5
    z = {(r.g, r.s): r.score_norm for r in R.normalize_scores(df, "g", "s", "zscore").collect()}
    assert z[("a", 3.0)] == pytest.approx(1.0) and z[("b", 2.0)] == 0.0
    rk = {(r.g, r.s): r.score_norm for r in R.normalize_scores(df, "g", "s", "rank").collect()}
    assert rk[("b", 2.0)] == 0.75 and rk[("a", 3.0)] == 1.0
    with pytest.raises(ValueError):
        R.normalize_scores(df, "g", "s", "bogus")


def test_discount_chunks_match_direct(spark):
    df = spark.createDataFrame([(0, 0, 10000, 3000), (1, 5, 3, 2)], "g int, start long, cnt long, k long")
    out = discount_sum_rows(df, "start", "cnt", {"d": None, "dk": "k"}, chunk=64) \
        .groupBy("g").agg(F.sum("d").alias("d"), F.sum("dk").alias("dk")).collect()
    got = {r.g: (r.d, r.dk) for r in out}
    for g, s, c, k in [(0, 0, 10000, 3000), (1, 5, 3, 2)]:
        pos = np.arange(s + 1, s + c + 1)
        d = (1 / np.log2(pos + 1)).sum()
        dk = (1 / np.log2(pos[pos <= k] + 1)).sum()
        assert got[g][0] == pytest.approx(d, rel=1e-12) and got[g][1] == pytest.approx(dk, abs=1e-12)


def test_spearman_pvalue_known_values():
    p = t_two_sided_p(np.array([0.5, 0.9, 1.0, 0.0, float("nan")]), np.array([10, 5, 10, 20, 10]))
    assert p[0] == pytest.approx(0.14111328, abs=1e-7)
    assert p[1] == pytest.approx(0.03738607, abs=1e-7)
    assert p[2] == 0.0 and p[3] == pytest.approx(1.0)
    assert math.isnan(p[4])


def test_spearman_pvalue_udf(spark, lit_df):
    res = R.spearman_pvalue(R.spearman_by_group(lit_df, "g", "y", "p")).collect()
    got = {r.g: r.spearman_pval for r in res}
    assert got["one"] is None
    assert got["const"] == 1.0  # constant side: rho 0 -> p 1


def test_cross_property_matrix_shape(spark):
    from gradus.plans import views as V
    m = R.cross_property_matrix(V.v_model_pred(spark, "/root/testdata/sf0.001"),
                                ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    assert m.columns == ["model", "economy", "large", "medium", "promo", "small", "standard"]
    assert {r.model for r in m.collect()} == {"quantity", "discount", "tax"}


def _windows(rows, k_fraction=0.1):
    """Top-k recall by sorting, of rows (group, y, p, key)."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        k = max(1, int(len(own) * k_fraction))
        a, b = ({x[3] for x in sorted(own, key=lambda r: (-r[c], r[3]))[:k]} for c in (1, 2))
        out[g] = len(a & b) / k
    return out


@pytest.mark.parametrize("whole", [None, 7])
def test_topk_recall_equals_sorting(spark, monkeypatch, whole):
    cut_groups(monkeypatch, whole)
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.integers(0, 4)), float(rng.integers(0, 5)), i) for g, n in ((1, 90), (2, 7), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, y double, p double, i int")
    for f in (0.1, 0.5):
        assert {r.g: r.top_10_recall for r in R.topk_recall(df, "g", "y", "p", ["i"], f).collect()} == pytest.approx(_windows(rows, f))


def test_assay_metrics_equal_the_operators(spark):
    from gradus.plans import views as V
    from gradus.plans.q_rank import KEY
    d = V.v_pred(spark, "/root/testdata/sf0.01")
    fast = {r.dms_id: r for r in R.assay_metrics(d, "dms_id", "dms_score", "pred", "dms_score_bin", KEY).collect()}
    sp = {r.dms_id: r for r in R.spearman_pvalue(R.spearman_by_group(d, "dms_id", "dms_score", "pred")).collect()}
    nd = {r.dms_id: r for r in R.ndcg_by_group(d, "dms_id", "dms_score", "pred", 0.1).collect()}
    tk = {r.dms_id: r for r in R.topk_recall(d, "dms_id", "dms_score", "pred", KEY, 0.1).collect()}
    au = {r.dms_id: r for r in R.auc_by_group(d, "dms_id", "dms_score_bin", "pred").collect()}
    assert set(fast) == set(sp)
    for k, r in fast.items():
        assert r.n_variants == sp[k].n_variants and r.spearman_pval == pytest.approx(sp[k].spearman_pval, abs=1e-9)
        assert r.spearman == pytest.approx(sp[k].spearman, abs=1e-12)
        assert r.ndcg == pytest.approx(nd[k].ndcg, abs=1e-12) and r.ndcg_10 == pytest.approx(nd[k].ndcg_10, abs=1e-12)
        assert r.top_10_recall == tk[k].top_10_recall and r.auc == pytest.approx(au[k].auc, abs=1e-12)


def test_ranges_do_not_change_metrics(spark, monkeypatch):
    """A third of the rows in one group, and every group cut into many ranges."""
    from gradus.plans import views as V
    from gradus.plans.q_rank import KEY
    d = V.v_pred(spark, "/root/testdata/sf0.001") \
        .withColumn("grp", F.when(F.col("dms_id") % 3 == 0, F.lit(-1)).otherwise(F.when(F.col("dms_id") % 3 == 1, F.col("dms_id"))))
    got = []
    for whole in (None, 5):
        cut_groups(monkeypatch, whole)
        got.append({r[0]: tuple(r)[1:] for r in R.assay_metrics(d, "grp", "dms_score", "pred", "dms_score_bin", KEY).collect()})
    assert got[0].keys() == got[1].keys() and {-1, None} <= got[0].keys()
    for k in got[0]:
        assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-9) for a, b in zip(got[0][k], got[1][k]))


def test_metrics_independent_of_shuffle_partitions(spark):
    from gradus.plans import views as V
    from gradus.plans.q_rank import KEY
    d = V.v_pred(spark, "/root/testdata/sf0.001")
    out = []
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(tuple(r) for r in R.assay_metrics(d, "dms_id", "dms_score", "pred", "dms_score_bin", KEY)
                          .collect()))
    spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert len(out[0]) == len(out[1])
    for a, b in zip(*out):
        assert all((x is None and y is None) or x == pytest.approx(y, abs=1e-12) for x, y in zip(a, b))


@pytest.mark.parametrize("ranges", [None, 3])
def test_models_share_the_measured_ranks(spark, monkeypatch, ranges):
    """Groups with a prediction missing, NULL groups, ties and NaN give what each model alone gives."""
    cut_groups(monkeypatch, ranges)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, "gap"]), float(rng.randrange(6)) if rng.random() < 0.9 else None,
             float(rng.randrange(5)), float("nan") if i % 17 == 0 else float(i % 9)) for i in range(240)]
    rows = [(g, y, None if g == "gap" and i % 4 == 0 else p, q) for i, (g, y, p, q) in enumerate(rows)] + [("one", 1.0, 2.0, None)]
    x = spark.createDataFrame(rows, "g string, y double, p double, q double")
    models = F.array(F.struct(F.lit("p").alias("model"), F.col("p").alias("pred")),
                     F.struct(F.lit("sum").alias("model"), (F.col("p") + F.col("q")).alias("pred")))
    got = {(r.model, r.g): (r.n_variants, r.spearman) for r in R.spearman_by_model(x, "g", "y", models, ["p", "q"]).collect()}
    long = x.select("g", "y", F.explode(models).alias("m")).select("m.model", "g", "y", "m.pred")
    want = {(r.model, r.g): (r.n_variants, r.spearman) for r in R.spearman_by_group(long, ["model", "g"], "y", "pred").collect()}
    assert got.keys() == want.keys()
    for k, (n, rho) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(rho, nan_ok=True)


def test_spearman_by_model_deals_what_the_items_grow_to(spark, monkeypatch):
    rows = [(g, float((7 * i + g) % 11), float((3 * i) % 7), float((5 * i) % 13)) for g in range(6) for i in range(20)]
    x = spark.createDataFrame(rows, "g int, y double, p double, q double")
    models = F.array(F.struct(F.lit("a").alias("model"), F.col("p").alias("pred")), F.struct(F.lit("b").alias("model"), F.col("q").alias("pred")))

    def result():
        return sorted((r.model, r.g, r.n_variants, round(r.spearman, 9)) for r in R.spearman_by_model(x, "g", "y", models, ["p", "q"]).collect())

    whole = result()
    monkeypatch.setattr(ranking, "TASK_ROWS", 100)
    assert result() == whole
    plan = R.spearman_by_model(x, "g", "y", models, ["p", "q"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(g" in plan and ", 3)" in plan  # 240 rows of 120 items
