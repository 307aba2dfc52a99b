"""Losses, training-log analytics and weight algebra against numpy references."""

import math

import numpy as np
import pytest

from gradus.operators import log as LG
from gradus.operators import loss as L
from gradus.operators import vectors as VX
from tests.conftest import cut_groups


def listmle_ref(yt, yp, mask):
    order = np.argsort(-np.asarray(yt), kind="stable")
    p, m = np.asarray(yp)[order], np.asarray(mask, float)[order]
    mx = np.max(yp)
    e = np.exp(p - mx) * m
    cs = np.cumsum(e[::-1])[::-1]
    lo = (np.log(cs + 1e-10) - (p - mx)) * m
    return lo.sum() / max(m.sum(), 1)


def test_listmle_and_hinge(spark):
    lists = {1: ([0.9, 0.1, 0.5, 0.3], [0.2, 0.4, 0.6, 0.1], [1, 1, 0, 1]), 2: ([0.5, 0.5], [1.0, 0.0], [1, 1])}
    rows = [(lid, i, yt, yp, m) for lid, (a, b, c) in lists.items() for i, (yt, yp, m) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "list_id int, i int, y_true double, y_pred double, valid int")
    got = {r.list_id: r.loss for r in L.listmle_loss(df, "list_id", "y_true", "y_pred", ["i"], "valid").collect()}
    for lid, (a, b, c) in lists.items():
        assert got[lid] == pytest.approx(listmle_ref(a, b, c))
    h = {r.list_id: (r.n_pairs, r.loss) for r in L.pairwise_hinge_loss(df, "list_id", "y_true", "y_pred", ["i"]).collect()}
    assert h[2] == (0, 0.0)  # tied truths: no ordered pair
    a, b = lists[1][0], lists[1][1]
    ref = [max(0, 1 - (b[i] - b[j])) for i in range(4) for j in range(4) if a[i] > a[j]]
    assert h[1] == (len(ref), pytest.approx(np.mean(ref)))
    with pytest.raises(ValueError):
        L.loss_by_name("focal")


def test_early_stop(spark):
    vals = [0.1, 0.3, 0.2, 0.25, 0.3, 0.29, 0.28, 0.5]
    df = spark.createDataFrame([("p", i + 1, v) for i, v in enumerate(vals)], "property string, epoch int, val double")
    r = LG.best_epoch_early_stop(df, patience=3).first()
    # best 0.3 at epoch 2 (0.3 at epoch 5 is not strictly better); stop at 5 (3 epochs without improvement)
    assert (r.best_epoch, r.best_val, r.stop_epoch, r.epochs_run) == (2, 0.3, 5, 5)


def test_running_mean_blocks(spark):
    rows = [("p", 1, s, float(s % 7)) for s in range(1, 101)]
    df = spark.createDataFrame(rows, "property string, epoch int, step int, loss double")
    got = {r.step: r.running_loss for r in LG.running_mean(df, ["property", "epoch"], "step", "loss", block=8).collect()}
    vals = [float(s % 7) for s in range(1, 101)]
    for s in (1, 8, 9, 57, 100):
        assert got[s] == pytest.approx(np.mean(vals[:s]))


def test_retention(spark):
    names = ["step_5", "step_100", "step_20", "best_model", "step_7", "step_x"]
    df = spark.createDataFrame([("p", n) for n in names], "property string, name string")
    got = {r.name: r.action for r in LG.latest_and_retention(df, "property").collect()}
    assert got == {"step_100": "latest", "step_20": "keep", "step_7": "keep", "step_5": "remove"}


def test_lr_schedule(spark):
    log = spark.range(100).selectExpr("'p' as property", "id as step")
    rows = LG.lr_schedule(log, "property", "step", 0.1).orderBy("step").collect()
    assert rows[0].lr_mult == 0.0 and rows[5].lr_mult == 0.5 and rows[10].lr_mult == 1.0
    assert rows[55].lr_mult == pytest.approx(0.5 * (1 + math.cos(math.pi * 45 / 90)))


@pytest.fixture(scope="module")
def lowrank(spark):
    rng = np.random.default_rng(3)
    rows, mats = [], {}
    for p in range(3):
        for pre in range(2):
            A, B = rng.normal(size=(2, 5)), rng.normal(size=(4, 2))
            mats[(p, pre)] = (A, B)
            rows += [(p, pre, "A", i, j, float(A[i, j])) for i in range(2) for j in range(5)]
            rows += [(p, pre, "B", i, j, float(B[i, j])) for i in range(4) for j in range(2)]
    A, _ = rng.normal(size=(2, 5)), None
    rows += [(2, 9, "A", i, j, float(A[i, j])) for i in range(2) for j in range(5)]  # incomplete pair
    return spark.createDataFrame(rows, "property int, prefix int, matrix string, r int, c int, v double"), mats


def test_delta_norms_and_cosines(lowrank):
    df, mats = lowrank
    blocks = VX.explode_blocks(VX.materialize_delta(df), ["property", "prefix"]).collect()
    for r in blocks:
        A, B = mats[(r.property, r.prefix)]
        assert r.v == pytest.approx((B @ A)[r.r, r.c])
    nrm = {(r.property, r.prefix): r.frob_norm for r in VX.delta_norm_factored(df).collect()}
    for k, (A, B) in mats.items():
        assert nrm[k] == pytest.approx(np.linalg.norm(B @ A))
    cos = {(r.p1, r.p2): r.cosine for r in VX.delta_cosine_factored(df).collect()}
    flat = {p: np.concatenate([(mats[(p, q)][1] @ mats[(p, q)][0]).ravel() for q in range(2)]) for p in range(3)}
    for (a, b), c in cos.items():
        assert c == pytest.approx(flat[a] @ flat[b] / np.linalg.norm(flat[a]) / np.linalg.norm(flat[b]))
    assert cos[(1, 1)] == pytest.approx(1.0) and cos[(0, 2)] == pytest.approx(cos[(2, 0)])
    st = {(r.property, r.prefix): r.status for r in VX.weights_pair(df).collect()}
    assert st[(2, 9)] == "missing_B" and st[(0, 0)] == "complete"


def test_compose_needs_every_coefficient(lowrank):
    df, mats = lowrank
    with pytest.raises(ValueError):
        VX.compose(df, {0: 1.0, 1: 1.0})
    got = {(r.prefix, r.r, r.c): r.v for r in VX.compose(df, {0: 1.0, 1: -1.0, 2: 0.5}).collect()}
    ref = sum(a * (mats[(p, 0)][1] @ mats[(p, 0)][0]) for p, a in [(0, 1.0), (1, -1.0), (2, 0.5)])
    assert got[(0, 1, 3)] == pytest.approx(ref[1, 3])


def test_merges(spark):
    rows = [(p, i, v) for p, vec in enumerate([[1.0, -2.0, 0.1, 0.0], [3.0, 2.0, -0.1, 0.0]]) for i, v in enumerate(vec)]
    df = spark.createDataFrame(rows, "property int, idx int, v double")
    t = {r.idx: r.v for r in VX.ties_merge(df, 0.5).collect()}
    # top-2 by magnitude: p0 {1.0, -2.0}, p1 {3.0, 2.0}; idx1 sign = sign(0.0) = 0 -> nothing agrees
    assert t == {0: 2.0, 1: 0.0, 2: 0.0, 3: 0.0}
    d = VX.dare_merge(df, 0.0).collect()
    assert {r.idx: r.v for r in d} == {0: 4.0, 1: 0.0, 2: 0.0, 3: 0.0}
    sub = VX.train_fraction_subset(df, [0.5, 1.0], ["property", "idx"]).groupBy("fraction").count().collect()
    c = {r.fraction: r["count"] for r in sub}
    assert c[1.0] == 8 and c.get(0.5, 0) <= 8


def test_cosine_matrix_diagonal(spark):
    rows = [(p, i, float((p + 1) * (i + 1))) for p in range(3) for i in range(4)]
    got = {(r.p1, r.p2): r.cosine for r in VX.cosine_matrix(spark.createDataFrame(rows, "property int, idx int, v double")).collect()}
    assert all(got[(p, p)] == pytest.approx(1.0) for p in range(3)) and len(got) == 9


def test_ranking_list_plan_invariants(spark):
    rows = [(a, i) for a, n in [(1, 70), (2, 5), (3, 40)] for i in range(n)]
    v = spark.createDataFrame(rows, "dms_id int, item int")
    steps = spark.range(0, 30).withColumnRenamed("id", "step")
    plan = L.ranking_list_plan(v, steps, "dms_id", ["item"], list_size=16, seed=7).collect()
    by_step = {}
    for r in plan:
        by_step.setdefault(r.step, []).append(r)
    assert set(by_step) == set(range(30))
    sizes = {1: 70, 2: 5, 3: 40}
    for s, rs in by_step.items():
        assert len({r.dms_id for r in rs}) == 1
        a = rs[0].dms_id
        assert len(rs) == min(16, sizes[a]) or len(rs) == sizes[a] % 16  # last list of an assay may be short
        assert len({r.item for r in rs}) == len(rs)
    # lists of one assay are disjoint and cover it
    for a in sizes:
        lists = {}
        for r in plan:
            if r.dms_id == a:
                lists.setdefault(r.list_no, set()).add(r.item)
        items = [i for l in lists.values() for i in l]
        assert len(items) == len(set(items))


def test_suffix_sums_across_blocks(spark, monkeypatch):
    rows = [(1, i, None if i == 17 else float(i % 7), float(i) / 10, int(i % 5 > 0)) for i in range(50)] + [(None, 1, 1.0, 2.0, 1), (None, 2, 2.0, 1.0, 1)]
    sm = spark.createDataFrame(rows, "list_id int, i int, y_true double, y_pred double, valid int")
    want = {}
    for g in (1, None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        mx = max(r[3] for r in own)
        for k, r in enumerate(own):
            want[g, r[1]] = sum(math.exp(x[3] - mx) * x[4] for x in own[k:])
    for ranges in (None, 6):
        cut_groups(monkeypatch, ranges)
        got = {(r.list_id, r.i): r.suffix for r in L.suffix_logsumexp(sm, "list_id", "y_true", "y_pred", ["i"], "valid").collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("ranges", [None, 9])
def test_hinge_equals_pairs(spark, monkeypatch, ranges):
    cut_groups(monkeypatch, ranges)
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.integers(0, 6)), float(rng.integers(0, 30)) / 10) for g, n in ((1, 40), (2, 1), (3, 2), (None, 9)) for i in range(n)]
    rows += [(4, i, 1.0, float(i)) for i in range(5)] + [(5, 0, None, 1.0), (5, 1, 2.0, None), (5, 2, 1.0, 0.5), (5, 3, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "list_id int, i int, y_true double, y_pred double")
    for margin in (1.0, 0.35):
        got = {r.list_id: (r.n_pairs, r.loss) for r in L.pairwise_hinge_loss(df, "list_id", "y_true", "y_pred", ["i"], margin).collect()}
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g and r[2] is not None and r[3] is not None]
            pairs = [max(0.0, margin - (a[3] - b[3])) for a in own for b in own if a[2] > b[2]]
            assert got[g][0] == len(pairs) and got[g][1] == pytest.approx(np.mean(pairs) if pairs else 0.0, abs=1e-9)


def test_hinge_of_a_long_list(spark):
    """More items than pairs could be formed of in a test."""
    n = 20_000
    df = spark.range(n).selectExpr("1 as list_id", "id as i", "cast(id as double) as y_true", "cast(id % 3 as double) as y_pred")
    got = L.pairwise_hinge_loss(df, "list_id", "y_true", "y_pred").first()
    ps = np.arange(n) % 3
    want = 0.0
    seen = np.zeros(3)
    for p in ps:
        want += sum(seen[q] * max(0.0, 1.0 - (p - q)) for q in range(3))
        seen[p] += 1
    assert got.n_pairs == n * (n - 1) // 2 and got.loss == pytest.approx(want / got.n_pairs)


def test_lora_name_parsing(spark):
    names = ["m.layer.3.q.lora_A.default.weight", "m.layer.3.q.lora_B.weight", "m.layer.3.q.weight", "x.lora_A.bias"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    p, m = VX.lora_parts("name")
    got = [(r.p, r.m) for r in df.select(p.alias("p"), m.alias("m")).collect()]
    assert got == [("m.layer.3.q", "A"), ("m.layer.3.q", "B"), (None, None), (None, None)]


def test_log_operators_keep_a_null_group(spark):
    rows = [(g, e, float(v), f"step_{e}") for g in ("a", None) for e, v in enumerate([3, 5, 4, 4, 4, 9], 1)]
    df = spark.createDataFrame(rows, "property string, epoch int, val double, name string")
    got = {r.property: (r.best_epoch, r.best_val, r.stop_epoch, r.epochs_run) for r in LG.best_epoch_early_stop(df, patience=3).collect()}
    assert got == {"a": (2, 5.0, 5, 5), None: (2, 5.0, 5, 5)}
    mean = {(r.property, r.epoch): r.running_loss for r in LG.running_mean(df, ["property"], "epoch", "val", block=2).collect()}
    assert len(mean) == 12 and all(mean[g, 3] == 4.0 and mean[g, 6] == 29 / 6 for g in ("a", None))
    kept = LG.latest_and_retention(df, "property").collect()
    assert len(kept) == 12 and all(sorted(r.step_num for r in kept if r.property == g and r.action != "remove") == [4, 5, 6] for g in ("a", None))


def test_hinge_of_short_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(L, "SMALL", 4)
    rng = np.random.default_rng(5)
    lists = {lid: [(float(t), float(p)) for t, p in zip(rng.integers(0, 5, n), rng.normal(size=n))] for lid, n in ((1, 2), (2, 4), (3, 5), (4, 40), (None, 3))}
    df = spark.createDataFrame([(lid, i, t, p) for lid, x in lists.items() for i, (t, p) in enumerate(x)] + [(2, 9, None, 1.0), (5, 0, None, 1.0)],
                               "list_id int, i int, y_true double, y_pred double")
    got = {r.list_id: (r.n_pairs, r.loss) for r in L.pairwise_hinge_loss(df, "list_id", "y_true", "y_pred", ["i"]).collect()}
    assert got.pop(5) == (0, 0.0)
    assert got.keys() == lists.keys()
    for lid, x in lists.items():
        ref = [max(0.0, 1 - (p - q)) for t, p in x for u, q in x if t > u]
        assert got[lid] == (len(ref), pytest.approx(np.mean(ref) if ref else 0.0))


def _lowrank(spark, odd=()):
    rng = np.random.default_rng(3)
    rows = [(p, x, m, r, c, float(rng.normal())) for p in (0, 1, 2) for x in (7, 8) for m, h, w in (("A", 2, 5), ("B", 3, 2)) for r in range(h) for c in range(w)]
    return rows + list(odd), spark.createDataFrame(rows + list(odd), "property int, prefix int, matrix string, r int, c int, v double")


def test_factored_forms_move_the_factors_once(spark):
    # a repeated element counts twice, a NULL one not at all; property 9 has no B, property 10 only NULL
    odd = [(0, 7, "A", 0, 0, 2.0), (1, 8, "B", 0, 0, None), (9, 7, "A", 0, 0, 1.0), (10, 7, "A", 0, 0, None), (10, 7, "B", 0, 0, 1.0), (2, None, "A", 0, 0, 1.0)]
    rows, df = _lowrank(spark, odd)
    delta = {}
    for p, x in {(p, x) for p, x, *_ in rows if x is not None}:
        f = {m: np.zeros(s) for m, s in (("A", (2, 5)), ("B", (3, 2)))}
        for q, y, m, r, c, v in rows:
            if (q, y) == (p, x) and v is not None:
                f[m][r, c] += v
        delta[p, x] = f["B"] @ f["A"]
    norms = {(r.property, r.prefix): r.frob_norm for r in VX.delta_norm_factored(df).collect()}
    assert norms.keys() == delta.keys() - {(9, 7)}
    assert all(norms[k] == pytest.approx(np.linalg.norm(delta[k])) for k in norms)
    cos = VX.delta_cosine_factored(df)
    assert cos._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(prefix") == 1
    got = {(r.p1, r.p2): r.cosine for r in cos.collect()}
    flat = {p: np.concatenate([delta[p, x].ravel() for x in (7, 8)]) for p in (0, 1, 2)}
    for p in flat:
        for q in flat:
            assert got[p, q] == pytest.approx(flat[p] @ flat[q] / np.linalg.norm(flat[p]) / np.linalg.norm(flat[q]))
    prof = {r.layer: r for r in VX.layer_profile(df).collect()}
    assert (prof[7].n_properties, prof[8].n_properties) == (4, 3)
    assert prof[8].max_norm == pytest.approx(max(np.linalg.norm(delta[p, 8]) for p in (0, 1, 2)))
