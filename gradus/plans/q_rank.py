"""Query bindings of the ranking metrics (W1, W2, A1-A6, O2) to the harness views."""

from __future__ import annotations

from gradus.operators import rank as R
from gradus.plans import views as V
from gradus.plans.oracle_views import LINE_KEY_SQL, with_views
from gradus.plans.registry import query

KEY = V.LINE_KEY
K_FRACTION = 0.1
MODEL_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

# --------------------------------------------------------------- shared oracle pieces
AVG_RANK_SQL = ("(rank() over (partition by {g} order by {v}) + "
                "(count(*) over (partition by {g}, {v}) - 1) / 2.0::double)")


def _spearman_sql(src: str, g: str, y: str, p: str) -> str:
    ry = AVG_RANK_SQL.format(g=g, v=y)
    rp = AVG_RANK_SQL.format(g=g, v=p)
    return f"""
select {g}, count(*) as n_variants,
       case when count(*) < 2 then null
            when stddev_pop(ry) > 0 and stddev_pop(rp) > 0
            then covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) else 0.0::double end as spearman
from (select {g}, {ry} as ry, {rp} as rp from {src} where {y} is not null and {p} is not null) r
group by {g}"""


def _ndcg_sql(src: str, g: str, y: str, p: str, key: str) -> str:
    return f"""
select i.{g}, case when i.n < 2 or i.miny < 0 then null when i.idcg = 0 then 0.0::double
                   else d.dcg / i.idcg end as ndcg,
       case when i.n < 2 or i.miny < 0 then null when i.idcgk = 0 then 0.0::double
            else d.dcgk / i.idcgk end as ndcg_10
from (select {g}, sum(y / log2(ry + 1)) as idcg,
             sum(case when ry <= k then y / log2(ry + 1) else 0.0 end) as idcgk,
             count(*) as n, min(y) as miny from ndcg_pos group by {g}) i
join (select {g}, sum(gain) as dcg, sum(gaink) as dcgk
      from (select {g}, p, avg(y) * sum(1.0 / log2(rp + 1)) as gain,
                   avg(y) * sum(case when rp <= k then 1.0 / log2(rp + 1) else 0.0 end) as gaink
            from ndcg_pos group by {g}, p) t group by {g}) d on d.{g} = i.{g}"""


def _ndcg_pos_cte(src: str, g: str, y: str, p: str, key: str) -> tuple[str, str]:
    return ("ndcg_pos", f"""
select {g}, {y} as y, {p} as p,
       row_number() over (partition by {g} order by {p} desc, {key}) as rp,
       row_number() over (partition by {g} order by {y} desc, {key}) as ry,
       greatest(1, floor(count(*) over (partition by {g}) * {K_FRACTION}::double))::bigint as k
from {src} where {y} is not null and {p} is not null""")


def _topk_sql(g: str) -> str:
    return f"""
select {g}, sum(case when ry <= k and rp <= k then 1 else 0 end) / max(k)::double as top_10_recall
from ndcg_pos group by {g}"""


def _auc_sql(src: str, g: str, lab: str, p: str) -> str:
    rk = AVG_RANK_SQL.format(g=g, v=p)
    return f"""
select {g}, case when sum(lab) > 0 and count(*) - sum(lab) > 0
                 then (sum(case when lab = 1 then rk else 0.0 end) - sum(lab) * (sum(lab) + 1) / 2.0::double)
                      / (sum(lab) * (count(*) - sum(lab)))::double end as auc
from (select {g}, {lab} as lab, {rk} as rk from {src} where {p} is not null and {lab} is not null) r
group by {g}"""


def _pval_sql(src: str, g: str) -> str:
    """Two-sided p of ``spearman`` on ``n_variants`` rows of ``src``: the finite series of the t
    distribution for whole degrees of freedom, with sin = |r| and cos = sqrt(1 - r^2)."""
    ratio = "case when k = 0 then 0.0 when nu % 2 = 1 then ln(2.0::double * k / (2 * k + 1)) else ln((2.0::double * k - 1) / (2 * k)) end"
    return f"""
select p.{g}, case when n_variants < 2 then null when nu = 0 then 1.0 when abs(r) >= 1 then 0.0
            when nu = 1 then 1 - 2 / pi() * asin(abs(r))
            when nu % 2 = 1 then 1 - 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * t.s)
            else 1 - abs(r) * t.s end as spearman_pval
from (select {g}, n_variants, n_variants - 2 as nu, spearman as r from {src}) p
left join (select {g}, sum(exp(la + k * ln(1 - r * r))) as s
           from (select {g}, k, r, sum({ratio}) over (partition by {g} order by k) as la
                 from (select {g}, n_variants - 2 as nu, spearman as r,
                              unnest(range(0, case when (n_variants - 2) % 2 = 1 then (n_variants - 3) // 2 else (n_variants - 2) // 2 end)) as k
                       from {src} where n_variants > 2 and abs(spearman) < 1) a) b
           group by {g}) t on t.{g} = p.{g}"""


# --------------------------------------------------------------- W1
@query("avg_rank", with_views(f"""
select dms_id, l_orderkey, l_linenumber, l_partkey, dms_score,
       (round(({AVG_RANK_SQL.format(g='dms_id', v='dms_score')}) * 1e6) / 1e6 + 0.0) as rank_score
from v_pred""", "v_pred"))
def q_avg_rank(spark, d):
    p = V.v_pred(spark, d).select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "dms_score")
    return R.avg_rank(p, "dms_id", "dms_score", out="rank_score")


# --------------------------------------------------------------- W2
@query("normalize_scores", with_views(f"""
select p.dms_id, l_orderkey, l_linenumber, l_partkey, dms_score,
       (round((case when s.mx - s.mn < 1e-8 then 0.5 else (dms_score - s.mn) / (s.mx - s.mn) end) * 1e6) / 1e6 + 0.0) as norm_minmax,
       (round((case when s.sd < 1e-8 then 0.0 else (dms_score - s.mu) / s.sd end) * 1e6) / 1e6 + 0.0) as norm_zscore,
       (round(({AVG_RANK_SQL.format(g='p.dms_id', v='dms_score')} / s.n) * 1e6) / 1e6 + 0.0) as norm_rank
from v_pred p join (select dms_id, min(dms_score) as mn, max(dms_score) as mx, avg(dms_score) as mu,
                           stddev_pop(dms_score) as sd, count(*) as n from v_pred group by dms_id) s
  on s.dms_id = p.dms_id""", "v_pred"))
def q_normalize_scores(spark, d):
    p = V.v_pred(spark, d).select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "dms_score")
    x = R.normalize_scores(p, "dms_id", "dms_score", "minmax", "norm_minmax")
    x = R.normalize_scores(x, "dms_id", "dms_score", "zscore", "norm_zscore")
    return R.normalize_scores(x, "dms_id", "dms_score", "rank", "norm_rank")


# --------------------------------------------------------------- A2 / A2p
@query("spearman_by_group", with_views(
    f"select dms_id, n_variants, (round((spearman) * 1e6) / 1e6 + 0.0) as spearman from ({_spearman_sql('v_pred', 'dms_id', 'dms_score', 'pred')}) s",
    "v_pred"))
def q_spearman(spark, d):
    return R.spearman_by_group(V.v_pred(spark, d), "dms_id", "dms_score", "pred")


@query("spearman_pvalue", with_views(f"""
select s.dms_id, s.n_variants, (round((s.spearman) * 1e6) / 1e6 + 0.0) as spearman, (round((p.spearman_pval) * 1e6) / 1e6 + 0.0) as spearman_pval
from spr s join ({_pval_sql('spr', 'dms_id')}) p on p.dms_id = s.dms_id""",
    "v_pred", extra=[("spr", _spearman_sql("v_pred", "dms_id", "dms_score", "pred"))]))
def q_spearman_pvalue(spark, d):
    return R.spearman_pvalue(R.spearman_by_group(V.v_pred(spark, d), "dms_id", "dms_score", "pred"))


# --------------------------------------------------------------- A3 / A4 / A5
@query("ndcg_by_group", with_views(
    f"select dms_id, (round((ndcg) * 1e6) / 1e6 + 0.0) as ndcg, (round((ndcg_10) * 1e6) / 1e6 + 0.0) as ndcg_10 from ({_ndcg_sql('v_pred', 'dms_id', 'dms_score', 'pred', LINE_KEY_SQL)}) q",
    "v_pred", extra=[_ndcg_pos_cte("v_pred", "dms_id", "dms_score", "pred", LINE_KEY_SQL)]))
def q_ndcg(spark, d):
    return R.ndcg_by_group(V.v_pred(spark, d), "dms_id", "dms_score", "pred", K_FRACTION)


@query("topk_recall", with_views(
    f"select dms_id, (round((top_10_recall) * 1e6) / 1e6 + 0.0) as top_10_recall from ({_topk_sql('dms_id')}) q",
    "v_pred", extra=[_ndcg_pos_cte("v_pred", "dms_id", "dms_score", "pred", LINE_KEY_SQL)]))
def q_topk_recall(spark, d):
    return R.topk_recall(V.v_pred(spark, d), "dms_id", "dms_score", "pred", KEY, K_FRACTION)


@query("auc_by_group", with_views(
    f"select dms_id, (round((auc) * 1e6) / 1e6 + 0.0) as auc from ({_auc_sql('v_pred', 'dms_id', 'dms_score_bin', 'pred')}) q",
    "v_pred"))
def q_auc(spark, d):
    return R.auc_by_group(V.v_pred(spark, d), "dms_id", "dms_score_bin", "pred")


# --------------------------------------------------------------- A1
@query("assay_metrics", with_views(f"""
select s.dms_id, s.n_variants, (round((s.spearman) * 1e6) / 1e6 + 0.0) as spearman, (round((pv.spearman_pval) * 1e6) / 1e6 + 0.0) as spearman_pval,
       (round((n.ndcg) * 1e6) / 1e6 + 0.0) as ndcg,
       (round((n.ndcg_10) * 1e6) / 1e6 + 0.0) as ndcg_10, (round((t.top_10_recall) * 1e6) / 1e6 + 0.0) as top_10_recall, (round((a.auc) * 1e6) / 1e6 + 0.0) as auc
from spr s left join ({_pval_sql('spr', 'dms_id')}) pv on pv.dms_id = s.dms_id
left join ({_ndcg_sql('v_pred', 'dms_id', 'dms_score', 'pred', LINE_KEY_SQL)}) n on n.dms_id = s.dms_id
left join ({_topk_sql('dms_id')}) t on t.dms_id = s.dms_id
left join ({_auc_sql('v_pred', 'dms_id', 'dms_score_bin', 'pred')}) a on a.dms_id = s.dms_id""",
    "v_pred", extra=[("spr", _spearman_sql("v_pred", "dms_id", "dms_score", "pred")),
                     _ndcg_pos_cte("v_pred", "dms_id", "dms_score", "pred", LINE_KEY_SQL)]))
def q_assay_metrics(spark, d):
    return R.assay_metrics(V.v_pred(spark, d), "dms_id", "dms_score", "pred", "dms_score_bin", KEY, K_FRACTION)


# --------------------------------------------------------------- A6 (flagship)
def _matrix_sql() -> str:
    cols = ",\n       ".join(
        f"(round((avg(case when category = '{c}' then spearman end)) * 1e6) / 1e6 + 0.0) as {c.lower()}" for c in MODEL_CATEGORIES)
    sp = _spearman_sql("v_model_pred", "model, dms_id, category", "y", "pred")
    return with_views(f"select model,\n       {cols}\nfrom ({sp}) s group by model", "v_model_pred")


@query("cross_property_matrix", _matrix_sql())
def q_cross_property_matrix(spark, d):
    items, models, columns = V.v_model_items(spark, d)
    return R.cross_property_matrix_shared(items, MODEL_CATEGORIES, models, columns)


# --------------------------------------------------------------- O2
@query("topk_items", with_views(f"""
select dms_id, l_orderkey, l_linenumber, l_partkey, (round((pred) * 1e6) / 1e6 + 0.0) as pred, cast(rn as int) as rn
from (select dms_id, l_orderkey, l_linenumber, l_partkey, pred,
             row_number() over (partition by dms_id order by pred desc, {LINE_KEY_SQL}) as rn from v_pred) q
where rn <= 5""", "v_pred"))
def q_topk_items(spark, d):
    x = R.topk_items(V.v_pred(spark, d), "dms_id", "pred", KEY, k=5)
    return x.select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "pred", "rn")


# --------------------------------------------------------------- A5 on documents x labels
@query("auc_documents", with_views(
    f"select lang, (round((auc) * 1e6) / 1e6 + 0.0) as auc from ({_auc_sql('dl', 'lang', 'quality', 'n_chars')}) q",
    extra=[("dl", "select d.lang, d.n_chars, l.quality from documents d join labels l on l.doc_id = d.doc_id")]))
def q_auc_documents(spark, d):
    """A5 on the labelled documents: how well text length ranks the quality label, per language."""
    from gradus.sources.tables import table
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return R.auc_by_group(docs.join(lab, "doc_id"), "lang", "quality", "n_chars")
