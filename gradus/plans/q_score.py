"""Query bindings of scoring, resume logic and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import score as S
from gradus.operators import setops as U
from gradus.plans import views as V
from gradus.plans.oracle_views import r6, with_views
from gradus.plans.q_rank import _spearman_sql
from gradus.plans.registry import query
from gradus.sources.scratch import written
from gradus.sources.tables import table

AMINO = S.AMINO

# --------------------------------------------------------------- oracle pieces
LOGP_CTES = [
    ("lp_a", "select vec_id, idx, v, max(v) over (partition by vec_id) as m from v_vec"),
    ("lp_b", "select vec_id, idx, v, m, sum(exp(v - m)) over (partition by vec_id) as s from lp_a"),
    ("lp", "select vec_id as pos, idx, v - (m + ln(s)) as logp from lp_b"),
]
PARSE_SQL = """list_transform(list_filter(list_transform(string_split(mutant, ':'),
             lambda x: {'wt': substr(x, 1, 1),
                        'd': regexp_replace(substr(x, 2, greatest(length(x) - 2, 0)), '[^0-9]', '', 'g'),
                        'mut': right(x, 1)}), lambda s: s.d <> ''),
             lambda s: {'wt': s.wt, 'pos': cast(s.d as bigint) - 1, 'mut': s.mut})"""
TERMS_CTES = [
    ("mt", f"select item, unnest(m) as s, cast(generate_subscripts(m, 1) - 1 as int) as k "
           f"from (select item, {PARSE_SQL} as m from v_mutant) q"),
    ("terms", "select v.item, t.k, t.s.wt as wt, t.s.pos as pos, t.s.mut as mut "
              "from v_mutant v left join mt t on t.item = v.item"),
]
TOK = "case when length({c}) = 1 then instr('" + AMINO + "', {c}) - 1 else -1 end"
SCORE_BODY = f"""
select t.item, coalesce(sum(coalesce(lm.logp - lw.logp, 0.0)), 0.0) as zero_shot_score,
       count(t.pos) as n_mutations,
       sum(case when t.pos is not null and (lm.logp is null or lw.logp is null) then 1 else 0 end)::bigint as n_skipped
from terms t
left join lp lw on lw.pos = t.pos and lw.idx = {TOK.format(c='t.wt')}
left join lp lm on lm.pos = t.pos and lm.idx = {TOK.format(c='t.mut')}
group by t.item"""
SCORE_CTES = LOGP_CTES + TERMS_CTES + [("scores", SCORE_BODY)]


def logp(spark, d):
    return S.logp_table(table(spark, d, "embeddings"), "vec_id", "embedding")


def scores(spark, d):
    return S.zero_shot_score(V.v_mutant(spark, d), logp(spark, d))


# --------------------------------------------------------------- P9
@query("log_softmax", with_views(f"select pos as vec_id, idx, {r6('logp')} as logp from lp", "v_vec",
                                 extra=LOGP_CTES))
def q_log_softmax(spark, d):
    return logp(spark, d).select(F.col("pos").alias("vec_id"), F.posexplode("logp").alias("idx", "logp"))


# --------------------------------------------------------------- J3 / G6 / G7 / J5
@query("score_lookup", with_views(f"""
select t.item, t.k, t.pos, {r6('lw.logp')} as lp_wt, {r6('lm.logp')} as lp_mut
from mt m0 join terms t on t.item = m0.item and t.k = m0.k
left join lp lw on lw.pos = t.pos and lw.idx = {TOK.format(c='t.wt')}
left join lp lm on lm.pos = t.pos and lm.idx = {TOK.format(c='t.mut')}""", "v_mutant", "v_vec",
    extra=LOGP_CTES + TERMS_CTES))
def q_score_lookup(spark, d):
    from gradus.functions import parsing
    terms = V.v_mutant(spark, d).select("item", F.posexplode(parsing.parse_mutations(F.col("mutant"))).alias("k", "t")) \
        .select("item", "k", F.col("t.wt").alias("wt"), F.col("t.pos").alias("pos"), F.col("t.mut").alias("mut"))
    return S.score_lookup(terms, logp(spark, d)).select("item", "k", "pos", "lp_wt", "lp_mut")


# tokens with letters outside the alphabet (J, X, Z, *) and positions past the table
ODD_TOKENS_SQL = ("odd_tokens", """
select l_orderkey as item, l_linenumber as k, substr('ACDEFGHIKLMNPQRSTVWYXZJ*', cast(l_suppkey % 24 as int) + 1, 1) as wt,
       cast(l_quantity as bigint) * 20 - 1 as pos, substr('ACDEFGHIKLMNPQRSTVWYXZJ*', cast(l_partkey % 24 as int) + 1, 1) as mut
from lineitem""")


@query("score_lookup_unknown", with_views(f"""
select t.item, t.k, t.pos, t.wt, t.mut, {r6('lw.logp')} as lp_wt, {r6('lm.logp')} as lp_mut from odd_tokens t
left join lp lw on lw.pos = t.pos and lw.idx = {TOK.format(c='t.wt')}
left join lp lm on lm.pos = t.pos and lm.idx = {TOK.format(c='t.mut')}""", "v_vec", extra=LOGP_CTES + [ODD_TOKENS_SQL]))
def q_score_lookup_unknown(spark, d):
    """J3 where letters are unknown and positions lie outside the table: NULL, not an error."""
    letters = F.lit("ACDEFGHIKLMNPQRSTVWYXZJ*")
    li = table(spark, d, "lineitem")
    terms = li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("k"),
                      F.substring(letters, (F.col("l_suppkey") % 24).cast("int") + 1, 1).alias("wt"),
                      (F.col("l_quantity").cast("long") * 20 - 1).alias("pos"),
                      F.substring(letters, (F.col("l_partkey") % 24).cast("int") + 1, 1).alias("mut"))
    return S.score_lookup(terms, logp(spark, d)).select("item", "k", "pos", "wt", "mut", "lp_wt", "lp_mut")


@query("zero_shot_score", with_views(
    f"select item, {r6('zero_shot_score')} as zero_shot_score, n_mutations, n_skipped from scores",
    "v_mutant", "v_vec", extra=SCORE_CTES))
def q_zero_shot_score(spark, d):
    return scores(spark, d)


def _orders_scored(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("dms_id"),
                                         F.col("o_totalprice").alias("dms_score"))
    # few large groups: their rows are counted and sorted, so they are computed once
    return written(o.join(scores(spark, d), "item").select("dms_id", "dms_score", "zero_shot_score"), "scored")


ORDERS_SCORED = ("orders_scored", "select o.o_orderpriority as dms_id, o.o_totalprice as dms_score, s.zero_shot_score "
                                  "from orders o join scores s on s.item = o.o_orderkey")


@query("zero_shot_summary", with_views(
    f"select dms_id, n_variants, {r6('spearman')} as spearman from ({_spearman_sql('orders_scored', 'dms_id', 'dms_score', 'zero_shot_score')}) q",
    "v_mutant", "v_vec", extra=SCORE_CTES + [ORDERS_SCORED]))
def q_zero_shot_summary(spark, d):
    return S.zero_shot_summary(_orders_scored(spark, d), "dms_id", "dms_score")


@query("zero_shot_mean", with_views(
    f"select count(*) as n_assays, {r6('avg(spearman)')} as mean_spearman from ({_spearman_sql('orders_scored', 'dms_id', 'dms_score', 'zero_shot_score')}) q",
    "v_mutant", "v_vec", extra=SCORE_CTES + [ORDERS_SCORED]))
def q_zero_shot_mean(spark, d):
    s = S.zero_shot_summary(_orders_scored(spark, d), "dms_id", "dms_score")
    return s.agg(F.count(F.lit(1)).alias("n_assays"), F.avg("spearman").alias("mean_spearman"))


@query("zero_shot_attach", with_views(
    f"select dms_id, n_variants, {r6('spearman')} as spearman from ({_spearman_sql('attached', 'dms_id', 'dms_score', 'zero_shot_score')}) q",
    "v_mutant", "v_vec", "v_pred",
    extra=SCORE_CTES + [("attached", "select p.dms_id, p.dms_score, s.zero_shot_score from v_pred p "
                                     "join scores s on s.item = p.l_orderkey")]))
def q_zero_shot_attach(spark, d):
    rows = V.v_pred(spark, d).select("dms_id", F.col("l_orderkey").alias("item"), "dms_score")
    j = S.zero_shot_attach(rows, scores(spark, d), "item")
    return S.zero_shot_summary(j, "dms_id", "dms_score")


# --------------------------------------------------------------- J4 / O1
def _pending(spark, d):
    li = table(spark, d, "lineitem")
    totals = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("total"))
    expected = table(spark, d, "orders").select("o_orderkey").join(totals, "o_orderkey", "left") \
        .withColumn("total", F.coalesce(F.col("total"), F.lit(0)))
    done = li.filter(F.col("l_linestatus") == "F").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.remaining_work(expected, done, "o_orderkey", "total")


PENDING_SQL = """
select o.o_orderkey, coalesce(t.total, 0) as total, coalesce(dn.done, 0) as done,
       greatest(0, coalesce(t.total, 0) - coalesce(dn.done, 0)) as remaining
from orders o
left join (select l_orderkey, count(*) as total from lineitem group by 1) t on t.l_orderkey = o.o_orderkey
left join (select l_orderkey, count(*) as done from lineitem where l_linestatus = 'F' group by 1) dn
  on dn.l_orderkey = o.o_orderkey
where greatest(0, coalesce(t.total, 0) - coalesce(dn.done, 0)) > 0"""


@query("remaining_work", PENDING_SQL.strip())
def q_remaining_work(spark, d):
    return _pending(spark, d).select("o_orderkey", "total", "done", "remaining")


@query("smallest_remaining_first", f"select * from ({PENDING_SQL}) q order by remaining, o_orderkey limit 5")
def q_smallest_remaining_first(spark, d):
    return S.smallest_remaining_first(_pending(spark, d).select("o_orderkey", "total", "done", "remaining"),
                                      "o_orderkey", 5)


# --------------------------------------------------------------- S3 / U2 / U3
@query("manifest_check", """
select count(distinct d.doc_id) as expected_count,
       count(distinct case when l.doc_id is not null then d.doc_id end) as found_count,
       count(distinct case when l.doc_id is null then d.doc_id end) as n_missing,
       count(distinct case when l.doc_id is null then d.doc_id end) = 0 as all_found,
       (select count(distinct doc_id) from labels where doc_id not in (select doc_id from documents)) as n_unexpected
from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id""")
def q_manifest_check(spark, d):
    return U.manifest_check(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"),
                            "doc_id")


@query("set_missing", "select doc_id from documents except select doc_id from labels")
def q_set_missing(spark, d):
    return U.set_missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"))


@query("resume_union", with_views("""
select dms_id, l_orderkey, l_linenumber, l_partkey, dms_score from v_pred where l_shipdate < timestamp '1995-06-17'
union all
select dms_id, l_orderkey, l_linenumber, l_partkey, dms_score from v_pred where l_shipdate >= timestamp '1995-06-17'""",
                                  "v_pred"))
def q_resume_union(spark, d):
    p = V.v_pred(spark, d).select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "dms_score", "l_shipdate")
    cut = F.lit("1995-06-17 00:00:00").cast("timestamp_ntz")
    prior = p.filter(F.col("l_shipdate") < cut).drop("l_shipdate")
    new = p.filter(F.col("l_shipdate") >= cut).drop("l_shipdate")
    return U.resume_union(prior, new)


# --------------------------------------------------------------- P12 / P11
def _mean_pool_sql(use: str) -> str:
    return (f"select v.label, v.idx, {r6(f'sum(case when {use} then v.v else 0.0 end) / greatest(sum(case when {use} then 1 else 0 end), 1e-8)')} as v "
            "from v_vec v join (select label, min(vec_id) as first from embeddings group by label) f on f.label = v.label group by v.label, v.idx")


@query("mean_pool", with_views(_mean_pool_sql("v.vec_id > f.first"), "v_vec"))
def q_mean_pool(spark, d):
    return S.mean_pool(V.v_vec(spark, d), "label", "vec_id")


@query("mean_pool_masked", with_views(_mean_pool_sql("v.vec_id > f.first and v.vec_id % 3 <> 0"), "v_vec"))
def q_mean_pool_masked(spark, d):
    """P12 with a mask that also covers the first position of some groups."""
    vec = V.v_vec(spark, d).withColumn("mask", F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1))
    return S.mean_pool(vec, "label", "vec_id", mask="mask")


@query("cls_pool", with_views(f"select label, idx, {r6('arg_min(v, vec_id)')} as v from v_vec group by label, idx",
                              "v_vec"))
def q_cls_pool(spark, d):
    return S.cls_pool(V.v_vec(spark, d), "label", "vec_id")


def _head_sql(dim: int, hidden: int) -> str:
    """The ranking head of ``head_weights`` / ``head_forward`` written out: weights from their rule."""
    t = f"(1 / (1 + {S.ERF_P}::double * abs(z / sqrt(2.0::double))))"
    poly = t + " * (" + f" + {t} * (".join(f"{a}::double" for a in S.ERF_A) + ")" * len(S.ERF_A)
    erf = f"sign(z) * (1 - ({poly}) * exp(-z * z / 2))"
    return f"""
with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
h as (select vec_id, j, sum(x * sin((i + 1) * (j + 7) * 0.37::double) / sqrt({dim}::double)) + cos(j * 0.11::double) * 0.01::double as z
      from e, (select unnest(range(0, {hidden})) as j) u group by vec_id, j),
g as (select vec_id, j, 0.5::double * z * (1 + {erf}) as g from h),
m as (select vec_id, avg(g) as mu, var_pop(g) as va from g group by vec_id)
select g.vec_id, {r6(f"sum(((g - mu) / sqrt(va + 1e-5) * (1 + 0.1::double * sin(j)) + 0.05::double * cos(j)) * cos((j + 7) * 0.53::double) / sqrt({hidden}::double)) + 0.1::double")} as score
from g join m on m.vec_id = g.vec_id group by g.vec_id"""


@query("head_score", _head_sql(64, 32).strip())
def q_head_score(spark, d):
    """The ranking head over Arrow batches of the 64-d embeddings."""
    e = table(spark, d, "embeddings")
    return S.head_score(e, "embedding", "vec_id", S.head_weights(64, 32))


# --------------------------------------------------------------- A6 with the zero-shot row
def _line_zero_shot(spark, d):
    """Zero-shot prediction per lineitem: the score of its one-mutation token."""
    from gradus.functions import parsing
    from gradus.plans.views import LINE_KEY
    li = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", "p_type")
    aa = F.lit(AMINO)
    tok = F.concat(F.substring(aa, (F.col("l_suppkey") % 20).cast("int") + 1, 1),
                   F.col("l_quantity").cast("int").cast("string"),
                   F.substring(aa, (F.col("l_partkey") % 20).cast("int") + 1, 1))
    x = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("dms_id"), F.col("p_type").alias("category"), F.col("l_extendedprice").alias("y"),
        *LINE_KEY, F.element_at(parsing.parse_mutations(tok), 1).alias("t"))
    x = x.select("*", F.col("t.pos").alias("pos"), F.col("t.wt").alias("wt"), F.col("t.mut").alias("mut")).drop("t")
    j = x.join(S.used_positions(logp(spark, d), x, ["pos"]), "pos", "left")
    d_ = S.element_or_null(F.col("logp"), S.token_index(F.col("mut"))) - S.element_or_null(F.col("logp"), S.token_index(F.col("wt")))
    return j.select(F.lit("zero_shot").alias("model"), "dms_id", "category", "y",
                    F.coalesce(d_, F.lit(0.0)).alias("pred"), *LINE_KEY)


ZS_SQL = f"""select 'zero_shot' as model, l.l_partkey as dms_id, p.p_type as category, l.l_extendedprice as y,
                    coalesce(lm.logp - lw.logp, 0.0) as pred
             from (select *, concat(substr('{AMINO}', cast(l_suppkey % 20 as int) + 1, 1),
                                     cast(cast(l_quantity as int) as varchar),
                                     substr('{AMINO}', cast(l_partkey % 20 as int) + 1, 1)) as tok from lineitem) l
             join part p on p.p_partkey = l.l_partkey
             left join lp lw on lw.pos = cast(regexp_replace(substr(l.tok, 2, greatest(length(l.tok) - 2, 0)), '[^0-9]', '', 'g') as bigint) - 1
                            and lw.idx = {TOK.format(c='substr(l.tok, 1, 1)')}
             left join lp lm on lm.pos = cast(regexp_replace(substr(l.tok, 2, greatest(length(l.tok) - 2, 0)), '[^0-9]', '', 'g') as bigint) - 1
                            and lm.idx = {TOK.format(c='right(l.tok, 1)')}"""
ALL_PRED_CTES = LOGP_CTES + [("zs", ZS_SQL), ("allp", "select model, dms_id, category, y, pred from v_model_pred union all select * from zs")]


def zero_shot_rows(spark, d):
    """The zero-shot prediction per variant, written: the ranks read it twice."""
    return written(_line_zero_shot(spark, d).select("model", "dms_id", "category", "y", "pred"), "zero-shot")


def _matrix_zs_sql() -> str:
    from gradus.plans.q_rank import MODEL_CATEGORIES
    cols = ",\n       ".join(f"{r6(f'avg(case when category = {chr(39)}{c}{chr(39)} then spearman end)')} as {c.lower()}"
                             for c in MODEL_CATEGORIES)
    sp = _spearman_sql("allp", "model, dms_id, category", "y", "pred")
    return with_views(f"select model,\n       {cols}\nfrom ({sp}) s group by model", "v_model_pred", "v_vec",
                      extra=ALL_PRED_CTES)


@query("cross_property_matrix_zero_shot", _matrix_zs_sql())
def q_cross_property_matrix_zero_shot(spark, d):
    """A6 with the zero-shot row: the three models plus per-variant zero-shot scores."""
    from gradus.operators import rank as R
    from gradus.plans.q_rank import MODEL_CATEGORIES
    items, models, columns = V.v_model_items(spark, d)
    return R.cross_property_matrix_shared(items, MODEL_CATEGORIES, models, columns) \
        .unionByName(R.cross_property_matrix(zero_shot_rows(spark, d), MODEL_CATEGORIES))
