"""Query bindings of the weight-vector algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import rank as R
from gradus.operators import vectors as VX
from gradus.plans import views as V
from gradus.plans.oracle_views import r6, with_views
from gradus.plans.q_rank import _spearman_sql
from gradus.plans.registry import query
from gradus.sources.tables import table

COEF = {0: 1.0, 1: -1.0, 2: 0.5, 3: 0.25}
GRID = [0.0, 0.5, 1.0]
FRACTIONS = [0.1, 0.25, 0.5, 1.0]

DELTA_CTE = ("delta", """select b.property, b.prefix, b.r, a.c, sum(b.v * a.v) as v
                         from v_lowrank b join v_lowrank a on a.property = b.property and a.prefix = b.prefix
                           and a.matrix = 'A' and b.matrix = 'B' and a.r = b.c
                         group by b.property, b.prefix, b.r, a.c""")


def _cos_sql(dots: str) -> str:
    return f"""
with dots as ({dots}),
nrm as (select p1 as p, sqrt(dot) as n from dots where p1 = p2),
up as (select d.p1, d.p2, d.dot / (greatest(a.n, 1e-8) * greatest(b.n, 1e-8)) as cosine
       from dots d join nrm a on a.p = d.p1 join nrm b on b.p = d.p2)
select p1, p2, {r6('cosine')} as cosine from up
union all select p2 as p1, p1 as p2, {r6('cosine')} as cosine from up where p1 <> p2"""


TAU_DOTS = "select x.property as p1, y.property as p2, sum(x.v * y.v) as dot from v_tau x join v_tau y " \
           "on x.idx = y.idx and x.property <= y.property group by 1, 2"
DELTA_DOTS = "select x.property as p1, y.property as p2, sum(x.v * y.v) as dot from delta x join delta y " \
             "on x.prefix = y.prefix and x.r = y.r and x.c = y.c and x.property <= y.property group by 1, 2"


def _nest(sql: str, *views: str, extra=None) -> str:
    """Put a statement that starts with its own WITH under the view CTEs."""
    body = sql.strip()
    return with_views("", *views, extra=extra).rstrip() + ",\n" + body[len("with "):]


@query("task_vector", with_views(f"select property, idx, {r6('v')} as v from v_tau", "v_tau"))
def q_task_vector(spark, d):
    vec = V.v_vec(spark, d)
    cls = vec.groupBy(F.col("label").alias("property"), "idx").agg(F.avg("v").alias("v"))
    glob = vec.groupBy("idx").agg(F.avg("v").alias("v"))
    return VX.task_vector(cls, glob, ["idx"]).select("property", "idx", "v")


@query("vector_summary", with_views(f"""
select property, count(*) as n_params, {r6('sqrt(sum(v * v))')} as l2_norm, count(distinct prefix) as n_layers
from v_lowrank group by property""", "v_lowrank"))
def q_vector_summary(spark, d):
    return VX.vector_summary(V.v_lowrank(spark, d), "property", "v", layer="prefix")


@query("weights_pair", with_views("""
select coalesce(a.property, b.property) as property, coalesce(a.prefix, b.prefix) as prefix,
       case when a.property is not null and b.property is not null then 'complete'
            when a.property is not null then 'missing_B' else 'missing_A' end as status
from (select distinct property, prefix from v_lowrank where matrix = 'A') a
full join (select distinct property, prefix from v_lowrank where matrix = 'B') b
  on a.property = b.property and a.prefix = b.prefix""", "v_lowrank"))
def q_weights_pair(spark, d):
    return VX.weights_pair(V.v_lowrank(spark, d))


@query("materialize_delta", with_views(f"select property, prefix, r, c, {r6('v')} as v from delta", "v_lowrank",
                                       extra=[DELTA_CTE]))
def q_materialize_delta(spark, d):
    blocks = VX.materialize_delta(V.v_lowrank(spark, d))
    return VX.explode_blocks(blocks, ["property", "prefix"]).select("property", "prefix", "r", "c", "v")


def _coef_sql() -> str:
    return " union all ".join(f"select {k} as property, {v}::double as alpha" for k, v in COEF.items())


@query("compose", with_views(f"""
select d.prefix, d.r, d.c, {r6('sum(k.alpha * d.v)')} as v
from delta d join ({_coef_sql()}) k on k.property = d.property
where d.prefix in (select prefix from v_lowrank where property = (select min(property) from v_lowrank))
group by d.prefix, d.r, d.c""", "v_lowrank", extra=[DELTA_CTE]))
def q_compose(spark, d):
    return VX.compose(V.v_lowrank(spark, d), COEF).select("prefix", "r", "c", "v")


@query("delta_norm_factored", with_views(
    f"select property, prefix, {r6('sqrt(sum(v * v))')} as frob_norm from delta group by property, prefix",
    "v_lowrank", extra=[DELTA_CTE]))
def q_delta_norm(spark, d):
    return VX.delta_norm_factored(V.v_lowrank(spark, d))


@query("cosine_matrix", _nest(_cos_sql(TAU_DOTS), "v_tau"))
def q_cosine_matrix(spark, d):
    return VX.cosine_matrix(V.v_tau(spark, d), "property", ["idx"])


@query("delta_cosine_factored", _nest(_cos_sql(DELTA_DOTS), "v_lowrank", extra=[DELTA_CTE]))
def q_delta_cosine(spark, d):
    return VX.delta_cosine_factored(V.v_lowrank(spark, d))


# base weights: one per even layer, the mean of all factors of the layer; adapters lack B in
# layers divisible by 7 and A in those divisible by 11
BASE_CTE = ("base", """select concat('encoder.layer.', cast(prefix as varchar), '.weight') as name, r, c, avg(v) as v
                      from v_lowrank where prefix % 2 = 0 group by prefix, r, c""")
GAPPY_CTE = ("gappy", """select * from v_lowrank where not (matrix = 'B' and prefix % 7 = 0) and not (matrix = 'A' and prefix % 11 = 0)""")
GAPPY_DELTA_CTE = ("gdelta", """select a.property, a.prefix, b.r, a.c, sum(b.v * a.v) as v
                               from gappy b join gappy a on a.property = b.property and a.prefix = b.prefix and a.r = b.c
                               where b.matrix = 'B' and a.matrix = 'A' group by a.property, a.prefix, b.r, a.c""")
NAME_SQL = "concat('encoder.layer.', cast(prefix as varchar), '.weight')"


def _applied(spark, d):
    lr = V.v_lowrank(spark, d)
    base = lr.where("prefix % 2 = 0").groupBy("prefix", "r", "c").agg(F.avg("v").alias("v")) \
        .select(F.concat(F.lit("encoder.layer."), F.col("prefix").cast("string"), F.lit(".weight")).alias("name"), "r", "c", "v")
    gappy = lr.where("not (matrix = 'B' and prefix % 7 = 0) and not (matrix = 'A' and prefix % 11 = 0)") \
        .withColumn("prefix", F.concat(F.lit("base_model.model.encoder.layer."), F.col("prefix").cast("string")))
    return VX.weights_apply(base, gappy, 0.5)


@query("weights_apply", with_views(f"""
select d.property, b.name, b.r, b.c, {r6('b.v + 0.5 * d.v')} as v
from base b join (select *, {NAME_SQL} as name from gdelta) d on d.name = b.name and d.r = b.r and d.c = b.c""",
                                   "v_lowrank", extra=[BASE_CTE, GAPPY_CTE, GAPPY_DELTA_CTE]))
def q_weights_apply(spark, d):
    """J10 over all properties and layers."""
    return _applied(spark, d)[0].select("property", "name", "r", "c", "v")


@query("weights_apply_unmatched", with_views(f"""
select property, name, status from (
  select property, {NAME_SQL} as name, case when max(case when matrix = 'A' then 1 else 0 end) = 0 then 'missing_A'
         when max(case when matrix = 'B' then 1 else 0 end) = 0 then 'missing_B'
         when {NAME_SQL} not in (select name from base) then 'unmatched' else 'ok' end as status
  from gappy group by property, prefix) q where status <> 'ok'""", "v_lowrank", extra=[BASE_CTE, GAPPY_CTE]))
def q_weights_apply_unmatched(spark, d):
    """Incomplete factor pairs and complete ones without a base weight."""
    return _applied(spark, d)[1].select("property", "name", "status")


# --------------------------------------------------------------- V8-V13, A12
MP_KEY = "dms_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"


@query("ensemble_predictions", with_views(
    f"select dms_id, n_variants, {r6('spearman')} as spearman from ({_spearman_sql('ens', 'dms_id', 'y', 'pred')}) q",
    "v_model_pred", extra=[("ens", f"select {MP_KEY}, max(y) as y, round(avg(pred) * 1e9) / 1e9 as pred "
                                  f"from v_model_pred group by {MP_KEY}")]))
def q_ensemble(spark, d):
    mp = V.v_model_pred(spark, d)
    key = ["dms_id", *V.LINE_KEY]
    ens = VX.ensemble_predictions(mp, key, "pred", F.max("y").alias("y"))
    # averages are fixed to 9 decimals so that equal predictions stay tied whatever the summation order
    ens = ens.withColumn("pred", F.round(F.col("pred") * F.lit(1e9), 0) / F.lit(1e9))
    return R.spearman_by_group(ens, "dms_id", "y", "pred")


@query("ties_merge", with_views(f"""
select i.idx, {r6('coalesce(m.v, 0.0)')} as v from (select distinct idx from v_tau) i left join (
  select k.idx, avg(k.v) as v from kept k join (select idx, sign(sum(v)) as s from kept group by idx) e
    on e.idx = k.idx and sign(k.v) = e.s group by k.idx) m on m.idx = i.idx""", "v_tau",
    extra=[("kept", """select property, idx, v from (
               select *, rank() over (partition by property order by abs(v) desc) - 1 as before,
                      count(*) over (partition by property) as n from v_tau) q
             where before < floor(n * 0.2::double)""")]))
def q_ties_merge(spark, d):
    return VX.ties_merge(V.v_tau(spark, d), 0.2)


@query("dare_merge", with_views(f"""
select i.idx, {r6('coalesce(m.v, 0.0)')} as v from (select distinct idx from v_tau) i left join (
  select idx, sum(v / 0.5) as v from v_tau
  where ('0x' || substr(md5(concat_ws('-', '42', cast(property as varchar), cast(idx as varchar))), 1, 15))::bigint::double
        / 1152921504606846976.0 >= 0.5
  group by idx) m on m.idx = i.idx""", "v_tau"))
def q_dare_merge(spark, d):
    return VX.dare_merge(V.v_tau(spark, d), 0.5, 42)


def _grid_sql() -> str:
    pts = " union all ".join(f"select {a}::double as a1, {b}::double as a2" for a in GRID for b in GRID)
    return f"""select g.a1, g.a2, l.l_partkey as dms_id, l.l_extendedprice as y,
                      g.a1 * l.l_quantity + g.a2 * l.l_discount as pred
               from lineitem l, ({pts}) g"""


@query("alpha_grid", with_views(
    f"select a1, a2, count(*) as n_assays, {r6('avg(spearman)')} as mean_spearman from "
    f"({_spearman_sql('grid', 'a1, a2, dms_id', 'y', 'pred')}) q group by a1, a2",
    extra=[("grid", _grid_sql())]))
def q_alpha_grid(spark, d):
    li = table(spark, d, "lineitem")
    x = li.select(F.col("l_partkey").alias("dms_id"), F.col("l_extendedprice").alias("y"), "l_quantity", "l_discount")
    points = F.array(*[F.struct(F.lit(a).alias("a1"), F.lit(b).alias("a2"),
                                (F.lit(a) * F.col("l_quantity") + F.lit(b) * F.col("l_discount")).alias("pred"))
                       for a in GRID for b in GRID])
    sp = R.spearman_by_model(x, "dms_id", "y", points, ["l_quantity", "l_discount"])
    return sp.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("n_assays"), F.avg("spearman").alias("mean_spearman"))


@query("layer_profile", with_views(f"""
select n.layer, n.n_properties, {r6('n.mean_norm')} as mean_norm, {r6('n.max_norm')} as max_norm, {r6('c.mean_cosine')} as mean_cosine
from (select prefix as layer, count(*) as n_properties, avg(n) as mean_norm, max(n) as max_norm from norms group by prefix) n
left join (select x.prefix as layer, avg(x.dot / (greatest(p.n, 1e-8) * greatest(q.n, 1e-8))) as mean_cosine
           from (select a.prefix, a.property as p1, b.property as p2, sum(a.v * b.v) as dot from delta a join delta b
                 on a.prefix = b.prefix and a.r = b.r and a.c = b.c and a.property < b.property group by 1, 2, 3) x
           join norms p on p.prefix = x.prefix and p.property = x.p1 join norms q on q.prefix = x.prefix and q.property = x.p2
           group by x.prefix) c on c.layer = n.layer""",
    "v_lowrank", extra=[DELTA_CTE, ("norms", "select property, prefix, sqrt(sum(v * v)) as n from delta group by property, prefix")]))
def q_layer_profile(spark, d):
    return VX.layer_profile(V.v_lowrank(spark, d))


@query("train_fraction_subset", with_views("""
select f.fraction, p.dms_id, count(*) as n_items
from v_pred p, (select unnest([0.1, 0.25, 0.5, 1.0]::double[]) as fraction) f
where ('0x' || substr(md5(concat_ws('-', '42', cast(p.l_orderkey as varchar), cast(p.l_linenumber as varchar),
        cast(p.l_partkey as varchar), cast(p.l_suppkey as varchar))), 1, 15))::bigint::double
      / 1152921504606846976.0 < f.fraction
group by f.fraction, p.dms_id""", "v_pred"))
def q_train_fraction_subset(spark, d):
    items = V.v_pred(spark, d).select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sub = VX.train_fraction_subset(items, FRACTIONS, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 42)
    return sub.groupBy("fraction", "dms_id").agg(F.count(F.lit(1)).alias("n_items"))


# the category that each model stands for, for the diagonal of the matrix
OWN_CATEGORY = {"quantity": "ECONOMY", "discount": "LARGE", "tax": "MEDIUM"}
OWN_SQL = "case model " + " ".join(f"when '{m}' then '{c}'" for m, c in OWN_CATEGORY.items()) + " end"


def _acceptance_sql() -> str:
    from gradus.plans.q_score import ALL_PRED_CTES
    sp = _spearman_sql("allp", "model, dms_id, category", "y", "pred")
    return _nest(f"""
with cosd as ({TAU_DOTS}),
nrm as (select p1 as p, sqrt(dot) as n from cosd where p1 = p2),
offd as (select max(d.dot / (greatest(a.n, 1e-8) * greatest(b.n, 1e-8))) as mx
         from cosd d join nrm a on a.p = d.p1 join nrm b on b.p = d.p2 where d.p1 <> d.p2),
cells as (select model, category, avg(spearman) as m from ({sp}) s group by model, category),
models as (select model, avg(m) as m from cells group by model),
gain as (select max(case when model <> 'zero_shot' then m end) - max(case when model = 'zero_shot' then m end) as g
         from models),
diag as (select min(lead) as d from (select model, max(case when category = {OWN_SQL} then m end) - max(case when category <> {OWN_SQL} then m end) as lead
                                     from cells where model <> 'zero_shot' group by model) z)
select 'nonzero_vectors' as check_name, {r6('(select min(n) from nrm)')} as value, (select min(n) from nrm) > 0 as ok
union all select 'max_offdiag_cosine', {r6('(select mx from offd)')}, (select mx from offd) < 0.9
union all select 'best_gain_over_zero_shot', {r6('(select g from gain)')}, (select g from gain) >= 0.05
union all select 'diagonal_dominance', {r6('(select d from diag)')}, (select d from diag) > 0""",
                 "v_tau", "v_model_pred", extra=ALL_PRED_CTES)


@query("acceptance_checks", _acceptance_sql())
def q_acceptance(spark, d):
    """Vectors aren't zero, no two properties' vectors are alike, the best model gains on the
    zero-shot row, and every model is best on its own category."""
    from gradus.plans.q_score import zero_shot_rows
    tau = V.v_tau(spark, d)
    norms = VX.vector_summary(tau)
    cos = VX.cosine_matrix(tau)
    # the items of the three models are moved and ranked by the measured score once
    items, models, columns = V.v_model_items(spark, d)
    sp = R.spearman_by_model(items, ["dms_id", "category"], "y", models, columns) \
        .unionByName(R.spearman_by_group(zero_shot_rows(spark, d), ["model", "dms_id", "category"], "y", "pred"))
    cells = sp.groupBy("model", "category").agg(F.avg("spearman").alias("m"))
    models = cells.groupBy("model").agg(F.avg("m").alias("m"))
    c1 = norms.agg(F.lit("nonzero_vectors").alias("check_name"), F.min("l2_norm").alias("value"))
    c2 = cos.filter(F.col("p1") != F.col("p2")).agg(F.lit("max_offdiag_cosine").alias("check_name"),
                                                   F.max("cosine").alias("value"))
    zero = F.col("model") == "zero_shot"
    c3 = models.agg(F.lit("best_gain_over_zero_shot").alias("check_name"),
                    (F.max(F.when(~zero, F.col("m"))) - F.max(F.when(zero, F.col("m")))).alias("value"))
    own = F.create_map(*[F.lit(x) for kv in OWN_CATEGORY.items() for x in kv])[F.col("model")]
    lead = cells.filter(~zero).groupBy("model").agg(
        (F.max(F.when(F.col("category") == own, F.col("m"))) - F.max(F.when(F.col("category") != own, F.col("m")))).alias("_lead"))
    c4 = lead.agg(F.lit("diagonal_dominance").alias("check_name"), F.min("_lead").alias("value"))
    out = c1.unionByName(c2).unionByName(c3).unionByName(c4)
    ok = F.when(F.col("check_name") == "nonzero_vectors", F.col("value") > 0) \
        .when(F.col("check_name") == "max_offdiag_cosine", F.col("value") < 0.9) \
        .when(F.col("check_name") == "diagonal_dominance", F.col("value") > 0) \
        .otherwise(F.col("value") >= 0.05)
    return out.select("check_name", "value", ok.alias("ok"))
