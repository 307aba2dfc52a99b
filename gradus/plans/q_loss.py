"""Query bindings of list-wise losses, list sampling and training-log analytics
(W3, W5-W8, J7, A8-A11, A13, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import log as LG
from gradus.operators import loss as L
from gradus.plans import views as V
from gradus.plans.oracle_views import r6, with_views
from gradus.plans.q_text import KW_CTES, T1_SQL, categorized
from gradus.plans.registry import query
from gradus.sources.tables import table

LIST_KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
LIST_KEY_SQL = ", ".join(LIST_KEY)
ITEM = ["l_orderkey", "l_linenumber", "l_suppkey"]
LIST_SIZE = 32
EPOCHS = 20
ACCUM = 8
PATIENCE = 5
LOG_EVERY = 10

SUFFIX_CTE = ("sfx", f"""select *, sum(exp(y_pred - mx) * valid) over (partition by list_id order by y_true desc, {LIST_KEY_SQL}
                                          rows between current row and unbounded following) as suffix
                        from (select *, max(y_pred) over (partition by list_id) as mx from v_list) a""")
LISTMLE_SQL = """select list_id, sum(valid)::bigint as n_valid,
                        sum((ln(suffix + 1e-10) - (y_pred - mx)) * valid) / greatest(sum(valid), 1)::double as loss
                 from sfx group by list_id"""
MSE_SQL = """select list_id, count(*) as n_valid, avg(power(y_pred - y_true, 2)) as loss
             from v_list where valid = 1 group by list_id"""
HINGE_SQL = """select l.list_id, coalesce(p.n_pairs, 0)::bigint as n_pairs, coalesce(p.loss, 0.0) as loss
               from (select distinct list_id from v_list) l left join (
                 select a.list_id, count(*) as n_pairs, avg(greatest(0.0, 1.0 - (a.y_pred - b.y_pred))) as loss
                 from v_list a join v_list b on a.list_id = b.list_id and a.y_true > b.y_true
                 group by a.list_id) p on p.list_id = l.list_id"""


def vlist(spark, d):
    return V.v_list(spark, d)


@query("suffix_logsumexp", with_views(
    f"select list_id, l_orderkey, l_linenumber, l_suppkey, {r6('suffix')} as suffix from sfx", "v_list",
    extra=[SUFFIX_CTE]))
def q_suffix_logsumexp(spark, d):
    x = L.suffix_logsumexp(vlist(spark, d), "list_id", "y_true", "y_pred", LIST_KEY, "valid")
    return x.select("list_id", "l_orderkey", "l_linenumber", "l_suppkey", "suffix")


@query("listmle_loss", with_views(f"select list_id, n_valid, {r6('loss')} as loss from ({LISTMLE_SQL}) q", "v_list",
                                  extra=[SUFFIX_CTE]))
def q_listmle(spark, d):
    return L.listmle_loss(vlist(spark, d), "list_id", "y_true", "y_pred", LIST_KEY, "valid")


@query("mse_loss", with_views(f"select list_id, n_valid, {r6('loss')} as loss from ({MSE_SQL}) q", "v_list"))
def q_mse(spark, d):
    return L.mse_loss(vlist(spark, d), "list_id", "y_true", "y_pred", "valid")


@query("pair_selfjoin", with_views(f"""
select a.list_id, count(*) as n_pairs, {r6('sum(a.y_true - b.y_true) * 100000')} as sum_true_gap_x1e5
from v_list a join v_list b on a.list_id = b.list_id and a.y_true > b.y_true group by a.list_id""", "v_list"))
def q_pair_selfjoin(spark, d):
    p = L.pair_selfjoin(vlist(spark, d), "list_id", "y_true", "y_pred", ITEM)
    return p.groupBy("list_id").agg(F.count(F.lit(1)).alias("n_pairs"),
                                    (F.sum(F.col("yt_i") - F.col("yt_j")) * 100000).alias("sum_true_gap_x1e5"))


@query("pairwise_hinge_loss", with_views(f"select list_id, n_pairs, {r6('loss')} as loss from ({HINGE_SQL}) q",
                                         "v_list"))
def q_hinge(spark, d):
    return L.pairwise_hinge_loss(vlist(spark, d), "list_id", "y_true", "y_pred", ITEM)


@query("loss_by_name", with_views(f"""
select 'listmle' as loss_name, {r6('avg(loss)')} as value, count(*) as n_lists from ({LISTMLE_SQL}) a
union all select 'mse', {r6('avg(loss)')}, count(*) from ({MSE_SQL}) b
union all select 'pairwise_hinge', {r6('avg(loss)')}, count(*) from ({HINGE_SQL}) c""", "v_list", extra=[SUFFIX_CTE]))
def q_loss_by_name(spark, d):
    v = vlist(spark, d)
    per = {"listmle": L.loss_by_name("listmle")(v, "list_id", "y_true", "y_pred", LIST_KEY, "valid"),
           "mse": L.loss_by_name("mse")(v, "list_id", "y_true", "y_pred", "valid"),
           "pairwise_hinge": L.loss_by_name("pairwise_hinge")(v, "list_id", "y_true", "y_pred", ITEM)}
    out = None
    for name, df in per.items():
        m = L.mean_over_lists(df, name)
        out = m if out is None else out.unionByName(m)
    return out


# --------------------------------------------------------------- A13 / W5 / P10
@query("split_sizes", with_views(f"""
select t.assigned_category as category, count(distinct t.dms_id) as n_assays, count(*) as total_variants,
       greatest(1, count(*) // {LIST_SIZE})::bigint as steps_per_epoch
from t1 t join lineitem l on l.l_partkey = t.dms_id where t.assigned_category <> 'excluded'
group by t.assigned_category""", "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_split_sizes(spark, d):
    t1 = categorized(spark, d).filter(F.col("assigned_category") != "excluded") \
        .select("dms_id", F.col("assigned_category").alias("category"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("dms_id"))
    return L.split_sizes(li.join(t1, "dms_id"), "category", LIST_SIZE)


def _steps_sql() -> str:
    return f"select unnest(range(0, greatest(1, count(*) // {LIST_SIZE}))) as step from lineitem"


W5_SQL = with_views(f"""
select s.step, s.dms_id, s.list_no, p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey
from w5_st3 s join w5_perm p on p.dms_id = s.dms_id and p.pos // {LIST_SIZE} = s.list_no""", "v_pred", extra=[
    ("w5_assays", "select dms_id, count(*) as n_items from v_pred group by dms_id"),
    ("w5_anum", "select dms_id, n_items, row_number() over (order by dms_id) - 1 as a_idx, "
                "count(*) over () as n_assays from w5_assays"),
    ("w5_steps", _steps_sql()),
    ("w5_st", "select s.step, (('0x' || substr(md5(concat_ws('-', '42', cast(s.step as varchar))), 1, 7))::bigint "
              "% a.n_assays) as a_idx from w5_steps s, (select max(n_assays) as n_assays from w5_anum) a"),
    ("w5_st2", "select st.step, an.dms_id, an.n_items, row_number() over (partition by an.dms_id order by st.step) - 1 as k "
               "from w5_st st join w5_anum an on an.a_idx = st.a_idx"),
    ("w5_st3", f"select step, dms_id, k % cast(ceil(n_items / {LIST_SIZE}.0) as bigint) as list_no from w5_st2"),
    ("w5_perm", "select dms_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by dms_id "
                "order by ('0x' || substr(md5(concat_ws('-', '42', '0', cast(dms_id as varchar), cast(l_orderkey as varchar), "
                "cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar))), 1, 15))::bigint) - 1 "
                "as pos from v_pred"),
])


@query("ranking_list_plan", W5_SQL)
def q_ranking_list_plan(spark, d):
    v = V.v_pred(spark, d).select("dms_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = v.count()  # one scalar action sizes the step range
    steps = spark.range(0, max(1, n // LIST_SIZE)).withColumnRenamed("id", "step")
    out = L.ranking_list_plan(v, steps, "dms_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                              LIST_SIZE, 42, 0)
    return out.select("step", "dms_id", "list_no", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("lr_schedule", f"""
with s as (select event_type as property, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as step,
                  count(*) over (partition by event_type) as total from events),
w as (select *, cast(floor(total * 0.1::double) as bigint) as warm from s)
select property, event_id, step, {r6('case when step < warm then step / greatest(1, warm)::double else greatest(0.0, 0.5 * (1.0 + cos(pi() * 2.0 * 0.5 * ((step - warm) / greatest(1, total - warm)::double)))) end')} as lr_mult
from w""")
def q_lr_schedule(spark, d):
    """The learning rate that each logged step ran with: the log's steps in order of time."""
    from gradus.functions.ranking import row_positions
    ev = table(spark, d, "events").select(F.col("event_type").alias("property"), "event_id",
                                          F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    x = row_positions(ev, "property", "_us", ["event_id"], "step").withColumn("step", F.col("step") - 1)
    return LG.lr_schedule(x, "property", "step").select("property", "event_id", "step", "lr_mult")


# --------------------------------------------------------------- W6 / W7 / W8
@query("best_epoch_early_stop", with_views(f"""
with x as (select *, max(val) over (partition by property order by epoch
                                    rows between unbounded preceding and 1 preceding) as prev from v_trainlog),
y as (select *, prev is null or val > prev as improved from x),
z as (select *, epoch - max(case when improved then epoch end) over (partition by property order by epoch
                                 rows between unbounded preceding and current row) as since from y),
st as (select property, min(case when since >= {PATIENCE} then epoch end) as stop_epoch from z group by property),
ran as (select z.*, st.stop_epoch from z join st on st.property = z.property
        where st.stop_epoch is null or z.epoch <= st.stop_epoch),
mx as (select property, max(val) as best_val, count(*) as epochs_run, min(stop_epoch) as stop_epoch from ran group by property)
select m.property, (select min(r.epoch) from ran r where r.property = m.property and r.val = m.best_val) as best_epoch,
       {r6('m.best_val')} as best_val, m.stop_epoch, m.epochs_run
from mx m""".replace("with x as", "x as"), "v_trainlog").replace("\nx as", ",\nx as", 1))
def q_best_epoch(spark, d):
    return LG.best_epoch_early_stop(V.v_trainlog(spark, d), "property", "epoch", "val", PATIENCE) \
        .select("property", "best_epoch", "best_val", "stop_epoch", "epochs_run")


@query("running_loss", with_views(f"""
select property, epoch, step, {r6('rl')} as running_loss from (
  select property, epoch, step, avg(loss) over (partition by property, epoch order by step
                                                rows between unbounded preceding and current row) as rl
  from v_steplog) q where step % {LOG_EVERY} = 0""", "v_steplog"))
def q_running_loss(spark, d):
    x = LG.running_mean(V.v_steplog(spark, d), ["property", "epoch"], "step", "loss", "running_loss", block=16)
    return x.filter(F.col("step") % LOG_EVERY == 0).select("property", "epoch", "step", "running_loss")


@query("latest_and_retention", with_views("""
select property, name, step_num, case when rk = 1 then 'latest' when rk <= 3 then 'keep' else 'remove' end as action
from (select property, name, cast(regexp_extract(name, '^step_([0-9]+)$', 1) as bigint) as step_num,
             row_number() over (partition by property order by cast(regexp_extract(name, '^step_([0-9]+)$', 1) as bigint) desc,
                                name desc) as rk
      from v_steplog where regexp_extract(name, '^step_([0-9]+)$', 1) <> '') q""", "v_steplog"))
def q_latest_and_retention(spark, d):
    return LG.latest_and_retention(V.v_steplog(spark, d).select("property", "name"), "property", "name", 3) \
        .select("property", "name", "step_num", "action")
