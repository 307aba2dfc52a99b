"""Query bindings of sources, sinks and streams (S1, S2, S5-S9, ST1, ST2).

Each query writes Spark-derived data to a fresh folder under the shared
checkpoint directory and reads it back with an explicit schema.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from gradus.plans import views as V
from gradus.plans.oracle_views import r6, with_views
from gradus.plans.q_rank import K_FRACTION, KEY
from gradus.plans.q_score import SCORE_CTES, scores
from gradus.plans.q_text import KW_CTES, T1_SQL, categorized
from gradus.plans.registry import ORACLE, query
from gradus.session import scratch_path
from gradus.sources import documents as docs
from gradus.sources import io
from gradus.sources.tables import table
from gradus.streaming import incremental as ST


# --------------------------------------------------------------- S1
@query("scan_reference", with_views("""
select cast(dms_id as varchar) as DMS_id, uniprot_id as UniProt_ID, coarse_type as coarse_selection_type,
       phenotype as raw_DMS_phenotype_name, num_mutants as DMS_total_number_mutants from v_assay""", "v_assay"))
def q_scan_reference(spark, d):
    a = V.v_assay(spark, d)
    ref = a.select(F.col("dms_id").cast("string").alias("DMS_id"),
                   F.concat(F.col("dms_id").cast("string"), F.lit(".csv")).alias("DMS_filename"),
                   F.col("uniprot_id").alias("UniProt_ID"), F.lit(None).cast("string").alias("target_seq"),
                   F.col("coarse_type").alias("coarse_selection_type"),
                   F.col("phenotype").alias("raw_DMS_phenotype_name"),
                   *[F.lit(None).cast("string").alias(c) for c in ("selection_assay", "selection_type",
                                                                    "molecule_name", "title")],
                   F.col("num_mutants").alias("DMS_total_number_mutants"))
    path = scratch_path(spark, "reference")
    ref.write.mode("overwrite").option("header", True).csv(path)
    back = io.scan_reference(spark, path)
    return back.select("DMS_id", "UniProt_ID", "coarse_selection_type", "raw_DMS_phenotype_name",
                       "DMS_total_number_mutants")


# --------------------------------------------------------------- S2
S2_CATEGORY = "stability"
VARIANT_BUCKETS = 16


@query("scan_variants", with_views(f"""
select t.dms_id, t.assigned_category as category, count(*) as n_variants, {r6('sum(l.l_extendedprice)')} as sum_score
from t1 t join lineitem l on l.l_partkey = t.dms_id where t.assigned_category = '{S2_CATEGORY}'
group by t.dms_id, t.assigned_category""", "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_scan_variants(spark, d):
    t1 = categorized(spark, d).filter(F.col("assigned_category") == S2_CATEGORY) \
        .select("dms_id", F.col("assigned_category").alias("category"))
    li = table(spark, d, "lineitem")
    var = li.join(t1.select(F.col("dms_id").alias("l_partkey")), "l_partkey", "left_semi").select(
        F.col("l_partkey").alias("dms_id"),
        F.concat(F.lit("A"), F.col("l_linenumber").cast("string"), F.lit("C")).alias("mutant"),
        F.lit(None).cast("string").alias("mutated_sequence"),
        F.col("l_extendedprice").alias("DMS_score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("DMS_score_bin"))
    # assays are dealt over a fixed number of folders, so the layout doesn't grow with their
    # number, and a rebalance splits a folder that holds a large assay over several files
    root = scratch_path(spark, "variants")
    var.withColumn("bucket", F.pmod(F.xxhash64("dms_id"), F.lit(VARIANT_BUCKETS)).cast("int")).hint("rebalance", "bucket") \
        .write.partitionBy("bucket").option("header", True).csv(root)
    back = io.scan_variant_buckets(spark, root, "dms_id")
    j = back.join(t1, "dms_id")
    return j.groupBy("dms_id", "category").agg(F.count(F.lit(1)).alias("n_variants"),
                                               F.sum("DMS_score").alias("sum_score"))


# --------------------------------------------------------------- S6
@query("json_export", with_views("""
select assigned_category as category, count(*) as n_assays,
       sum(case when matched_keywords = '' then 0 else len(string_split(matched_keywords, ',')) end)::bigint as n_keywords
from t1 group by assigned_category""", "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_json_export(spark, d):
    path = scratch_path(spark, "categorization-json")
    io.write_json_lines(categorized(spark, d), path)
    schema = ("dms_id bigint, original_type string, assigned_category string, matched_keywords array<string>, "
              "confidence string, reason string, num_mutants bigint")
    back = io.read_json_lines(spark, path, schema)
    return back.groupBy(F.col("assigned_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_assays"), F.sum(F.size("matched_keywords")).cast("long").alias("n_keywords"))


@query("category_documents", with_views("""
select t.assigned_category as category, s.n_assays, s.n_variants, t.dms_id, t.original_type, t.confidence, t.reason,
       len(case when t.matched_keywords = '' then [] else string_split(t.matched_keywords, ',') end)::int as n_keywords
from t1 t join (select t1.assigned_category, count(*) as n_assays, coalesce(sum(a.num_mutants), 0)::bigint as n_variants
                from t1 join v_assay a on a.dms_id = t1.dms_id group by t1.assigned_category) s
  on s.assigned_category = t.assigned_category""", "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_category_documents(spark, d):
    """Nested category lists with their decision log and the summary document, read back."""
    path = scratch_path(spark, "category-documents")
    docs.category_documents(categorized(spark, d), path)
    by = StructType.fromDDL("assigned_category string").fields
    entry = StructType.fromDDL("dms_id bigint, original_type string, matched_keywords array<string>, confidence string, "
                               "reason string, num_mutants bigint")
    rows = docs.read_lists(spark, path + "/lists", by, entry)
    summary = spark.read.schema("assigned_category string, n_assays bigint, n_variants bigint").json(path + "/summary")
    return rows.join(summary, "assigned_category").select(
        F.col("assigned_category").alias("category"), "n_assays", "n_variants", "dms_id", "original_type", "confidence",
        "reason", F.size("matched_keywords").alias("n_keywords"))


# --------------------------------------------------------------- S7
@query("scored_sink", with_views(f"""
select o.o_orderpriority as dms_id, count(*) as n_rows, {r6('sum(s.zero_shot_score)')} as sum_score
from orders o join scores s on s.item = o.o_orderkey group by o.o_orderpriority""",
    "v_mutant", "v_vec", extra=SCORE_CTES))
def q_scored_sink(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("dms_id"))
    sc = o.join(scores(spark, d), "item")
    path = scratch_path(spark, "scored")
    io.write_scored(sc, path, "dms_id")
    back = spark.read.schema("item bigint, zero_shot_score double, n_mutations bigint, n_skipped bigint, "
                             "dms_id string").parquet(path)
    return back.groupBy("dms_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("zero_shot_score").alias("sum_score"))


# --------------------------------------------------------------- S9
METRICS_SCHEMA = StructType([StructField("dms_id", LongType()), StructField("n_variants", LongType()),
                             *[StructField(c, DoubleType()) for c in ("spearman", "spearman_pval", "ndcg", "ndcg_10",
                                                                       "top_10_recall", "auc")]])


def _s9(spark, d):
    from gradus.operators import rank as R
    m = R.assay_metrics(V.v_pred(spark, d), "dms_id", "dms_score", "pred", "dms_score_bin", KEY, K_FRACTION)
    path = scratch_path(spark, "metrics-csv")
    io.write_csv(m.select(*[f.name for f in METRICS_SCHEMA.fields]), path)
    return spark.read.schema(METRICS_SCHEMA).option("header", True).csv(path)


query("metrics_csv", ORACLE.get("assay_metrics"))(_s9)


# --------------------------------------------------------------- S8
def _write_weight_files(spark, d, folder, only=None):
    """Sharded safetensors files, one per (property, layer): a shard holds one layer's
    A and B factors (bounded by rank x width), never a whole adapter in one task."""
    lr = V.v_lowrank(spark, d) if only is None else V.v_lowrank(spark, d).where(only)
    names = F.concat(F.lit("base_model.model.encoder.layer."), F.col("prefix").cast("string"),
                     F.lit(".attention.self.query.lora_"), F.col("matrix"), F.lit(".weight"))
    shard = F.concat(F.col("property").cast("string"), F.lit("-layer_"), F.col("prefix").cast("string"))
    io.write_safetensors_files(lr.withColumn("tensor", names).withColumn("shard", shard), "shard", "tensor", folder,
                               lambda key: f"prop_{key}.safetensors")


@query("weights_ingest", with_views(f"""
select property, prefix, matrix, count(*) as n, {r6('sum(v)')} as total from v_lowrank group by 1, 2, 3""",
                                    "v_lowrank"))
def q_weights_ingest(spark, d):
    folder = scratch_path(spark, "weights")
    _write_weight_files(spark, d, folder)
    from gradus.operators.vectors import lora_parts
    rows = io.weights_ingest(spark, folder)
    prefix, matrix = lora_parts("name")
    x = rows.select(F.regexp_extract("path", r"prop_([0-9]+)-layer_[0-9]+\.safetensors", 1).cast("int").alias("property"),
                    F.regexp_extract(prefix, r"layer\.([0-9]+)\.", 1).cast("int").alias("prefix"),
                    matrix.alias("matrix"), F.explode("vals").alias("v"))
    return x.groupBy("property", "prefix", "matrix").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# --------------------------------------------------------------- S3 on files
@query("manifest_files", with_views("""
select property, prefix, concat('prop_', cast(property as varchar), '-layer_', cast(prefix as varchar), '.safetensors') as file_name,
       case when prefix % 5 = 0 then 'missing' else 'found' end as status, prefix % 5 <> 0 as has_path
from (select distinct property, prefix from v_lowrank where prefix % 3 <> 0) e
union all
select null, null, concat('prop_', cast(property as varchar), '-layer_', cast(prefix as varchar), '.safetensors'), 'unexpected', true
from (select distinct property, prefix from v_lowrank where prefix % 3 = 0 and prefix % 5 <> 0) u""", "v_lowrank"))
def q_manifest_files(spark, d):
    """S3: the weight files of a folder against the expected ones; layers divisible by 5 were never
    written, those divisible by 3 aren't expected."""
    folder = scratch_path(spark, "manifest-weights")
    _write_weight_files(spark, d, folder, "prefix % 5 <> 0")
    expected = V.v_lowrank(spark, d).where("prefix % 3 <> 0").select("property", "prefix").distinct()
    name = F.concat(F.lit("prop_"), F.col("property").cast("string"), F.lit("-layer_"), F.col("prefix").cast("string"), F.lit(".safetensors"))
    x = io.manifest_files(spark, folder, expected.withColumn("file_name", name), "file_name")
    return x.select("property", "prefix", "file_name", "status", F.col("path").isNotNull().alias("has_path"))


# --------------------------------------------------------------- ST1 / ST2
EVENTS_SCHEMA = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
                            StructField("user_id", LongType()), StructField("event_type", StringType()),
                            StructField("value", DoubleType()), StructField("props", StringType())])


# a delivery holds the table's whole time span in any order, so replays may be as late as that
REPLAY_DELAY = "3660 days"


@query("incremental_scoring", f"""
select e.event_id, e.event_type, {r6('e.value - t.mu')} as score
from events e join (select event_type, avg(value) as mu from events group by event_type) t on t.event_type = e.event_type""")
def q_incremental_scoring(spark, d):
    schema = table(spark, d, "events").schema
    static = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mu"))
    out, ck = scratch_path(spark, "st1-out"), scratch_path(spark, "st1-ckpt")
    for _ in range(2):  # the second run finds nothing new and adds no rows
        stream = ST.file_stream(spark, d, schema, glob="events.parquet")
        ST.incremental_scoring(stream, static, "event_type", F.col("value") - F.col("mu"), out, ck,
                               ["event_id", "event_type"])
    return spark.read.schema("event_id bigint, event_type string, score double").parquet(out)


@query("incremental_scoring_replay", f"""
select e.event_id, e.event_type, {r6('e.value - t.mu')} as score
from events e join (select event_type, avg(value) as mu from events group by event_type) t on t.event_type = e.event_type""")
def q_incremental_scoring_replay(spark, d):
    """ST1 with a producer that delivers every row again in files of their own: no row is scored twice."""
    events = table(spark, d, "events")
    static = events.groupBy("event_type").agg(F.avg("value").alias("mu"))
    inbox, out, ck = (scratch_path(spark, f"st1-{x}") for x in ("inbox", "replay-out", "replay-ckpt"))
    for _ in range(2):  # the second delivery adds nothing
        events.write.mode("append").parquet(inbox)
        stream = ST.without_replays(ST.file_stream(spark, inbox, events.schema), "event_id", "ts", REPLAY_DELAY)
        ST.incremental_scoring(stream, static, "event_type", F.col("value") - F.col("mu"), out, ck,
                               ["event_id", "event_type"])
    return spark.read.schema("event_id bigint, event_type string, score double").parquet(out)


@query("training_monitor", f"""
select event_type as property, count(*) as n_events, max(ts) as latest_ts,
       {r6('arg_max(value, (ts, event_id))')} as latest_value, {r6('max(value)')} as best_value
from events group by event_type""")
def q_training_monitor(spark, d):
    schema = table(spark, d, "events").schema
    out, ck = scratch_path(spark, "st2-out"), scratch_path(spark, "st2-ckpt")
    stream = ST.file_stream(spark, d, schema, glob="events.parquet")
    ST.training_monitor(stream, "event_type", "ts", "value", "event_id", out, ck)
    return ST.latest_table(spark, out)



@query("early_stop_monitor", with_views("""
with x as (select *, max(val) over (partition by property order by epoch
                                    rows between unbounded preceding and 1 preceding) as prev from v_trainlog),
y as (select *, prev is null or val > prev as improved from x),
z as (select *, epoch - max(case when improved then epoch end) over (partition by property order by epoch
                                 rows between unbounded preceding and current row) as since from y),
st as (select property, min(case when since >= 5 then epoch end) as stop_epoch from z group by property),
ran as (select z.*, st.stop_epoch from z join st on st.property = z.property
        where st.stop_epoch is null or z.epoch <= st.stop_epoch),
mx as (select property, max(val) as best_val, count(*) as epochs_run, min(stop_epoch) as stop_epoch,
              (select max(t.epoch) from v_trainlog t where t.property = ran.property) as last_epoch
       from ran group by property)
select m.property, (select min(r.epoch) from ran r where r.property = m.property and r.val = m.best_val) as best_epoch,
       (round((m.best_val) * 1e6) / 1e6 + 0.0) as best_val, m.stop_epoch, m.epochs_run, m.last_epoch
from mx m""".replace("with x as", "x as"), "v_trainlog").replace("\nx as", ",\nx as", 1))
def q_early_stop_monitor(spark, d):
    """ST2 stateful: the training log (derived from events) lands as files and is
    streamed through the per-property patience state."""
    src, out, ck = scratch_path(spark, "trainlog"), scratch_path(spark, "es-out"), scratch_path(spark, "es-ckpt")
    log = V.v_trainlog(spark, d)
    log.write.mode("overwrite").parquet(src)
    stream = ST.file_stream(spark, src, log.schema)
    ST.early_stop_monitor(stream, "property", "epoch", "val", 5, out, ck)
    return ST.latest_status(spark, out)
