"""Query bindings of categorisation and variant preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import parsing
from gradus.operators import rank as R
from gradus.operators import text as T
from gradus.plans import views as V
from gradus.plans.oracle_views import with_views
from gradus.plans.registry import query
from gradus.sources.tables import table

SUMMARY_CATEGORIES = T.CATEGORIES + ["excluded"]
MAX_LENGTH = 40


# --------------------------------------------------------------- oracle pieces
def _kw_rows_sql() -> str:
    parts = []
    for prio, (cat, kws) in enumerate(T.KEYWORDS.items()):
        n = " + ".join(f"(case when contains(t, '{k}') then 1 else 0 end)" for k in kws)
        m = ", ".join(f"case when contains(t, '{k}') then '{k}' end" for k in kws)
        parts.append(f"select dms_id, '{cat}' as category, {prio} as priority, cast({n} as int) as n_hits, "
                     f"concat_ws(',', {m}) as matched from kw_text")
    return "\nunion all\n".join(parts)


KW_CTES = [("kw_text", "select dms_id, lower(concat_ws(' ', phenotype)) as t from v_assay"),
           ("kw_rows", _kw_rows_sql()),
           ("kw_best", """select dms_id, category, n_hits, matched from (
                select *, row_number() over (partition by dms_id order by n_hits desc, priority) as rn
                from kw_rows where n_hits > 0) q where rn = 1""")]
MAP_SQL = "case coarse_type " + " ".join(f"when '{k}' then '{v}'" for k, v in T.TYPE_MAP.items()) + " end"

T1_SQL = f"""
select a.dms_id, a.coarse_type as original_type,
       case when a.num_mutants < {T.MIN_MUTATIONS} then 'excluded'
            when ({MAP_SQL}) is not null then ({MAP_SQL})
            when a.coarse_type = '{T.RECLASSIFY_TYPE}' and b.category is not null then b.category
            else '{T.DEFAULT_CATEGORY}' end as assigned_category,
       case when a.num_mutants < {T.MIN_MUTATIONS} then ''
            when ({MAP_SQL}) is not null then ''
            when a.coarse_type = '{T.RECLASSIFY_TYPE}' and b.category is not null then b.matched
            else '' end as matched_keywords,
       case when a.num_mutants < {T.MIN_MUTATIONS} then 'N/A'
            when ({MAP_SQL}) is not null then 'high'
            when a.coarse_type = '{T.RECLASSIFY_TYPE}' and b.category is not null then 'medium'
            else 'low' end as confidence,
       case when a.num_mutants < {T.MIN_MUTATIONS}
            then concat('too_few_mutations (', cast(a.num_mutants as varchar), ' < {T.MIN_MUTATIONS})') end as reason,
       a.num_mutants
from v_assay a left join kw_best b on b.dms_id = a.dms_id"""


def categorized(spark, d):
    """T1 on the assay view (used by several bindings)."""
    return T.categorize(V.v_assay(spark, d))


# --------------------------------------------------------------- P1 / P2 / P3 / O3
@query("min_size_filter", with_views(f"""
select dms_id, num_mutants, coalesce(num_mutants < {T.MIN_MUTATIONS}, false) as excluded,
       case when num_mutants < {T.MIN_MUTATIONS}
            then concat('too_few_mutations (', cast(num_mutants as varchar), ' < {T.MIN_MUTATIONS})') end as reason
from v_assay""", "v_assay"))
def q_min_size_filter(spark, d):
    return T.min_size_filter(V.v_assay(spark, d)).select("dms_id", "num_mutants", "excluded", "reason")


@query("direct_map", with_views(f"select dms_id, coarse_type, {MAP_SQL} as mapped_category from v_assay", "v_assay"))
def q_direct_map(spark, d):
    return T.direct_map(V.v_assay(spark, d)).select("dms_id", "coarse_type", "mapped_category")


@query("keyword_hits", with_views("select dms_id, category, n_hits, matched from kw_rows where n_hits > 0",
                                  "v_assay", extra=KW_CTES[:2]))
def q_keyword_hits(spark, d):
    a = V.v_assay(spark, d)
    x = a.select("dms_id", F.explode(T.keyword_hits(T.search_text("phenotype"))).alias("h"))
    return x.filter(F.col("h.n_hits") > 0).select(
        "dms_id", F.col("h.category").alias("category"), F.col("h.n_hits").alias("n_hits"),
        F.array_join("h.matched", ",").alias("matched"))


@query("keyword_argmax", with_views("""
select a.dms_id, b.category as best_category, b.n_hits from v_assay a left join kw_best b on b.dms_id = a.dms_id""",
                                    "v_assay", extra=KW_CTES))
def q_keyword_argmax(spark, d):
    a = V.v_assay(spark, d)
    best = T.keyword_argmax(T.keyword_hits(T.search_text("phenotype")))
    return a.select("dms_id", best.alias("b")).select(
        "dms_id", F.col("b.category").alias("best_category"), F.col("b.n_hits").alias("n_hits"))


# --------------------------------------------------------------- T1 / A7
@query("categorize", with_views(T1_SQL, "v_assay", extra=KW_CTES))
def q_categorize(spark, d):
    return categorized(spark, d).withColumn("matched_keywords", F.array_join("matched_keywords", ","))


def _summary_sql() -> str:
    cats = " union all ".join(f"select '{c}' as category" for c in SUMMARY_CATEGORIES)
    return with_views(f"""
select c.category, coalesce(t.n, 0)::bigint as n_assays, coalesce(t.n, 0) < 8 as below_min,
       coalesce(t.nh, 0)::bigint as n_high, coalesce(t.nm, 0)::bigint as n_medium, coalesce(t.nl, 0)::bigint as n_low
from ({cats}) c left join (
  select assigned_category, count(*) as n, sum(case when confidence = 'high' then 1 else 0 end) as nh,
         sum(case when confidence = 'medium' then 1 else 0 end) as nm,
         sum(case when confidence = 'low' then 1 else 0 end) as nl
  from t1 group by assigned_category) t on t.assigned_category = c.category""",
                      "v_assay", extra=KW_CTES + [("t1", T1_SQL)])


@query("category_summary", _summary_sql())
def q_category_summary(spark, d):
    return R.category_summary(categorized(spark, d), SUMMARY_CATEGORIES, min_assays=8)


# --------------------------------------------------------------- P4 / P5 / P6
@query("mutation_positions", with_views("""
select item, array_to_string(pos, ',') as positions, cast(len(pos) as int) as n_positions, list_max(pos) as max_pos
from (select item, list_transform(list_filter(list_transform(string_split(mutant, ':'),
              lambda x: regexp_extract(x, '^.([0-9]+)', 1)), lambda s: s <> ''), lambda s: cast(s as bigint) - 1) as pos
      from v_mutant) q""", "v_mutant"))
def q_mutation_positions(spark, d):
    pos = parsing.mutation_positions(F.col("mutant"))
    return V.v_mutant(spark, d).select(
        "item", F.array_join(F.transform(pos, lambda p: p.cast("string")), ",").alias("positions"),
        F.size(pos).alias("n_positions"), F.array_max(pos).alias("max_pos"))


@query("parse_mutations", with_views("""
select item, k, s.wt as wt, s.pos as pos, s.mut as mut from (
  select item, unnest(m) as s, cast(generate_subscripts(m, 1) - 1 as int) as k from (
    select item, list_transform(list_filter(list_transform(string_split(mutant, ':'),
             lambda x: {'wt': substr(x, 1, 1),
                        'd': regexp_replace(substr(x, 2, greatest(length(x) - 2, 0)), '[^0-9]', '', 'g'),
                        'mut': right(x, 1)}), lambda s: s.d <> ''),
             lambda s: {'wt': s.wt, 'pos': cast(s.d as bigint) - 1, 'mut': s.mut}) as m
    from v_mutant) q) r""", "v_mutant"))
def q_parse_mutations(spark, d):
    m = V.v_mutant(spark, d).select("item", F.posexplode(parsing.parse_mutations(F.col("mutant"))).alias("k", "s"))
    return m.select("item", "k", F.col("s.wt").alias("wt"), F.col("s.pos").alias("pos"), F.col("s.mut").alias("mut"))


@query("truncate_or_exclude", with_views(f"""
select category, sum(case when action = 'keep' then 1 else 0 end)::bigint as n_keep,
       sum(case when action = 'truncate' then 1 else 0 end)::bigint as n_truncate,
       sum(case when action = 'exclude' then 1 else 0 end)::bigint as n_exclude,
       sum(length(seq_out))::bigint as total_len_out
from (select s.category,
             case when s.text is null or length(s.text) <= {MAX_LENGTH} then 'keep'
                  when len(p.pos) > 0 and list_max(p.pos) >= {MAX_LENGTH} then 'exclude' else 'truncate' end as action,
             case when s.text is null or length(s.text) <= {MAX_LENGTH} then s.text
                  when len(p.pos) > 0 and list_max(p.pos) >= {MAX_LENGTH} then null
                  else substr(s.text, 1, {MAX_LENGTH}) end as seq_out
      from v_seq s left join (
        select item, list_transform(list_filter(list_transform(string_split(mutant, ':'),
               lambda x: regexp_extract(x, '^.([0-9]+)', 1)), lambda s: s <> ''), lambda s: cast(s as bigint) - 1) as pos
        from v_mutant) p on p.item = s.doc_id) q
group by category""", "v_seq", "v_mutant"))
def q_truncate_or_exclude(spark, d):
    seq = V.v_seq(spark, d).select("doc_id", "category", "text")
    mut = V.v_mutant(spark, d)
    x = seq.join(mut, seq.doc_id == mut.item, "left")
    x = T.truncate_or_exclude(x, "text", "mutant", MAX_LENGTH)
    return x.groupBy("category").agg(
        F.sum(F.when(F.col("action") == "keep", 1).otherwise(0)).cast("long").alias("n_keep"),
        F.sum(F.when(F.col("action") == "truncate", 1).otherwise(0)).cast("long").alias("n_truncate"),
        F.sum(F.when(F.col("action") == "exclude", 1).otherwise(0)).cast("long").alias("n_exclude"),
        F.sum(F.length("seq_out")).cast("long").alias("total_len_out"))


# --------------------------------------------------------------- P8
@query("smoke_subset", with_views("""
select assigned_category, dms_id, l_orderkey, l_linenumber, l_suppkey, l_extendedprice from (
  select a.assigned_category, l.l_partkey as dms_id, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice,
         row_number() over (partition by l.l_partkey order by l.l_orderkey, l.l_linenumber, l.l_suppkey,
                                                             l.l_extendedprice, l.l_quantity, l.l_shipdate) as rv
  from (select assigned_category, dms_id from (
          select assigned_category, dms_id, row_number() over (partition by assigned_category order by dms_id) as ra
          from t1) q where ra <= 2) a
  join lineitem l on l.l_partkey = a.dms_id) r
where rv <= 10""", "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_smoke_subset(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "dms_id")
    x = T.smoke_subset(categorized(spark, d), li, 2, 10,
                       variant_key=["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
                                    "l_shipdate"])
    return x.select("assigned_category", "dms_id", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


# --------------------------------------------------------------- P3 on whole documents
def _kw_doc_sql() -> str:
    parts = []
    for prio, (cat, kws) in enumerate(T.KEYWORDS.items()):
        n = " + ".join(f"(case when contains(t, '{k}') then 1 else 0 end)" for k in kws)
        m = ", ".join(f"case when contains(t, '{k}') then '{k}' end" for k in kws)
        parts.append(f"select doc_id, '{cat}' as category, cast({n} as int) as n_hits, "
                     f"concat_ws(',', {m}) as matched from dt")
    return "\nunion all\n".join(parts)


@query("keyword_hits_documents", f"""
with dt as (select doc_id, lower(text) as t from documents)
select doc_id, category, n_hits, matched from ({_kw_doc_sql()}) q where n_hits > 0""")
def q_keyword_hits_documents(spark, d):
    """P3 over whole document texts: categories whose keywords occur, with the matches."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    x = docs.select("doc_id", F.explode(T.keyword_hits(T.search_text("text"))).alias("h"))
    return x.filter(F.col("h.n_hits") > 0).select(
        "doc_id", F.col("h.category").alias("category"), F.col("h.n_hits").alias("n_hits"),
        F.array_join("h.matched", ",").alias("matched"))
