"""Query bindings of dedup, clustering, splitting and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradus.operators import cluster as C
from gradus.operators import sequence as SQ
from gradus.operators import setops as U
from gradus.operators import split as SP
from gradus.plans import views as V
from gradus.plans.oracle_views import r6, with_views
from gradus.plans.q_text import KW_CTES, T1_SQL, categorized
from gradus.plans.registry import query
from gradus.session import scratch_path
from gradus.sources import documents as D
from gradus.sources.tables import fan_out, table

SEED = 42
TEST_FRACTION = 0.2


# --------------------------------------------------------------- assay split (v_assay, protein = name)
def assay_assignments(spark, d):
    from gradus.operators import text as T
    x = T.categorize(V.v_assay(spark, d), keep=["uniprot_id"]).filter(F.col("assigned_category") != "excluded") \
        .select("dms_id", F.col("assigned_category").alias("category"), F.col("uniprot_id").alias("protein"))
    # no cluster table for assay proteins: every protein is its own cluster (J1's rule
    # for proteins absent from the table), so no join is needed
    return x.withColumn("cluster", F.col("protein"))


def assay_split(spark, d, mode="per_category"):
    return SP.stratified_group_split(assay_assignments(spark, d), TEST_FRACTION, SEED, mode)


ASSIGN_CTE = ("assign", """select t.dms_id, t.assigned_category as category, a.uniprot_id as protein,
                                  a.uniprot_id as cluster
                           from t1 t join v_assay a on a.dms_id = t.dms_id where t.assigned_category <> 'excluded'""")
SPLIT_PER_CAT = [
    ("units", "select distinct category, cluster from assign"),
    ("ranked", f"""select category, cluster,
                          row_number() over (partition by category order by md5(concat('{SEED}', category, cluster))) as rn,
                          count(*) over (partition by category) as n from units"""),
    ("split", f"""select a.dms_id, a.category, a.protein, a.cluster,
                         case when r.rn <= greatest(1, floor(r.n * {TEST_FRACTION}::double)) then 'test' else 'train' end as split
                  from assign a join ranked r on r.category = a.category and r.cluster = a.cluster"""),
]
PRIO_SQL = "case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(SP.PRIORITY)) + \
           f" else {len(SP.PRIORITY)} end"
SPLIT_GLOBAL = [
    ("homes", f"""select cluster, category from (
                    select cluster, category, row_number() over (partition by cluster
                           order by n desc, {PRIO_SQL} asc, category desc) as rk
                    from (select cluster, category, count(*) as n from assign group by 1, 2) q) r where rk = 1"""),
    ("ranked", f"""select category, cluster,
                          row_number() over (partition by category order by md5(concat('{SEED}', category, cluster))) as rn,
                          count(*) over (partition by category) as n from homes"""),
    ("split", f"""select a.dms_id, a.category, a.protein, a.cluster,
                         case when r.rn <= greatest(1, floor(r.n * {TEST_FRACTION}::double)) then 'test' else 'train' end as split
                  from assign a join ranked r on r.cluster = a.cluster"""),
]
BASE = KW_CTES + [("t1", T1_SQL), ASSIGN_CTE]
AUDIT_SQL = """
select sum(case when lvl = 'a' then tr else 0 end)::bigint as train_assays,
       sum(case when lvl = 'a' then te else 0 end)::bigint as test_assays,
       sum(case when lvl = 'p' then tr else 0 end)::bigint as train_proteins,
       sum(case when lvl = 'p' then te else 0 end)::bigint as test_proteins,
       sum(case when lvl = 'c' then tr else 0 end)::bigint as train_clusters,
       sum(case when lvl = 'c' then te else 0 end)::bigint as test_clusters,
       sum(case when lvl = 'a' then tr * te else 0 end)::bigint as n_id_overlap,
       sum(case when lvl = 'p' then tr * te else 0 end)::bigint as n_protein_overlap,
       sum(case when lvl = 'c' then tr * te else 0 end)::bigint as n_cluster_overlap,
       sum(case when lvl = 'a' then tr * te else 0 end) = 0 and sum(case when lvl = 'c' then tr * te else 0 end) = 0 as valid
from (select lvl, k, max(case when split = 'train' then 1 else 0 end) as tr, max(case when split = 'test' then 1 else 0 end) as te
      from (select 'a' as lvl, cast(dms_id as varchar) as k, split from split
            union all select 'p', protein, split from split
            union all select 'c', cluster, split from split) u group by lvl, k) q"""


@query("stratified_group_split", with_views("select dms_id, category, protein, cluster, split from split", "v_assay",
                                            extra=BASE + SPLIT_PER_CAT))
def q_stratified_group_split(spark, d):
    return assay_split(spark, d).select("dms_id", "category", "protein", "cluster", "split")


@query("stratified_group_split_global", with_views("select dms_id, category, protein, cluster, split from split",
                                                   "v_assay", extra=BASE + SPLIT_GLOBAL))
def q_stratified_group_split_global(spark, d):
    return assay_split(spark, d, "global").select("dms_id", "category", "protein", "cluster", "split")


@query("leakage_audit", with_views(AUDIT_SQL, "v_assay", extra=BASE + SPLIT_PER_CAT))
def q_leakage_audit(spark, d):
    return SP.leakage_audit(assay_split(spark, d), "dms_id", "protein", "cluster")


@query("leakage_audit_global", with_views(AUDIT_SQL, "v_assay", extra=BASE + SPLIT_GLOBAL))
def q_leakage_audit_global(spark, d):
    return SP.leakage_audit(assay_split(spark, d, "global"), "dms_id", "protein", "cluster")


SPLIT_PARAMETERS = {"identity_threshold": C.IDENTITY, "coverage": C.COVERAGE, "coverage_mode": "both",
                    "test_fraction": TEST_FRACTION, "random_seed": SEED}


def _written_split(spark, d, mode):
    path = scratch_path(spark, "split-documents")
    D.write_split(assay_split(spark, d, mode), path, SPLIT_PARAMETERS)
    return path


@query("split_documents", with_views("select split, dms_id, category, cluster from split", "v_assay",
                                     extra=BASE + SPLIT_PER_CAT))
def q_split_documents(spark, d):
    """The written lists of a split, read back."""
    by = StructType.fromDDL("split string").fields
    entry = StructType.fromDDL("dms_id bigint, category string, cluster string")
    return D.read_lists(spark, _written_split(spark, d, "per_category") + "/lists", by, entry)


@query("split_leaks", with_views("""
select 'cluster' as level, cluster from split group by cluster having count(distinct split) > 1""", "v_assay",
                                 extra=BASE + SPLIT_PER_CAT))
def q_split_leaks(spark, d):
    """Clusters that the written validation names as being on both sides."""
    by = StructType.fromDDL("level string").fields
    return D.read_lists(spark, _written_split(spark, d, "per_category") + "/leaks", by,
                        StructType.fromDDL("cluster string"))


@query("split_metadata", with_views(f"""
select {C.IDENTITY}::double as identity_threshold, {C.COVERAGE}::double as coverage, 'both' as coverage_mode,
       {TEST_FRACTION}::double as test_fraction, {SEED}::int as random_seed, v.* from ({AUDIT_SQL}) v""", "v_assay",
                                    extra=BASE + SPLIT_GLOBAL))
def q_split_metadata(spark, d):
    """Parameters and validation of the split, read back from the metadata document."""
    levels = ", ".join(f"{side}_{level}: bigint" for level in ("assays", "proteins", "clusters")
                       for side in ("train", "test"))
    schema = ("identity_threshold double, coverage double, coverage_mode string, test_fraction double, random_seed int, "
              f"validation struct<{levels}, n_id_overlap: bigint, n_protein_overlap: bigint, "
              "n_cluster_overlap: bigint, valid: boolean>")
    x = spark.read.schema(schema).json(_written_split(spark, d, "global") + "/metadata")
    return x.select(*SPLIT_PARAMETERS, "validation.*")


@query("set_overlap", with_views("""
select cluster from split where split = 'train' intersect select cluster from split where split = 'test'""",
                                 "v_assay", extra=BASE + SPLIT_PER_CAT))
def q_set_overlap(spark, d):
    return SP.overlapping(assay_split(spark, d), "cluster")


@query("id_in_split", with_views("""
select a.dms_id, a.uniprot_id from v_assay a where a.dms_id in (select dms_id from split where split = 'train')""",
                                 "v_assay", extra=BASE + SPLIT_PER_CAT))
def q_id_in_split(spark, d):
    items = V.v_assay(spark, d).select("dms_id", "uniprot_id")
    return SP.id_in_split(items, assay_split(spark, d), "train")


@query("distinct_proteins", with_views("""
select uniprot_id, dms_id, file_order, phenotype from (
  select *, row_number() over (partition by uniprot_id order by file_order) as rn from v_assay) q
where rn = 1 and phenotype is not null and length(phenotype) > 0""", "v_assay"))
def q_distinct_proteins(spark, d):
    a = V.v_assay(spark, d).select("uniprot_id", "dms_id", "file_order", "phenotype")
    return U.distinct_first(a, "uniprot_id", ["file_order"], value="phenotype")


# --------------------------------------------------------------- clustering of documents
def doc_sets(spark, d, md5=False):
    docs = table(spark, d, "documents")
    return C.shingle_sets(docs, "doc_id", "text", partitions=fan_out(docs), md5=md5)


def doc_sets_once(spark, d):
    """The shingle sets for the pipelines that read them twice: named once. Those of a table of several files are made again
    where they are needed, those of a single file, whose texts are dealt out first, are written."""
    docs = table(spark, d, "documents")
    return C.text_sets(docs, "doc_id", "text") if fan_out(docs) is None else C.stored(doc_sets(spark, d))


def doc_candidates(spark, d):
    # candidates depend on the order of the hashes, so theirs are md5's
    return C.shingle_candidates(C.materialize(C.named(doc_sets(spark, d, md5=True))))


def doc_verified(spark, d):
    sh = doc_sets_once(spark, d)
    return C.identity_coverage_filter(C.shingle_candidates(sh, positional=True), sh)


def doc_clusters(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return C.cluster_components(docs, doc_verified(spark, d).select("id", "rep"))


def shingle_ctes(src: str, id_col: str, text: str, prefix: str = "") -> list[tuple[str, str]]:
    k = C.SHINGLE_WORDS
    return [
        (f"{prefix}sh_words", f"select {id_col} as id, list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '') as w "
                              f"from {src}"),
        (f"{prefix}sh_str", f"""select id, array_to_string(w, ' ') as s from {prefix}sh_words where len(w) between 1 and {k - 1}
                     union all
                     select id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') as s
                     from (select id, w, unnest(range(1, len(w) - {k} + 2)) as i from {prefix}sh_words
                           where len(w) >= {k}) q"""),
        (f"{prefix}sh", f"select distinct id, ('0x' || substr(md5(s), 1, 12))::bigint as h from {prefix}sh_str"),
    ]


# copies of a set hang on its smallest id; other pairs are between the smallest ids of sets
SET_CTES = shingle_ctes("documents", "doc_id", "text") + [
    ("sets", "select id, count(*) as n, string_agg(cast(h as varchar), ',' order by h) as members from sh group by id"),
    ("same", "select id, n, min(id) over (partition by members) as rep from sets"),
    ("rsh", "select sh.id, sh.h, same.n from sh join same on same.id = sh.id where same.id = same.rep"),
]


def _needed_sql(n: str) -> str:
    return f"ceil({C.COVERAGE}::double * {n} - 1e-9)"


CAND_CTES = SET_CTES + [
    ("df", "select h, count(*) as df from rsh group by h having count(*) > 1"),
    ("ranked_sh", """select id, n, rsh.h, row_number() over (partition by id order by df, rsh.h) as r,
                            count(*) over (partition by id) as m from rsh join df on df.h = rsh.h"""),
    ("pre", f"select id, n, h from ranked_sh where r <= m - {_needed_sql('n')} + 1"),
    ("cand", f"""select distinct a.id, b.id as rep from pre a join pre b on a.h = b.h and a.id > b.id
                   and b.n >= {_needed_sql('a.n')} and a.n >= {_needed_sql('b.n')}
                 union all select id, rep from same where id <> rep"""),
]


def verified_sql(mode: str = "both") -> str:
    """Every qualifying edge from all pairs that share a shingle, without any candidate rule."""
    directed = "a.id > b.id" if mode == "both" else "a.id <> b.id"
    cov = {"both": "shared / greatest(n_id, n_rep)", "query": "shared / n_id", "target": "shared / n_rep"}[mode]
    return f"""select id, rep, shared, n_id, n_rep, shared / least(n_id, n_rep) as identity, {cov} as coverage
               from (select a.id, b.id as rep, count(*) as shared, max(a.n) as n_id, max(b.n) as n_rep
                     from rsh a join rsh b on a.h = b.h and {directed} group by a.id, b.id
                     union all select id, rep, n, n, n from same where id <> rep) q
               where shared / least(n_id, n_rep) >= {C.IDENTITY} and {cov} >= {C.COVERAGE}"""


VERIFY_CTES = SET_CTES + [("verified", verified_sql())]
CLUSTER_CTES = VERIFY_CTES + [
    ("und", "select id as a, rep as b from verified union select rep as a, id as b from verified"),
    ("reach", "select a, b from und union select r.a, u.b from reach r join und u on u.a = r.b"),
    ("clusters", "select coalesce(least(d.doc_id, m.mn), d.doc_id) as representative, d.doc_id as member "
                 "from documents d left join (select a, min(b) as mn from reach group by a) m on m.a = d.doc_id"),
]


def _recursive(sql: str) -> str:
    return "with recursive " + sql[len("with "):]


@query("shingle_candidates", with_views("select id, rep from cand", extra=CAND_CTES))
def q_shingle_candidates(spark, d):
    return doc_candidates(spark, d).select("id", "rep")


@query("identity_coverage_filter", with_views(
    f"select id, rep, shared, n_id, n_rep, {r6('identity')} as identity, {r6('coverage')} as coverage from verified",
    extra=VERIFY_CTES))
def q_identity_coverage_filter(spark, d):
    return doc_verified(spark, d).select("id", "rep", "shared", "n_id", "n_rep", "identity", "coverage")


def _containment(mode):
    @query(f"containment_{mode}", with_views(
        f"select id, rep, shared, n_id, n_rep, {r6('identity')} as identity, {r6('coverage')} as coverage from verified",
        extra=SET_CTES + [("verified", verified_sql(mode))]))
    def q_containment(spark, d):
        """C1 and C2 with the coverage on one side, in either order of the ids."""
        sh = doc_sets_once(spark, d)
        return C.identity_coverage_filter(C.shingle_candidates(sh, mode=mode, positional=True), sh, mode=mode) \
            .select("id", "rep", "shared", "n_id", "n_rep", "identity", "coverage")

    return q_containment


for _mode in ("query", "target"):
    _containment(_mode)


@query("cluster_components", _recursive(with_views("select representative, member from clusters",
                                                   extra=CLUSTER_CTES)))
def q_cluster_components(spark, d):
    return doc_clusters(spark, d)


# --------------------------------------------------------------- short sequences (v_assay, sequence = phenotype)
SEQ_CLUSTER_IDENTITY = 0.9
SEQ_CTES = [
    ("seqs", "select distinct dms_id as id, phenotype as s from v_assay where phenotype is not null and length(phenotype) > 0"),
    ("firsts", "select s, min(id) as rep, length(s) as n from seqs group by s"),
]


def seq_links_ctes(identity: float) -> list[tuple[str, str]]:
    """Every link from all pairs of different sequences, without any candidate rule."""
    return SEQ_CTES + [
        ("pairs", """select a.rep as id, b.rep, levenshtein(a.s, b.s)::int as distance, greatest(a.n, b.n) as longer,
                            least(a.n, b.n) as shorter from firsts a join firsts b on a.rep > b.rep"""),
        ("links", f"""select id, rep, distance, 1 - distance / longer as identity, shorter / longer as coverage
                      from pairs where 1 - distance / longer >= {identity} - 1e-9
                                   and shorter / longer >= {SQ.COVERAGE} - 1e-9
                      union all select q.id, f.rep, 0, 1, 1 from seqs q join firsts f on f.s = q.s where q.id <> f.rep"""),
    ]


@query("sequence_links", with_views(
    f"select id, rep, distance, {r6('identity')} as identity, {r6('coverage')} as coverage from links",
    "v_assay", extra=seq_links_ctes(SQ.IDENTITY)))
def q_sequence_links(spark, d):
    """C1 and C2 for sequences: pairs by edit identity."""
    return SQ.edit_links(V.v_assay(spark, d), "dms_id", "phenotype")


@query("sequence_clusters", _recursive(with_views("""
select coalesce(c.mn, f.rep, q.dms_id) as representative, q.dms_id as member
from (select distinct dms_id, phenotype from v_assay) q left join firsts f on f.s = q.phenotype
left join (select a, min(b) as mn from reach group by a) c on c.a = f.rep""", "v_assay",
    extra=seq_links_ctes(SEQ_CLUSTER_IDENTITY) + [
        ("und", "select id as a, rep as b from links where distance > 0 union select rep as a, id as b from links "
                "where distance > 0 union select rep, rep from firsts"),
        ("reach", "select a, b from und union select r.a, u.b from reach r join und u on u.a = r.b")])))
def q_sequence_clusters(spark, d):
    """C1-C3 for sequences: components of the edit-identity links."""
    seqs = V.v_assay(spark, d).select("dms_id", "phenotype")
    links = SQ.edit_links(seqs, "dms_id", "phenotype", identity=SEQ_CLUSTER_IDENTITY)
    return C.cluster_components(seqs, links.select("id", "rep"), "dms_id")


@query("attach_cluster", _recursive(with_views("""
select s.doc_id, s.category, c.representative as cluster from v_seq s left join clusters c on c.member = s.doc_id""",
                                               "v_seq", extra=CLUSTER_CTES)))
def q_attach_cluster(spark, d):
    docs = V.v_seq(spark, d).select("doc_id", "category")
    return SP.attach_cluster(docs, doc_clusters(spark, d), "doc_id")


DOC_SPLIT_CTES = CLUSTER_CTES + [
    ("dassign", "select s.doc_id, s.category, c.representative as cluster from v_seq s "
                "join clusters c on c.member = s.doc_id where s.text is not null and length(s.text) > 0"),
    ("dunits", "select distinct category, cluster from dassign"),
    ("dranked", f"""select category, cluster,
                           row_number() over (partition by category
                                              order by md5(concat('{SEED}', category, cast(cluster as varchar)))) as rn,
                           count(*) over (partition by category) as n from dunits"""),
]


MAKE_SPLITS_BODY = f"""
select a.doc_id, a.category, a.cluster,
       case when r.rn <= greatest(1, floor(r.n * {TEST_FRACTION}::double)) then 'test' else 'train' end as split
from dassign a join dranked r on r.category = a.category and r.cluster = a.cluster"""


@query("make_splits", _recursive(with_views(MAKE_SPLITS_BODY, "v_seq", extra=DOC_SPLIT_CTES)))
def q_make_splits(spark, d):
    """Dedup (first row per doc, non-empty text) -> shingle clustering ->
    attach cluster -> per-category split."""
    return _doc_split_pipeline(spark, d)[0]


def _doc_split_pipeline(spark, d):
    """T2 pipeline; returns (split, verified edges) so audits reuse the same edges."""
    seq = V.v_seq(spark, d).select("doc_id", "category", "text")
    uniq = U.distinct_first(seq, "doc_id", ["doc_id"], value="text")
    # the dedup has dealt the rows; ids and categories are read beside the sets, so texts move once
    sh = C.materialize(C.numbered(C.shingle_sets(uniq, "doc_id", "text", keep=["category"], md5=False)))
    verified = C.materialize(C.identity_coverage_filter(C.shingle_candidates(sh, positional=True), sh))
    cl = C.cluster_components(sh.select("id"), verified.select("id", "rep"))
    x = SP.attach_cluster(sh.select(F.col("id").alias("doc_id"), "category"), cl, "doc_id")
    split = SP.stratified_group_split(x, TEST_FRACTION, SEED, "per_category", id_col="doc_id") \
        .select("doc_id", "category", "cluster", "split")
    return split, verified


@query("cluster_tsv", _recursive(with_views("select representative, member from clusters", extra=CLUSTER_CTES)))
def q_cluster_tsv(spark, d):
    from gradus.sources import io
    from gradus.session import scratch_path
    path = scratch_path(spark, "clusters-tsv")
    io.write_cluster_tsv(doc_clusters(spark, d), path)
    return io.read_cluster_tsv(spark, path, "bigint")


# --------------------------------------------------------------- J8
@query("cross_split_similarity", with_views(f"""
select q.id as item_id, q.n_shingles, coalesce(b.max_shared, 0) as max_shared,
       {r6('coalesce(b.max_shared, 0) / q.n_shingles')} as max_containment, coalesce(b.n_hits, 0) as n_hits
from (select id, count(*) as n_shingles from bsh group by id) q
left join (select id, max(shared) as max_shared, count(*) as n_hits from (
             select b.id, d.id as cid, count(*) as shared from bsh b join sh d on d.h = b.h group by b.id, d.id) x
           group by id) b on b.id = q.id""",
    extra=shingle_ctes("documents", "doc_id", "text") + shingle_ctes("benchmark", "item_id", "text", "b")))
def q_cross_split_similarity(spark, d):
    bench = C.word_shingles(table(spark, d, "benchmark"), "item_id", "text")
    docs = table(spark, d, "documents")
    docs = C.word_shingles(docs, "doc_id", "text", distinct=False, partitions=fan_out(docs))
    return C.max_containment(bench, docs).select(
        F.col("id").alias("item_id"), "n_shingles", "max_shared", "max_containment", "n_hits")


# --------------------------------------------------------------- S4
@query("fasta_lines", with_views("""
select doc_id, 0 as line_no, concat('>', cast(doc_id as varchar), ' ', source) as line from v_seq
where text is not null and length(text) > 0
union all
select doc_id, cast(i + 1 as int) as line_no, substr(t, i * 60 + 1, 60) as line
from (select doc_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') as t,
             unnest(range(0, (length(text) + 59) // 60)) as i
      from v_seq where text is not null and length(text) > 0) q""", "v_seq"))
def q_fasta_lines(spark, d):
    from gradus.sources import io
    seq = V.v_seq(spark, d)
    return io.fasta_lines(seq, "doc_id", "text", "source", partitions=fan_out(seq))


# --------------------------------------------------------------- J2 / T3
@query("attach_category", with_views("""
select t.dms_id, t.assigned_category as category, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice as dms_score
from lineitem l join t1 t on t.dms_id = l.l_partkey where t.assigned_category <> 'excluded'""",
                                     "v_assay", extra=KW_CTES + [("t1", T1_SQL)]))
def q_attach_category(spark, d):
    cats = categorized(spark, d).filter(F.col("assigned_category") != "excluded") \
        .select("dms_id", F.col("assigned_category").alias("category"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("dms_id"), "l_orderkey", "l_linenumber",
                                            "l_suppkey", F.col("l_extendedprice").alias("dms_score"))
    return SP.attach_category(li, cats, "dms_id").select("dms_id", "category", "l_orderkey", "l_linenumber",
                                                        "l_suppkey", "dms_score")


T3_CATEGORY = "stability"


# T3 binding: an assay's sequence is its name four times, a variant's mutation sits at l_quantity
T3_MAX_LENGTH = 40


@query("category_training_set", with_views(f"""
select dms_id, l_orderkey, l_linenumber, l_suppkey, dms_score, score_norm, action, length(seq) as n_seq from (
  select v.dms_id, v.l_orderkey, v.l_linenumber, v.l_suppkey, v.dms_score,
         {r6('case when s.mx - s.mn < 1e-8 then 0.5 else (v.dms_score - s.mn) / (s.mx - s.mn) end')} as score_norm,
         case when length(v.seq) <= {T3_MAX_LENGTH} then 'keep' when v.pos >= {T3_MAX_LENGTH} then 'exclude' else 'truncate' end as action,
         case when length(v.seq) <= {T3_MAX_LENGTH} then v.seq when v.pos < {T3_MAX_LENGTH} then substr(v.seq, 1, {T3_MAX_LENGTH}) end as seq
  from (select l.l_partkey as dms_id, l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_extendedprice as dms_score,
               repeat(p.p_name, 4) as seq, cast(l.l_quantity as int) - 1 as pos
        from lineitem l join t1 t on t.dms_id = l.l_partkey join part p on p.p_partkey = l.l_partkey
        where t.assigned_category = '{T3_CATEGORY}') v
  join (select l_partkey as dms_id, min(l_extendedprice) as mn, max(l_extendedprice) as mx from lineitem group by 1) s
    on s.dms_id = v.dms_id
  where v.dms_id in (select dms_id from split where split = 'train')) x where action <> 'exclude'""",
    "v_assay", extra=BASE + SPLIT_PER_CAT))
def q_category_training_set(spark, d):
    """Variants of one category (S2/J2) on the train side of the split (P7), min-max normalised
    per assay over all of the assay's rows (W2) before the length rule (P6) drops or cuts any. The
    assays are chosen first, so only their rows are normalised."""
    from gradus.operators import rank as R
    from gradus.operators import text as T
    cats = categorized(spark, d).filter(F.col("assigned_category") == T3_CATEGORY) \
        .select("dms_id", F.col("assigned_category").alias("category"))
    cats = SP.id_in_split(cats, assay_split(spark, d), "train")
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("dms_id"), "l_orderkey", "l_linenumber",
                                            "l_suppkey", F.col("l_extendedprice").alias("dms_score"),
                                            F.concat(F.lit("A"), F.col("l_quantity").cast("int").cast("string"), F.lit("C")).alias("mutant"))
    x = SP.attach_category(li, cats, "dms_id")
    x = R.normalize_scores(x, "dms_id", "dms_score", "minmax", "score_norm")
    seqs = table(spark, d, "part").select(F.col("p_partkey").alias("dms_id"), F.repeat("p_name", F.lit(4)).alias("seq"))
    x = T.truncate_or_exclude(x.join(seqs, "dms_id"), "seq", "mutant", T3_MAX_LENGTH).filter(F.col("action") != "exclude")
    return x.select("dms_id", "l_orderkey", "l_linenumber", "l_suppkey", "dms_score", "score_norm", "action",
                    F.length("seq_out").cast("long").alias("n_seq"))


@query("leakage_audit_documents", _recursive(with_views(AUDIT_SQL, "v_seq", extra=DOC_SPLIT_CTES + [
    ("split", "select doc_id as dms_id, cast(doc_id as varchar) as protein, cast(cluster as varchar) as cluster, split "
              f"from ({MAKE_SPLITS_BODY}) z")])))
def q_leakage_audit_documents(spark, d):
    """J6 on the split of T2, with its real cluster table: the validation row that goes with the split."""
    split = _doc_split_pipeline(spark, d)[0]
    return SP.leakage_audit(split, "doc_id", "doc_id", "cluster")


@query("cross_split_edges", _recursive(with_views(f"""
select count(*) as n_cross_edges, {r6('max(v.identity)')} as max_identity
from verified v join dsplit a on a.doc_id = v.id join dsplit b on b.doc_id = v.rep
where a.split <> b.split""", "v_seq", extra=DOC_SPLIT_CTES + [("dsplit", MAKE_SPLITS_BODY)])))
def q_cross_split_edges(spark, d):
    """J8 on the split (the promised similarity check): verified similarity edges whose
    two ends landed on different sides, and the highest identity among them."""
    split, verified = _doc_split_pipeline(spark, d)
    # each edge is exploded into its two ends and joined to the split once
    ends = verified.select("id", "rep", "identity", F.explode(F.array("id", "rep")).alias("doc_id"))
    per = ends.join(split.select("doc_id", "split"), "doc_id").groupBy("id", "rep").agg(
        F.max("identity").alias("identity"), F.countDistinct("split").alias("_sides"))
    x = per.filter(F.col("_sides") == 2)
    return x.agg(F.count(F.lit(1)).alias("n_cross_edges"), F.max("identity").alias("max_identity"))
