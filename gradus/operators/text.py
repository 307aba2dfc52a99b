"""Categorisation and variant-preparation operators.

Every decision is one projection of column expressions (codegen'd); keyword
sets and type maps are small fixed parameters inlined as literals, so no join
or broadcast is needed for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.functions import parsing

# Fixed values of the categorisation rules (the harness binding of FIXTURES.md):
# coarse type -> category map; unknown types get DEFAULT_CATEGORY
TYPE_MAP = {"MEDIUM": "stability", "STANDARD": "binding", "LARGE": "expression"}
DEFAULT_CATEGORY = "activity"
RECLASSIFY_TYPE = "OrganismalFitness"
# keywords per category, in priority order (ties go to the earlier category)
KEYWORDS = {
    "stability": ["ring", "rod"],
    "activity": ["widget", "red"],
    "binding": ["plate", "hot"],
    "expression": ["small", "blue"],
}
MIN_MUTATIONS = 25
CATEGORIES = ["stability", "binding", "expression", "activity"]


def search_text(*fields: str) -> Column:
    """Lower-cased space-joined text of the given fields (NULL fields are skipped)."""
    return F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))


def min_size_filter(df: DataFrame, size: str = "num_mutants", min_size: int = MIN_MUTATIONS) -> DataFrame:
    """Flag groups smaller than ``min_size``; a NULL size is kept."""
    small = F.col(size) < min_size
    reason = F.concat(F.lit("too_few_mutations ("), F.col(size).cast("string"),
                      F.lit(f" < {min_size})"))
    return df.withColumn("excluded", F.coalesce(small, F.lit(False))) \
             .withColumn("reason", F.when(small, reason))


def direct_map(df: DataFrame, type_col: str = "coarse_type",
               mapping: Mapping[str, str] = TYPE_MAP, out: str = "mapped_category") -> DataFrame:
    """Coarse type -> category through a literal map (NULL when unmapped)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.element_at(m, F.col(type_col)))


def keyword_hits(text: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """ARRAY<STRUCT<category, priority, n_hits, matched ARRAY<STRING>>> — for each
    category the keywords contained in ``text`` (plain substring match).

    The text and each category's match list are bound once as lambda variables, so a
    long text is lowered once and every keyword is tested once per row."""
    cats = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(prio).alias("priority"),
                              F.array(*[F.lit(k.lower()) for k in kws]).alias("kws"))
                     for prio, (cat, kws) in enumerate(keywords.items())])

    def per_text(t: Column) -> Column:
        def per_cat(c: Column) -> Column:
            found = F.array(F.filter(c["kws"], lambda k: t.contains(k)))
            return F.element_at(F.transform(found, lambda h: F.struct(
                c["category"].alias("category"), c["priority"].alias("priority"),
                F.size(h).alias("n_hits"), h.alias("matched"))), 1)
        return F.transform(cats, per_cat)

    return F.element_at(F.transform(F.array(text), per_text), 1)


def keyword_argmax(hits: Column) -> Column:
    """O3: the category with most hits, the earliest in priority order on ties;
    NULL when nothing matched. Returns STRUCT<n_hits, neg_priority, category, matched>."""
    ranked = F.transform(hits, lambda h: F.struct(h["n_hits"].alias("n_hits"), (-h["priority"]).alias("neg_priority"),
                                                  h["category"].alias("category"), h["matched"].alias("matched")))
    best = F.array_max(ranked)
    return F.when(best["n_hits"] > 0, best)


def categorize(assay: DataFrame, text_fields: Sequence[str] = ("phenotype",), id_col: str = "dms_id",
               type_col: str = "coarse_type", size_col: str = "num_mutants",
               min_size: int = MIN_MUTATIONS, mapping: Mapping[str, str] = TYPE_MAP,
               keywords: Mapping[str, Sequence[str]] = KEYWORDS,
               default: str = DEFAULT_CATEGORY, keep: Sequence[str] = ()) -> DataFrame:
    """Decision table (dms_id, original_type, assigned_category, matched_keywords,
    confidence, reason, num_mutants[, keep...]) — size rule, then direct map, then keyword
    reclassification of ``OrganismalFitness``, else the default category. ``keep``
    carries extra input columns through (no second read of the input for them)."""
    x = direct_map(min_size_filter(assay, size_col, min_size), type_col, mapping, "_mapped")
    best = keyword_argmax(keyword_hits(search_text(*text_fields), keywords))
    x = x.withColumn("_best", F.when(F.col(type_col) == RECLASSIFY_TYPE, best))
    empty = F.array().cast("array<string>")
    cat = (F.when(F.col("excluded"), F.lit("excluded"))
           .when(F.col("_mapped").isNotNull(), F.col("_mapped"))
           .when(F.col("_best").isNotNull(), F.col("_best.category"))
           .otherwise(F.lit(default)))
    conf = (F.when(F.col("excluded"), F.lit("N/A"))
            .when(F.col("_mapped").isNotNull(), F.lit("high"))
            .when(F.col("_best").isNotNull(), F.lit("medium"))
            .otherwise(F.lit("low")))
    kw = F.when(F.col("_best").isNotNull() & ~F.col("excluded") & F.col("_mapped").isNull(),
                F.col("_best.matched")).otherwise(empty)
    return x.select(F.col(id_col).alias("dms_id"), F.col(type_col).alias("original_type"),
                    cat.alias("assigned_category"), kw.alias("matched_keywords"),
                    conf.alias("confidence"), "reason", F.col(size_col).alias("num_mutants"), *keep)


def truncate_or_exclude(df: DataFrame, seq: str, mutant: str, max_length: int) -> DataFrame:
    """Sequences longer than ``max_length`` are excluded when a mutated position
    (rule a) lies at or past the cut, else truncated. Adds ``action``
    (keep/truncate/exclude) and ``seq_out`` (NULL for excluded rows)."""
    pos = parsing.mutation_positions(F.col(mutant))
    long_ = F.length(F.col(seq)) > max_length
    beyond = (F.size(pos) > 0) & (F.array_max(pos) >= max_length)
    action = (F.when(~long_ | F.col(seq).isNull(), F.lit("keep"))
              .when(beyond, F.lit("exclude")).otherwise(F.lit("truncate")))
    out = (F.when(F.col("action") == "keep", F.col(seq))
           .when(F.col("action") == "truncate", F.substring(F.col(seq), 1, max_length)))
    return df.withColumn("action", action).withColumn("seq_out", out)


def smoke_subset(assays: DataFrame, variants: DataFrame, n_assays: int, n_variants: int,
                 group: str = "assigned_category", id_col: str = "dms_id",
                 variant_id: str = "dms_id", variant_key: Sequence[str] = ()) -> DataFrame:
    """First ``n_assays`` assays per category (by id) and at most ``n_variants``
    variants per assay (by key). Both limits are ``row_number() <= n`` filters,
    which Spark turns into partial top-n before the shuffle."""
    wa = Window.partitionBy(group).orderBy(id_col)
    picked = assays.withColumn("_ra", F.row_number().over(wa)).filter(F.col("_ra") <= n_assays) \
                   .select(group, F.col(id_col).alias(variant_id))
    v = variants.join(picked, variant_id, "inner")
    wv = Window.partitionBy(variant_id).orderBy(*variant_key)
    return v.withColumn("_rv", F.row_number().over(wv)).filter(F.col("_rv") <= n_variants).drop("_rv")
