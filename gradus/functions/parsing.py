"""Column expressions for mutation strings (``A1P:D2N``); all JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tokens(mutant: Column) -> Column:
    return F.when(mutant.isNull() | (mutant == ""), F.array().cast("array<string>")) \
            .otherwise(F.split(mutant, ":"))


def mutation_positions(mutant: Column) -> Column:
    """Rule (a): for each token, the digits right after its first character, up to the
    first non-digit; tokens without such digits are dropped; 0-based -> ARRAY<BIGINT>."""
    digits = F.transform(_tokens(mutant), lambda x: F.regexp_extract(x, r"^.([0-9]+)", 1))
    kept = F.filter(digits, lambda s: s != "")
    return F.transform(kept, lambda s: s.cast("bigint") - 1)


def parse_mutations(mutant: Column) -> Column:
    """Rule (b): wild type = first char, mutant = last char, position = every digit
    between them; tokens with no digit there are dropped ->
    ARRAY<STRUCT<wt STRING, pos BIGINT, mut STRING>> (pos 0-based)."""
    toks = _tokens(mutant)
    parsed = F.transform(toks, lambda x: F.struct(
        F.substring(x, 1, 1).alias("wt"),
        F.regexp_replace(x.substr(F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))), "[^0-9]", "").alias("d"),
        F.when(F.length(x) > 0, F.substring(x, -1, 1)).otherwise(F.lit("")).alias("mut")))
    kept = F.filter(parsed, lambda s: s["d"] != "")
    return F.transform(kept, lambda s: F.struct(s["wt"].alias("wt"), (s["d"].cast("bigint") - 1).alias("pos"),
                                                 s["mut"].alias("mut")))
