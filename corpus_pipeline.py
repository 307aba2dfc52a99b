"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing of
sources, token-id output. Each stage reads what the one before it wrote."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import decontam, langid, mixing, ngram_join, tokens
from gradus.llm.common import save, scratch_path, table
from gradus.llm.queries import END_ID, tokenizer_path


def _packed(docs: DataFrame) -> DataFrame:
    """(packed: the whole row, text): operators add columns beside it, whatever the input's columns are called."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed"), F.col("text"))


def _unpacked(judged: DataFrame, packed: str, columns: list[str]) -> DataFrame:
    return judged.select(*[F.col(packed).getField(c).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is in a learned language; those without a letter, and those that
    no language explains, go. Trees are learned from the labelled rows of ``docs``; where no row is
    labelled, every text with a letter stays."""
    trees = langid.fit(docs)
    if not trees.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(_packed(docs), trees, keep=["packed"])
    return _unpacked(judged.where(langid.accepted()), "packed", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest doc_id. Five
    words an n-gram, similarity 0.8 or more. Documents without words have no duplicates and stay."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lie in benchmark passages go."""
    found = decontam.matches(_packed(docs), table(spark, sf_dir, "benchmark"), doc_id="packed")
    return _unpacked(decontam.digest(found).where("not contaminated"), "doc_id", docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights, in globally shuffled order."""
    return mixing.poisson_mix(docs, added=False)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards with their index below the scratch folder; per document what the files hold."""
    folder, path = scratch_path(spark, "pipeline-tokens"), tokenizer_path()
    tokens.write_tokens(docs, folder, path, END_ID)
    return tokens.read_tokens(tokens.row_keys(docs), folder, tokens.id_type(path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", token_output),
]

#: Language ID and near-duplicate components aren't expressible together with tokenization in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        gc.collect()  # a stage's models and broadcasts end with it
    return docs
