"""A corpus pipeline over `documents`: five stages, each an operator of wayweft.llm whose decisions take effect.

Every stage decides on rows, not on ids: a null or repeated id, or a repeated row, is judged by its own text, and
columns beside doc_id, text and lang pass unchanged whatever their names (n_chars follows a text that changes). Each
takes an empty table and texts of any length. A stage's rows may need tables that it wrote to the scratch folder; the
next call of a later stage on the same session deletes them, so a stage's rows must be written by then (run() does).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayweft.llm import exact_dedup, language_id, near_dedup, packing, scratch, secret_scan

#: Least posterior probability of the predicted language.
LEAST_SCORE = 0.5

#: Tables of the stages so far whose rows have not been replaced by a later stage's.
_open: list[tuple[SparkSession, scratch.Scope]] = []


def _release(spark: SparkSession) -> None:
    for one in [x for x in _open if x[0] is spark]:
        _open.remove(one)
        one[1].release()


def _with_tables(spark: SparkSession, build) -> DataFrame:
    _release(spark)
    with scratch.scope() as tables:
        out = build()
    _open.append((spark, tables))
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no clear language go: null, empty and blank texts, those without a letter, and those whose best
    language has a posterior below LEAST_SCORE. Training reads the labelled rows of docs itself; with no labelled row
    every document goes. Equal texts fare alike."""
    model = language_id.train(language_id.labelled(docs), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.clear(docs, model, LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, exactly one row stays, that of the largest id (null ids last; of repeated rows any one). A null
    text equals an empty one."""
    return _with_tables(spark, lambda: exact_dedup.keep_one(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more, linked directly or through
    others), exactly one row stays, that of the smallest id (null ids last). Texts without words have no near-duplicates;
    all of them stay."""
    return _with_tables(spark, lambda: near_dedup.keep_one(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds in brackets; every document stays, null and empty texts as they
    are. It reads docs alone and writes no tables."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4096 tokens. A null or empty text is one piece of
    one token; repeated and null ids are pieces of their own, under their ids."""
    return _with_tables(spark, lambda: packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("best_fit_packing", pack)]

#: Language models, components and packings are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each other stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        _release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
