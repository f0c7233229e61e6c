"""The corpus pipeline: documents to mixed, deduplicated, pseudonymised token sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as a Parquet table
in the shared folder and read again as the next stage's docs. All but the last return the columns
of documents. A stage begins by giving back what the stages before it needed of the driver's memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, jaccard, langid, mixing, pii
from quire.llm.common import fold, release, table, written
from quire.llm.queries import PIECES, pii_key, vocabulary
from quire.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; learn from the same documents' labels as op9 does.

    Null, empty and letterless texts go. Null ids and languages never teach; rows that repeat are
    kept each, very long texts are scored whole, ties go to the first language name and are kept.
    Without any labelled row no language can be told and nothing stays. All columns stay, whatever
    their names; an empty table stays empty.
    """
    ship(spark)
    release(spark)
    return langid.accepted(docs, docs.filter(fold(F.col("doc_id"), 4) != 2), vocabulary(PIECES))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones, that with the smallest id.

    Texts without words (null, empty) are groups of their own. Of a group with ids, rows without one
    go; rows that repeat the id that stays are one document and all stay. Whole texts count, however
    long. All columns stay, whatever their names; an empty table stays empty.
    """
    ship(spark)
    release(spark)
    return jaccard.one_per_component(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format; n_chars follows the text.

    Rows stay one to one, repeats included; null and clean texts stay as they are, with their
    n_chars. Long texts are searched whole. All columns stay, whatever their names; an empty table
    stays empty.
    """
    release(spark)
    columns = docs.columns
    out = pii.pseudonymised(docs, pii_key(spark))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    # columns of these names were set aside by the operator
    kept = [F.col(f"`{c}`") for c in columns if c not in ("n_pii", "pii_kinds")]
    return out.select(*kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources have their target weights.

    A document is there as often as the mix takes it, to the nearest whole number; one without
    words is never taken. A null source is a source, the last in order; rows that repeat an id get
    equal numbers of copies, rows without an id share one number. The same rows come out on every
    run. All columns stay, whatever their names; an empty table stays empty.
    """
    release(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: doc_id, n_tokens, ids, decoded_sha256.

    A null or empty text has no tokens. Rows that repeat are encoded each, long texts whole; other
    columns are not read; an empty table stays empty.
    """
    ship(spark)
    release(spark)
    return bpe.encode_documents(docs, vocabulary()).select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, keyed permutations and the schedule's hashes have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
