"""A training-data pipeline of five corpus operators, each stage written as Parquet and read again by the next.

quality classifier -> exact dedup -> SimHash near-dedup -> mixing to target weights -> best-fit packing.  All
stages but the last return the columns of documents, further ones whatever their names included; packing returns one row per
piece with its place.  Every stage reads whole texts and all rows, takes a null text as empty and a null id as an id like
any other, and returns an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.llm import exact_dedup, mixing, packing, quality_model, simhash
from symloom.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from the labels of sf_dir.  Rows that repeat get one verdict, and ties at
    the threshold stay.  Without labels of both classes the score is their share with one of each added, so all stay or go."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones being equal, the document with the largest id, null ids last; of rows that repeat id and
    text, one."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id, null ids last; texts without a word are near each
    other; of rows that repeat id and text, one."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, the last one.  Texts without a word take part with no
    words.  Rows that repeat every column are interchangeable.  Ties are settled by size, hash of the row and id."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a document taken twice is packed twice, an empty one is its end
    token, and one longer than a sequence is cut, the shorter piece first."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_neardup", near_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express a trained model, a cube sample or a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
