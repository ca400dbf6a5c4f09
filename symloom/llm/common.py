"""What the corpus operators share: reading tables, shared scratch tables, ASCII folding, row keys.

Conventions that hold for every operator of this package:

* ``documents`` needs the columns ``doc_id`` and ``text`` (and ``source`` for mixing).  Other columns
  are carried along only where an operator returns rows of documents; they are packed into one struct
  at the start, so that names used inside an operator can't clash with them.
* A null text counts as the empty text.  A null doc_id is an ordinary (null) id.
* Nothing is cached in executors only: intermediate results are written to the shared folder that the
  session names in ``spark.checkpoint.dir`` and read again, so a lost executor costs a recomputation of
  single tasks at most.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.skew import salted_join
from symloom.sources.scratch import delete_now, forget, materialize
from symloom.sources.scratch import path_for as scratch_path

__all__ = ["delete_now", "forget", "materialize", "salted_join", "scratch_path"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of text that go to a Python worker at once.  Spark's own default, 10,000, is some 30 MB of short documents and
#: far more of long ones, and both sides keep buffers of the largest batch.
BATCH_ROWS, _BATCH_CONF = 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's rows a batch to BATCH_ROWS if they are more, for all that the session runs later: plans take the
    setting when they run, so it can't be set for one plan.  The change is logged."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        logging.getLogger("symloom").warning("%s is lowered to %d for this session", _BATCH_CONF, BATCH_ROWS)
        conf.set(_BATCH_CONF, BATCH_ROWS)
    return df


def one_of_each(docs: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``row``, a struct of all columns of docs, and the keys, given in terms of ``row``: one row per key, whichever comes
    first.  Repeats go before the shuffle already, so a key that many rows share costs one row per task."""
    rows = packed(docs).select("row", *[c.alias(k) for k, c in keys.items()])
    return rows.groupBy(*keys).agg(F.first("row").alias("row"))


def text_of(column: Column | str = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  lower() is the faster way and the same where a text is all ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def packed(docs: DataFrame) -> DataFrame:
    """One struct column ``row`` with all columns of docs: no later name can clash with them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def row_hash(docs: DataFrame, column) -> Column:
    """A hash of all columns of docs; column(name) gives each of them.  Maps, which Spark doesn't hash, count as JSON text."""
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(column(c).alias("v"))) if c in maps else column(c) for c in docs.columns])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
