"""Session buffers as folds of an ordered edit log, in batch and as a stateful stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.operators.patch import spliced


def latest(log: DataFrame) -> DataFrame:
    """log: (path, version, source).  The newest source of each path, and how many rows it had."""
    return log.groupBy("path").agg(F.max("version").alias("version"), F.max_by("source", "version").alias("source"), F.count(F.lit(1)).alias("edits"))


def folded(log: DataFrame, disk: Column) -> DataFrame:
    """log: (path, version, start, end, new_text), byte edits.  Each path's edits are applied to disk in the order of
    their versions; of a repeated version the first text by order counts once.  path, source, version (number of edits), dirty."""
    w = Window.partitionBy("path", "version").orderBy("start", "end", "new_text")
    once = log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    edits = F.array_sort(F.collect_list(F.struct("version", "start", "end", "new_text")))
    grouped = once.groupBy("path").agg(edits.alias("edits"))
    source = F.aggregate("edits", disk, lambda text, e: spliced(text, e["start"], e["end"], e["new_text"]))
    return grouped.select("path", source.alias("source"), F.size("edits").cast("long").alias("version"), (source != disk).alias("dirty"))


def status(buffers: DataFrame, dirty_only: bool = False) -> DataFrame:
    rows = buffers.filter("dirty") if dirty_only else buffers
    return rows.select("path", "version", "dirty").orderBy("path")


def overrides(buffers: DataFrame) -> DataFrame:
    """Dirty buffers as an overlay of files."""
    return buffers.filter("dirty").select(F.col("path").alias("file_path"), "source")


def streamed(log: DataFrame) -> DataFrame:
    """A stream of full-text edits (path, version, source): the state of each path is its newest version with its text; older
    and repeated versions are refused, of a version that comes twice in a batch the first text by order stays.  Emits path,
    version, accepted, refused and the text with its digest, per batch and path."""
    import hashlib

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def advance(key, frames, state):
        version, source = state.get if state.exists else (-1, "")
        accepted = refused = 0
        edits = sorted((v, t or "") for f in frames for v, t in zip(f["version"].tolist(), f["source"].tolist(), strict=True))
        for v, text in edits:
            if v > version:
                version, source, accepted = v, text, accepted + 1
            else:
                refused += 1
        state.update((version, source))
        digest = hashlib.md5(source.encode()).hexdigest()
        yield pd.DataFrame({"path": [key[0]], "version": [version], "accepted": [accepted], "refused": [refused], "source": [source], "digest": [digest]})

    out = "path string, version long, accepted long, refused long, source string, digest string"
    return log.groupBy("path").applyInPandasWithState(advance, out, "version long, source string", "update", GroupStateTimeout.NoTimeout)
