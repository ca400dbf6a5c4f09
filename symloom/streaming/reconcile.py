"""Keeping an index fresh from a stream of file rows: each batch refreshes what changed and only that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import index
from symloom.schema import FILES


def check(files: DataFrame, state: DataFrame) -> dict:
    """One pass that writes nothing: the health row and whether all is well."""
    return index.health(files, state).first().asDict()


class ReconcileError(RuntimeError):
    """An index that no cycle can repair."""


def cycle(files: DataFrame, state: DataFrame, refresh: Callable[[DataFrame], None], dry_run: bool = False, plan: str = "none", migrate: Callable[[], None] | None = None) -> dict:
    """One poll of an index whose plan is none, migrate, rebuild or manual.  healthy; or migrated, for an older schema; or
    refreshed, after what is stale, missing or unindexed was read again; a dry run reports would_migrate or would_refresh and
    writes nothing.  An index that has to be looked at by hand is an error."""
    if plan == "manual":
        raise ReconcileError("this index has to be looked at by hand")
    if plan == "migrate":
        if dry_run:
            return {"event": "would_migrate", "ok": False}
        if migrate is None:
            raise ReconcileError("no way to migrate")
        migrate()
        return {"event": "migrated", "ok": False}
    report = check(files, state)
    if report["ok"] and plan == "none":
        return report | {"event": "healthy"}
    if dry_run:
        return report | {"event": "would_refresh"}
    refresh(index.freshness(files, state).filter("status <> 'fresh'"))
    return report | {"event": "refreshed"}


def watch(spark: SparkSession, folder: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Follows Parquet drops of file rows; every batch goes to on_batch once, with fingerprints.  Ends when all is read."""
    rows = spark.readStream.schema(FILES).parquet(folder).withColumn("fingerprint", F.md5("source"))
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start()
