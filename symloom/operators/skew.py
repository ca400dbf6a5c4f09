"""Joins and choices that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with over 1/HOT of all rows are dealt to several tasks: at most HOT keys, so their list may be broadcast.
HOT = 256


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, salt: Column, how: str = "inner") -> DataFrame:
    """rows joined with facts, which are cheap to read, have one row per key (never null) and say in ``n`` how many of rows have
    it, or about how many.  A key with over 1/HOT of these rows is split by ``salt`` into as many parts as it has such shares,
    and its fact is repeated for each part: at most 2 HOT more rows, whatever the input.  The columns of both."""
    total = facts.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // HOT)
    parts = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("int")
    hot = facts.filter(F.col(n) > share).select(*keys, parts.alias("_parts"))
    left = rows.join(F.broadcast(hot), keys, "left")
    left = left.withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(salt, F.col("_parts"))).cast("int")).drop("_parts")
    right = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right.hint("merge"), [*keys, "_part"], how).drop("_part")
