"""Exact deduplication with a persistent digest index [native].

The index is a Parquet table, bucketed and sorted by the SHA-256 of the normalised text.  A batch is reduced to one row per
digest and anti-joined with the index by sort-merge (the index side needs no exchange).  What is left is new: it decides which
rows stay, and is appended.  The digests that the index knew already are joined with it only to name the row that stands
for them; no row of the batch stays for these.  Only DataFrame operations are used.

Every batch leaves a further sorted file per bucket; ``compact`` writes the index anew with one, and ``add`` does so by itself
when a bucket has over ``MAX_FILES``.  A compacted index is a new generation beside the old one and counts once it is whole.

Defined results: a null text equals the empty text; texts are equal when identical after lower-casing
A-Z; of equal texts the row with the largest doc_id stays, null ids last; rows that repeat both id
and text count in group_size, and exactly one of them is kept; a text that an earlier batch brought isn't kept again, not
even under its old id; texts of any length are hashed whole; other columns, whatever their names, are carried along by
``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import ascii_lower, delete_now, materialize, one_of_each, partitions, salted_join, scratch_path, text_of, unpacked

#: Files of a bucket beyond which ``add`` compacts; copies of one id and text that a row of the pre-aggregated batch stands for.
MAX_FILES, PART = 16, 1 << 16


def digest(text: F.Column = None):
    """32 bytes: half the size of the hexadecimal form in shuffles and in the index."""
    return F.unhex(F.sha2(ascii_lower(text_of("text") if text is None else text), 256))


class DigestIndex:
    """``DigestIndex(spark, root)`` opens the index below ``root`` or makes one of ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        found = self._generations()
        if found and buckets and found[-1][1] != buckets:
            raise ValueError(f"the index at {root} has {found[-1][1]} buckets")
        self.generation, self.buckets = found[-1] if found else (0, buckets or partitions(spark))
        self.name = self._declared(self.generation)

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _path(self, generation: int) -> str:
        return f"{self.root}/digests_g{generation}_buckets_{self.buckets}"

    def _generations(self) -> list[tuple[int, int]]:
        """(generation, buckets) of what is there; a later generation counts once Spark has marked it as whole."""
        fs, at = self._fs(f"{self.root}/digests_g*_buckets_*")
        out = []
        for s in fs.globStatus(at) or []:
            named = re.search(r"digests_g(\d+)_buckets_(\d+)$", str(s.getPath()))
            if named and (named[1] == "0" or fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])):
                out.append((int(named[1]), int(named[2])))
        return sorted(out)

    def _declared(self, generation: int) -> str:
        name = f"symloom_digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._path(generation)}'"
        )
        return name

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> int:
        """The most data files that a bucket has."""
        fs, at = self._fs(f"{self._path(self.generation)}/part-*")
        count: dict[str, int] = {}
        for s in fs.globStatus(at) or []:
            bucket = re.search(r"_(\d+)(?:\.c\d+)?\.[^/]*$", str(s.getPath()))
            count[bucket[1] if bucket else ""] = count.get(bucket[1] if bucket else "", 0) + 1
        return max(count.values(), default=0)

    def _put(self, rows: DataFrame, name: str) -> None:
        rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (digest, doc_id, n), n rows each.  Appends its new digests; returns one row per digest of the batch: digest,
        keep_id, group_size, fresh, copies.  A fresh digest stands by the batch's largest id, which has ``copies`` rows; another
        one by the id that an earlier batch brought, and nothing of the batch stays for it."""
        top = F.max(F.struct("doc_id", "n")).alias("top")
        groups = batch.groupBy("digest").agg(top, F.sum("n").alias("group_size"))
        groups = groups.select("digest", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.n").alias("copies"))
        known = self.table().select("digest", F.col("keep_id").alias("known_id")).hint("merge")
        fresh = materialize(groups.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True)), "digests-fresh")
        verdicts = fresh.select("digest", "keep_id", "group_size", "fresh", "copies")
        if self.files():
            old = groups.join(known, "digest").select("digest", F.col("known_id").alias("keep_id"), "group_size", F.lit(False).alias("fresh"), "copies")
            verdicts = verdicts.unionByName(materialize(old, "digests-old"))
        self._put(fresh, self.name)
        if self.files() > MAX_FILES:
            self.compact()
        return verdicts

    def compact(self) -> None:
        """Writes the index as a new generation of one sorted file per bucket, then removes older ones."""
        new = self.generation + 1
        delete_now(self.spark, self._path(new))  # what a run that died may have left
        name = self._declared(new)
        # read as plain files: Spark would drop the exchange of a bucketed scan, and then the buckets of that scan
        self._put(self.spark.read.schema(self.table().schema).parquet(self._path(self.generation)), name)
        old, self.name, self.generation = self.name, name, new
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        for generation in range(new):
            delete_now(self.spark, self._path(generation))

    def close(self) -> None:
        """Forgets the table's name; the files stay and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def counted(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, n), written: rows that repeat id and text become one before they are shuffled."""
    rows = docs.select(digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
    return materialize(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")


def decisions(docs: DataFrame, index_root: str | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.  index_root: a lasting index; without it
    the batch meets an empty one.  Ids are taken as long."""
    spark = docs.sparkSession
    batch = counted(docs)
    index = DigestIndex(spark, index_root or scratch_path(spark, "digest-index"), buckets)
    try:
        verdicts = index.add(batch)
    finally:
        index.close()
    runs = batch.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PART}"))))
    met = salted_join(runs, verdicts, ["digest"], "group_size", F.xxhash64("doc_id", "run"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PART).cast("long"), F.col("n") - F.col("run") * PART)))
    first = (F.col("run") == 0) & (F.col("nth") == 1)
    return met.withColumn("nth", nth).select(
        "doc_id", "keep_id", "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index_root: str | None = None, buckets: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns.  Rows meet their verdict by (digest, doc_id), so a group of copies
    is spread by its ids; rows that repeat both become one before they are shuffled."""
    spark = docs.sparkSession
    index = DigestIndex(spark, index_root or scratch_path(spark, "digest-index"), buckets)
    try:
        verdicts = index.add(counted(docs))
    finally:
        index.close()
    # a null id joins as the least long, so that aggregation and join can share one exchange
    as_key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    keys = verdicts.filter("fresh").select("digest", as_key("keep_id").alias("id"))
    rows = one_of_each(docs, {"digest": digest(text_of(F.col("row.text"))), "id": as_key("row.doc_id")})
    return unpacked(rows.join(keys.hint("merge"), ["digest", "id"], "left_semi"), docs)


SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS h
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
