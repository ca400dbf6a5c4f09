"""Labelled samples for the classifiers: which rows may be learned from, and a bounded choice of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import bounded_batches, id_bucket, text_of
from symloom.sources.scratch import materialize_parts

#: Rows whose crc32(doc_id as text) mod FOLDS is 0 are held out.
FOLDS = 5
SPARE, RANGE = 1.5, 1 << 40
#: Bytes of text that a sample has at most.
MOST_BYTES = 48 << 20
#: Labelled rows are written in so many pieces.
PIECES = 4


def held_out(column: str = "doc_id"):
    return id_bucket(column, FOLDS) == 0


def _smallest(known: DataFrame, rows: int) -> DataFrame:
    """The rows with the smallest hash.  Of many, a bound on the hash leaves about SPARE times as many as are asked for, so
    that the last step doesn't get ``rows`` rows from every partition of the label table."""
    order = F.pmod(F.xxhash64("doc_id"), F.lit(RANGE))
    n = known.count()
    few = known if n <= SPARE * rows else known.filter(order < int(RANGE * SPARE * rows / n))
    return few.orderBy(order, "doc_id").limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, per_class: bool, prepare, kind: str, most_bytes: int = MOST_BYTES) -> list:
    """Rows (doc_id, lang, label, x) with x = prepare(text as bytes): at most ``rows`` of them, for each class
    if per_class, those with the smallest hash of their id.  The choice is made on the label table and is
    bounded, so it may be broadcast; of the documents only x comes to the driver.  Of several labels for
    an id the largest counts; null labels and ids don't count.

    If the texts of these rows have over ``most_bytes`` bytes in all, rows are taken in the order of that hash, in turn from
    each class, while their whole texts fit: the sample is bounded in rows and in bytes, and no text is cut."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [known.filter(F.col("y") == c) for c in (0, 1)] if per_class else [known]
    chosen = [_smallest(p, rows) for p in parts]
    ids = chosen[0].unionAll(chosen[1]) if per_class else chosen[0]
    spark = docs.sparkSession
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows_ = bounded_batches(docs).select("doc_id", lang.alias("lang"), text_of().alias("text"))
    ids = spark.createDataFrame(ids.select(F.col("doc_id").cast("long"), "y").collect(), "doc_id long, y int")  # 2 * rows at most
    place = F.pmod(F.xxhash64("doc_id"), F.lit(RANGE)).alias("place")
    sizes = rows_.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.sum("size").alias("size"))
    fit = within_bytes(sizes.select("doc_id", "y", "size", place).collect(), most_bytes)
    few = spark.createDataFrame(fit, "doc_id long, y int")
    schema = f"doc_id long, lang string, y int, x {kind}"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [prepare(t.as_buffer().to_pybytes()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("lang"), b.column("y").cast(pa.int32()), pa.array(x, pa.binary() if kind == "binary" else pa.list_(pa.float32()))],
                ["doc_id", "lang", "y", "x"],
            )

    got = rows_.join(F.broadcast(few), "doc_id").select("doc_id", "lang", "text", "y")
    return sorted(got.mapInArrow(run, schema).collect(), key=lambda r: (r["doc_id"], r["x"]))


def every(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, lang, y, text (as bytes) of all rows that may be learned from, as sample defines them, written once, in PIECES by a hash of
    the id: texts are shuffled to meet their labels, and the disk holds the shuffle of one piece at a time."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = bounded_batches(docs).filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_of().alias("text"))

    def piece(k: int) -> DataFrame:
        own = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)) == k
        marks = known.filter(own).groupBy("doc_id").agg(F.max("y").alias("y"))
        return rows.filter(own).join(marks.hint("merge"), "doc_id").select("doc_id", "lang", "y", "text")

    return materialize_parts([piece(k) for k in range(PIECES)], "labelled")


def within_bytes(found: list, most_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, y) of those whole texts that fit, both classes in turn, each by place."""
    order = [sorted((r for r in found if r["y"] == c), key=lambda r: (r["place"], r["doc_id"])) for c in (0, 1)]
    turns = sorted(((nth / max(1, len(own)), c, r) for c, own in enumerate(order) for nth, r in enumerate(own)), key=lambda t: t[:2])
    out, used = [], 0
    for _, c, r in turns:
        if used + r["size"] <= most_bytes:
            out.append((r["doc_id"], c))
            used += r["size"]
    return out
