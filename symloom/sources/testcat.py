"""The driver's tables seen as a code catalogue: symbols, edges, files, states and edits.

The same projection stands in ``SQL`` for the oracle, so a query and its oracle start from one relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.expr import base_name, parent_path
from symloom.sources.scratch import alive, materialize, materialize_parts, release

#: Written symbols and edges by session, folder and the state of its files: the catalogue's index, made once.
_WRITTEN: dict[tuple, DataFrame] = {}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _state(spark: SparkSession, sf: str) -> tuple:
    """Length and time of the catalogue's tables."""
    out = []
    for name in _TABLES:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def _written(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name, _state(spark, sf))
    if key not in _WRITTEN or not alive(_WRITTEN[key]):
        made = make(spark, sf)
        _WRITTEN[key] = materialize_parts(made, f"catalogue-{name}") if isinstance(made, list) else materialize(made, f"catalogue-{name}")
    return _WRITTEN[key]


def _people(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select("n_nationkey", "n_name", "r_name")  # 25 rows


def raw_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations before ids: path, kind, file, range, signature, parameters, return type."""
    nation = F.broadcast(_people(spark, sf))
    row = lambda df, path, kind, file, at, sig, par, ret: df.select(
        path.alias("semantic_path"), F.lit(kind).alias("node_kind"), file.alias("file_path"), at.cast("long").alias("start_byte"), (at + 9).cast("long").alias("end_byte"),
        sig.cast("string").alias("signature"), par.alias("parameter"), ret.cast("string").alias("return_type"),
    )
    c, none = F.concat, F.lit(None).cast("string")
    file = c(F.lit("/ws/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".py"))
    path = c(F.col("r_name"), F.lit("::"), F.col("n_name"))
    region = read(spark, sf, "region")
    parts = [
        row(region, F.col("r_name"), "mod_item", c(F.lit("/ws/"), F.col("r_name"), F.lit("/mod.rs")), F.col("r_regionkey") * 10, none, none, none),
        row(_people(spark, sf), path, "class_definition", file, F.col("n_nationkey") * 10, none, none, none),
        row(read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), c(path, F.lit("::"), F.col("c_name")), "function_definition", file, F.col("c_custkey") * 10 + 1000, c(F.lit("def "), F.col("c_name"), F.lit("()")), F.col("c_mktsegment"), F.col("n_name")),
        row(read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), c(path, F.lit("::"), F.col("s_name")), "function_item", file, F.col("s_suppkey") * 10 + 5_000_000_000, none, none, F.col("n_name")),
        row(read(spark, sf, "part"), c(F.col("p_brand"), F.lit("::"), F.col("p_name")), "declaration", c(F.lit("/ws/parts/"), F.col("p_brand"), F.lit(".cpp")), F.col("p_partkey") * 10, F.col("p_type"), F.col("p_size").cast("string"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumns({"scope_path": parent_path("semantic_path"), "base_name": base_name("semantic_path")})


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("semantic_path")
    n = F.row_number().over(w.orderBy("file_path", "start_byte", "end_byte"))
    ident = F.when(F.count(F.lit(1)).over(w) > 1, F.concat("semantic_path", F.lit("#definition["), n.cast("string"), F.lit("]"))).otherwise(F.col("semantic_path"))
    return raw_symbols(spark, sf).withColumn("symbol_id", ident)


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """With ids: a path that repeats gets ``#definition[n]`` by file and range.  Written once."""
    return _written(spark, sf, "symbols", _symbols)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Caller to callee: nation to region, customer to nation, customer to the parts and suppliers of its orders.  Written once."""
    return _written(spark, sf, "edges", _edges)


def _edges(spark: SparkSession, sf: str) -> list[DataFrame]:
    """In parts that are written one after the other.  Who bought what is paired by keys first and named last; no table of names is broadcast."""
    s = symbols(spark, sf).select("symbol_id", "node_kind", "start_byte")
    pick = lambda kind, shift, key: s.filter(F.col("node_kind") == kind).select(F.col("symbol_id").alias(f"{key}_id"), F.expr(f"(start_byte - {shift}) div 10").alias(key))
    cust, part, supp = pick("function_definition", 1000, "ck"), pick("declaration", 0, "pk"), pick("function_item", 5_000_000_000, "sk")
    people = _people(spark, sf)
    path = F.concat("r_name", F.lit("::"), "n_name")
    first = people.select(path.alias("src"), F.col("r_name").alias("dst"))
    second = read(spark, sf, "customer").join(F.broadcast(people), F.col("c_nationkey") == F.col("n_nationkey")).join(cust.hint("merge"), F.col("c_custkey") == F.col("ck")).select(F.col("ck_id").alias("src"), path.alias("dst"))
    bought = read(spark, sf, "lineitem").join(read(spark, sf, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = F.array(F.struct(F.lit("p").alias("kind"), F.col("l_partkey").alias("key")), F.struct(F.lit("s").alias("kind"), F.col("l_suppkey").alias("key")))
    pairs = materialize(bought.select(F.col("o_custkey").alias("ck"), F.explode(ends).alias("end")).select("ck", "end.kind", "end.key").distinct(), "bought")
    release(spark)
    named = lambda kind, to, key, piece: pairs.filter((F.col("kind") == kind) & (F.pmod("ck", F.lit(2)) == piece)).select("ck", F.col("key").alias(key)).join(to.hint("merge"), key).join(cust.hint("merge"), "ck").select(F.col("ck_id").alias("src"), F.col(f"{key}_id").alias("dst"))
    return [first.unionAll(second), *(named(*to, piece) for to in (("p", part, "pk"), ("s", supp, "sk")) for piece in (0, 1))]


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    path = F.concat(F.lit("/ws/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("file_path"), F.col("text").alias("source"), F.md5("text").alias("fingerprint"))


def file_state(spark: SparkSession, sf: str) -> DataFrame:
    """What an older index knows: most files, some with another fingerprint, and some that are gone."""
    f = files(spark, sf)
    known = f.filter("doc_id % 10 <> 0").select("file_path", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("source", F.lit("x")))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    ghost = f.filter("doc_id % 100 = 0").select(F.concat("file_path", F.lit(".gone")).alias("file_path"), "fingerprint")
    return known.unionAll(ghost)


def overlay(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).filter("doc_id % 50 = 0").select("file_path", F.concat(F.lit("overlay "), F.col("doc_id").cast("string")).alias("source"))


def file_deps(spark: SparkSession, sf: str) -> DataFrame:
    """importer, imported: a sparse file graph with chains and cycles over documents."""
    f = files(spark, sf).select("doc_id", "file_path")
    n = F.expr("CASE WHEN doc_id % 5 = 0 THEN doc_id + 5 WHEN doc_id % 5 = 1 THEN doc_id - 1 WHEN doc_id % 5 = 2 THEN doc_id - 2 ELSE NULL END")
    hop = f.withColumn("to", F.when(F.col("doc_id") % 50 == 45, F.col("doc_id") - 45).otherwise(n)).filter("to IS NOT NULL")
    return hop.join(f.select(F.col("doc_id").alias("to"), F.col("file_path").alias("imported")), "to").select(F.col("file_path").alias("importer"), "imported")


SQL = """
people AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
raw0 AS (
  SELECT r_name AS semantic_path, 'mod_item' AS node_kind, '/ws/' || r_name || '/mod.rs' AS file_path, (r_regionkey * 10)::BIGINT AS start_byte, NULL::VARCHAR AS signature, NULL::VARCHAR AS parameter, NULL::VARCHAR AS return_type FROM region
  UNION ALL SELECT r_name || '::' || n_name, 'class_definition', '/ws/' || r_name || '/' || n_name || '.py', (n_nationkey * 10)::BIGINT, NULL, NULL, NULL FROM people
  UNION ALL SELECT r_name || '::' || n_name || '::' || c_name, 'function_definition', '/ws/' || r_name || '/' || n_name || '.py', c_custkey * 10 + 1000, 'def ' || c_name || '()', c_mktsegment, n_name FROM customer JOIN people ON c_nationkey = n_nationkey
  UNION ALL SELECT r_name || '::' || n_name || '::' || s_name, 'function_item', '/ws/' || r_name || '/' || n_name || '.py', s_suppkey * 10 + 5000000000, NULL, NULL, n_name FROM supplier JOIN people ON s_nationkey = n_nationkey
  UNION ALL SELECT p_brand || '::' || p_name, 'declaration', '/ws/parts/' || p_brand || '.cpp', p_partkey * 10, p_type, p_size::VARCHAR, NULL FROM part),
raw AS (SELECT *, start_byte + 9 AS end_byte, CASE WHEN contains(semantic_path, '::') THEN regexp_extract(semantic_path, '^(.*)::', 1) END AS scope_path, regexp_extract(semantic_path, '([^:]*)$', 1) AS base_name FROM raw0),
symbols AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY semantic_path) > 1 THEN semantic_path || '#definition[' || row_number() OVER (PARTITION BY semantic_path ORDER BY file_path, start_byte, end_byte) || ']' ELSE semantic_path END AS symbol_id FROM raw),
bought AS (SELECT o_custkey AS ck, l_partkey AS pk, l_suppkey AS sk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cust AS (SELECT symbol_id AS id, (start_byte - 1000) // 10 AS k FROM symbols WHERE node_kind = 'function_definition'),
parts AS (SELECT symbol_id AS id, start_byte // 10 AS k FROM symbols WHERE node_kind = 'declaration'),
supp AS (SELECT symbol_id AS id, (start_byte - 5000000000) // 10 AS k FROM symbols WHERE node_kind = 'function_item'),
edges AS (
  SELECT r_name || '::' || n_name AS src, r_name AS dst FROM people
  UNION ALL SELECT c.id, r_name || '::' || n_name FROM cust c JOIN customer ON c.k = c_custkey JOIN people ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT c.id, p.id FROM bought JOIN cust c ON c.k = ck JOIN parts p ON p.k = pk
  UNION ALL SELECT DISTINCT c.id, s.id FROM bought JOIN cust c ON c.k = ck JOIN supp s ON s.k = sk),
files AS (SELECT doc_id, '/ws/' || source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text AS source, md5(text) AS fingerprint FROM documents),
file_state AS (
  SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN md5(source || 'x') ELSE fingerprint END AS fingerprint FROM files WHERE doc_id % 10 <> 0
  UNION ALL SELECT file_path || '.gone', fingerprint FROM files WHERE doc_id % 100 = 0),
overlay AS (SELECT file_path, 'overlay ' || doc_id AS source FROM files WHERE doc_id % 50 = 0),
file_deps AS (SELECT a.file_path AS importer, b.file_path AS imported FROM files a JOIN files b ON b.doc_id =
  CASE WHEN a.doc_id % 50 = 45 THEN a.doc_id - 45 WHEN a.doc_id % 5 = 0 THEN a.doc_id + 5 WHEN a.doc_id % 5 = 1 THEN a.doc_id - 1 WHEN a.doc_id % 5 = 2 THEN a.doc_id - 2 END)
"""


def sql(body: str) -> str:
    return f"WITH RECURSIVE {SQL.strip()}{',' if not body.lstrip().upper().startswith('SELECT ') else ''}\n{body}"
