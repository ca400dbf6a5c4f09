"""The lasting index: versioned Parquet tables with a manifest, freshness, refresh and health."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import expr as E
from symloom.functions.expr import LANGUAGES
from symloom.schema import RAW_SYMBOLS

#: Revisions of the extractors; an index of other ones, of other extensions or other facts is made anew.
REVISIONS = {lang: 3 for lang in LANGUAGES}
SCHEMA_VERSION = 6
PROVENANCE = {"revisions": REVISIONS, "extensions": hashlib.md5(json.dumps(LANGUAGES).encode()).hexdigest(), "facts": hashlib.md5(RAW_SYMBOLS.json().encode()).hexdigest()}


class IndexError_(RuntimeError):
    """An index that can't be used as it is."""


def freshness(files: DataFrame, state: DataFrame) -> DataFrame:
    """file_path, status: fresh, stale, missing (known, but gone), unreadable (there, without a fingerprint) or unindexed."""
    now = files.select("file_path", F.col("fingerprint").alias("now"), F.lit(True).alias("here"))
    met = now.join(state.select("file_path", F.col("fingerprint").alias("was"), F.lit(True).alias("known")), "file_path", "full")
    status = F.when(F.col("here").isNull(), "missing").when(F.col("now").isNull(), "unreadable").when(F.col("known").isNull(), "unindexed")
    return met.select("file_path", status.when(F.col("now") == F.col("was"), "fresh").otherwise("stale").alias("status"))


def unindexed(files: DataFrame, state: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    left = files.select("file_path").join(state.select("file_path"), "file_path", "left_anti")
    return left if overlay is None else left.join(overlay.select("file_path"), "file_path", "left_anti")


def reuse(files: DataFrame, state: DataFrame) -> DataFrame:
    """Every file with whether its stored rows can be used again: the same fingerprint."""
    met = files.select("file_path", "fingerprint").join(state.select("file_path", F.col("fingerprint").alias("was")), "file_path", "left")
    return met.select("file_path", F.coalesce(F.col("fingerprint") == F.col("was"), F.lit(False)).alias("reused"))


def refresh_stats(files: DataFrame, state: DataFrame) -> DataFrame:
    r = reuse(files, state)
    return r.agg(F.count(F.lit(1)).alias("indexed"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("rebuilt"))


def overlaid(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows replace file rows, and add to them."""
    kept = files.select("file_path", "source").join(overlay.select("file_path"), "file_path", "left_anti")
    return kept.unionByName(overlay.select("file_path", "source"))


def impacted(changed: DataFrame, references: DataFrame, symbols: DataFrame, edges: DataFrame, edges_before: DataFrame | None = None) -> DataFrame:
    """changed: (symbol_id).  With them, who refers to a changed base name, and all direct neighbours, in the new graph and, if
    given, in the one before."""
    edges = edges if edges_before is None else edges.select("src", "dst").unionByName(edges_before.select("src", "dst")).distinct()
    names = changed.join(symbols.select("symbol_id", "base_name"), "symbol_id").select(F.col("base_name").alias("name")).distinct()
    coupled = references.join(names, "name", "left_semi").select(F.col("src").alias("symbol_id"))
    c = changed.select(F.col("symbol_id").alias("c"))
    up = edges.join(c, F.col("dst") == F.col("c"), "left_semi").select(F.col("src").alias("symbol_id"))
    down = edges.join(c, F.col("src") == F.col("c"), "left_semi").select(F.col("dst").alias("symbol_id"))
    return changed.select("symbol_id").union(coupled).union(up).union(down).distinct()


def replaced(table: DataFrame, changed_files: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of unchanged files, and the new rows of changed ones."""
    return table.join(changed_files.select("file_path").distinct(), "file_path", "left_anti").unionByName(rows)


def upserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """key, value: a new value replaces the old one."""
    return table.join(rows.select("key"), "key", "left_anti").unionByName(rows)


def violations(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """rule, n for every broken rule of symbol records."""
    rules = {
        "blank_id": F.trim("symbol_id") == "", "blank_path": F.trim("semantic_path") == "", "blank_kind": F.trim("node_kind") == "",
        "range": F.col("start_byte") > F.col("end_byte"), "blank_signature": F.trim("signature") == "",
    }
    counted = symbols.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    out = counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("v")).select("v.rule", "v.n")
    if files is not None:
        placed = symbols.select("file_path", "start_byte", "end_byte").join(files.select("file_path", "source"), "file_path")
        beyond = F.col("end_byte") > F.octet_length("source")
        off = ~beyond & ~(E.on_boundary(F.col("source"), F.col("start_byte")) & E.on_boundary(F.col("source"), F.col("end_byte")))
        found = placed.agg(F.count_if(beyond).alias("beyond_file"), F.count_if(off).alias("off_boundary"))
        out = out.unionByName(found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in ("beyond_file", "off_boundary")])).alias("v")).select("v.rule", "v.n"))
    return out


def migrated(symbols: DataFrame) -> DataFrame:
    """Symbol rows of schema 1 to 5 as rows of the current one: a blank id is the path, lists and maps that older schemas don't
    have are empty, and facts are made from names and arities."""
    kinds = {f.name: f.dataType for f in RAW_SYMBOLS.fields}
    for name, kind in kinds.items():
        if name not in symbols.columns:
            symbols = symbols.withColumn(name, F.lit(None).cast(kind))
    empty = lambda c, text: F.coalesce(c, F.from_json(F.lit(text), kinds[c].simpleString()))
    out = symbols.withColumns({
        "symbol_id": F.coalesce(F.when(F.col("symbol_id") != "", F.col("symbol_id")), F.col("semantic_path")),
        **{c: empty(c, "[]") for c in ("parameters", "reference_names", "calls", "bases", "interfaces")}, "reference_call_arities": empty("reference_call_arities", "{}"), "is_overload": F.coalesce("is_overload", F.lit(False)),
    })
    made = F.transform("reference_names", lambda x: F.struct(x.alias("spelling"), F.coalesce(F.try_element_at(F.col("reference_call_arities"), x), F.array().cast("array<int>")).alias("call_arities"), F.create_map().cast("map<string,string>").alias("details")))
    return out.withColumn("reference_facts", F.coalesce("reference_facts", made))


def health(files: DataFrame, state: DataFrame) -> DataFrame:
    """One row: counts of each class, whether all is well and what to do."""
    f = freshness(files, state).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "stale", "missing", "unreadable", "unindexed")])
    ok = (F.col("stale") == 0) & (F.col("missing") == 0) & (F.col("unreadable") == 0) & (F.col("unindexed") == 0)
    return f.withColumns({"ok": ok, "action": F.when(ok, "none").otherwise("refresh")})


class Store:
    """Versions of the index tables below one folder.  A version is written whole and then named by a manifest of its own, with
    the next number; readers take the manifest with the highest number.  Nothing that counts is deleted or replaced, so a
    reader sees the old version or the new one, and a job that dies leaves the old one standing.  All but the newest
    ``keep`` versions go once a new one counts."""

    TABLES, MORE = ("symbols", "edges", "file_state"), ("facts",)

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[tuple[int, str]]:
        fs, p = self._fs(f"{self.root}/MANIFEST.*.json")
        return sorted((int(str(s.getPath()).rsplit(".", 2)[1]), str(s.getPath())) for s in fs.globStatus(p) or [])

    def _json(self, path: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(path).collect()))

    def manifest(self) -> dict | None:
        found = self._manifests()
        return self._json(found[-1][1]) if found else None

    def write(self, **tables: DataFrame) -> dict:
        before = self._manifests()
        if before and self._json(before[-1][1]).get("format") != "symloom":
            raise IndexError_(f"{self.root} holds something else")
        version = uuid.uuid4().hex
        names = [*self.TABLES, *(n for n in self.MORE if n in tables)]
        for name in names:
            tables[name].write.parquet(f"{self.root}/{version}/{name}")
        made = {"format": "symloom", "schema_version": SCHEMA_VERSION, "provenance": PROVENANCE, "version": version, "tables": names}
        number = before[-1][0] + 1 if before else 1
        fs, p = self._fs(f"{self.root}/MANIFEST.{number:08d}.json")
        _, fresh = self._fs(f"{self.root}/_MANIFEST.{version}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if not fs.rename(fresh, p):
            raise IndexError_(f"{p} is there already: another writer was faster")
        for _, path in before[: max(0, len(before) + 1 - self.keep)]:
            old = self._json(path)
            fs.delete(self._fs(path)[1], False)
            if old.get("version"):
                fs.delete(self._fs(f"{self.root}/{old['version']}")[1], True)
        return made

    def read(self, strict: bool = True) -> dict[str, DataFrame]:
        m = self.manifest()
        if m is None:
            raise IndexError_(f"no index at {self.root}")
        if strict and (m["schema_version"], m["provenance"]) != (SCHEMA_VERSION, PROVENANCE):
            raise IndexError_(f"index of schema {m['schema_version']}, {m['provenance']}")
        return {n: self.spark.read.parquet(f"{self.root}/{m['version']}/{n}") for n in m.get("tables", self.TABLES)}

    def migrate(self) -> dict:
        """An index of an older schema becomes one of the current schema; its files count as not indexed until they are read."""
        if self.plan() != "migrate":
            raise IndexError_(f"nothing to migrate: {self.plan()}")
        old = self.read(strict=False)
        return self.write(symbols=migrated(old["symbols"]), edges=old["edges"], file_state=old["file_state"].limit(0))

    def plan(self) -> str:
        """none, migrate (an older schema), rebuild (none there or other provenance) or manual (a newer or foreign one)."""
        m = self.manifest()
        if m is None:
            return "rebuild"
        if m.get("format") != "symloom" or m["schema_version"] > SCHEMA_VERSION:
            return "manual"
        if m["schema_version"] < SCHEMA_VERSION:
            return "migrate"
        return "none" if m["provenance"] == PROVENANCE else "rebuild"
