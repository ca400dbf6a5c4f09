"""Edits and their validation: splices, diffs, binding decisions, gate, evidence replay and commit decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions import expr as E


def spliced(source: Column, start: Column, end: Column, text: Column) -> Column:
    """Bytes before start, the text, bytes from end."""
    raw = F.encode(source, "UTF-8")
    head, tail = F.substring(raw, F.lit(1), start.cast("int")), F.substring(raw, (end + 1).cast("int"), F.octet_length(source))
    return F.decode(F.concat(head, F.encode(text, "UTF-8"), tail), "UTF-8")


def position_edits(source: Column, edits: Column) -> Column:
    """edits: array of (start_row, start_col, end_row, end_col, new_text), each applied to the result of the one before;
    null as soon as one is out of bounds, so a batch holds as a whole or not at all."""

    def apply(text: Column, e: Column) -> Column:
        return spliced(text, E.point_offset(text, e["start_row"], e["start_col"]), E.point_offset(text, e["end_row"], e["end_col"]), e["new_text"])

    return F.aggregate(edits, source, apply)


def decisions(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """references: (patch_id, name); candidates: (patch_id, name, candidate, rank, suppressing).  Candidates at the best
    rank decide; a suppressing binding of a higher rank empties the result."""
    w = Window.partitionBy("patch_id", "name")
    shade = F.max(F.when(F.col("suppressing"), F.col("rank"))).over(w)
    open_ = candidates.withColumn("_shade", shade).filter(~F.col("suppressing") & (F.col("_shade").isNull() | (F.col("rank") >= F.col("_shade"))))
    best = open_.withColumn("_top", F.max("rank").over(w)).filter("rank = _top")
    n = best.groupBy("patch_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("candidate"))
    out = references.join(n, ["patch_id", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return out.select("patch_id", "name", F.col("n").alias("candidates"), status.alias("status"), F.when(F.col("n") == 1, F.col("candidate")).alias("selected"))


def invariants(decided: DataFrame) -> DataFrame:
    """resolved with one candidate and a key: passed; ambiguous or unresolved: blocked; anything else: failed."""
    passed = (F.col("status") == "resolved") & (F.col("candidates") == 1) & F.col("selected").isNotNull()
    return decided.withColumn("invariant", F.when(passed, "passed").when(F.col("status").isin("ambiguous", "unresolved"), "blocked").otherwise("failed"))


def gates(patches: DataFrame, decided: DataFrame) -> DataFrame:
    """patches: (patch_id, syntax_errors, bypass).  gate and the first reason: syntax, ambiguous, unresolved, invariant.  A bypass
    opens the gate whatever the reason, syntax errors included."""
    c = invariants(decided).groupBy("patch_id").agg(*[F.count_if(cond).alias(k) for k, cond in {
        "ambiguous": F.col("status") == "ambiguous", "unresolved": F.col("status") == "unresolved", "failed": F.col("invariant") == "failed",
    }.items()])
    m = patches.join(c, "patch_id", "left").fillna(0, ["ambiguous", "unresolved", "failed"])
    reason = F.when(F.col("syntax_errors") > 0, "syntax").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("unresolved") > 0, "unresolved").when(F.col("failed") > 0, "invariant")
    gate = F.when(reason.isNull(), "allowed").when(F.col("bypass"), "allowed_with_bypass").otherwise("rejected")
    return m.select("patch_id", "bypass", gate.alias("gate"), reason.alias("reason"))


# Where evidence is looked for, in this order, by the role that it has in a trace.
SCOPES = {"callee": "callees", "caller": "callers", "trace_root": "symbol"}


def replay(evidence: DataFrame, trace: DataFrame) -> DataFrame:
    """evidence: (patch_id, name, evidence_key, invariant), a null key where nothing was selected; trace: (patch_id, role,
    evidence_key).  Adds scope and status.  A key is looked for as it is among callees, callers and the symbol itself, then
    there without its origin, then in the patch's own scopes; else the scope is none.  Passed evidence is matched or missing;
    blocked evidence stays blocked, and all other fails."""
    order = F.when(F.col("role") == "callee", 0).when(F.col("role") == "caller", 1).otherwise(2)
    exact = trace.groupBy("patch_id", "evidence_key").agg(F.min_by("role", order).alias("exact"))
    bare = trace.withColumn("bare", E.key_without_origin("evidence_key")).filter("bare IS NOT NULL")
    loose = bare.groupBy("patch_id", "bare").agg(F.min_by("role", order).alias("loose"))
    out = evidence.withColumn("bare", E.key_without_origin("evidence_key")).join(exact, ["patch_id", "evidence_key"], "left").join(loose, ["patch_id", "bare"], "left")
    scope = F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])[F.coalesce("exact", "loose")]
    out = out.withColumn("scope", F.coalesce(scope, F.when(E.patch_scope("evidence_key"), "patch_scope"), F.lit("none")))
    status = F.when(F.col("invariant") == "passed", F.when(F.col("scope") != "none", "matched").otherwise("missing")).when(F.col("invariant") == "blocked", "blocked").otherwise("failed")
    return out.select("patch_id", "name", "evidence_key", "scope", status.alias("status"))


# How bad a replay status is.
SEVERITY = {"matched": 0, "blocked": 1, "missing": 2, "failed": 3}


def replay_status(rows: DataFrame) -> DataFrame:
    """rows: (patch_id, status).  The worst status, and counts."""
    code = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("status")]
    word = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])
    out = rows.groupBy("patch_id").agg(F.max(code).alias("c"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.min(F.col("status").isin("matched", "blocked")).alias("consistent"))
    return out.select("patch_id", word[F.col("c")].alias("status"), "matched", "blocked", "consistent")


def commit_decision(gated: DataFrame, replayed: DataFrame) -> DataFrame:
    """What gate and replay allow: blocked evidence needs a gate that a bypass has opened, and such a gate marks the result."""
    m = gated.join(replayed.select("patch_id", "status"), "patch_id", "left")
    lost = F.col("status").isin("missing", "failed") | ((F.col("status") == "blocked") & (F.col("gate") != "allowed_with_bypass"))
    decision = F.when(F.col("gate") == "rejected", "rejected_by_patch_gate").when(lost, "rejected_by_trace_replay").otherwise(F.col("gate"))
    return m.select("patch_id", decision.alias("decision"))


def lines_of(text: Column) -> Column:
    """Lines without their ends, carriage returns included; a last line feed begins no further line."""
    ended = text.endswith("\n")
    parts = F.split(text, "\n")
    last = F.when(ended | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    bare = lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    # a carriage return counts as an end of line only before a line feed
    return E.let(F.struct(last.alias("l"), ended.alias("e")), lambda v: F.transform(v["l"], lambda x, i: F.when(v["e"] | (i < F.size(v["l"]) - 1), bare(x)).otherwise(x)))


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their start."""
    n = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(n).cast("int")


def unified_diff(path: Column, before: Column, after: Column) -> Column:
    """One hunk without context for what is between the common first and last lines, with the two file lines before it;
    empty for equal texts."""
    name = F.regexp_replace(path, "^/+", "")

    def hunk(v: Column) -> Column:
        cut = lambda side: F.slice(v[side], v["head"] + 1, F.size(v[side]) - v["head"] - v["tail"])
        size = lambda side: (F.size(v[side]) - v["head"] - v["tail"]).cast("string")
        at = (v["head"] + 1).cast("string")
        top = F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), F.concat(F.lit("@@ -"), at, F.lit(","), size("a"), F.lit(" +"), at, F.lit(","), size("b"), F.lit(" @@")))
        lines = F.concat(top, F.transform(cut("a"), lambda x: F.concat(F.lit("-"), x)), F.transform(cut("b"), lambda x: F.concat(F.lit("+"), x)))
        return F.concat(F.array_join(lines, "\n"), F.lit("\n"))

    both = F.struct(lines_of(before).alias("a"), lines_of(after).alias("b"))
    headed = lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), _common(v["a"], v["b"]).alias("head"), F.least(F.size(v["a"]), F.size(v["b"])).alias("n"))
    tailed = lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), v["head"].alias("head"), F.least(_common(F.reverse(v["a"]), F.reverse(v["b"])), v["n"] - v["head"]).alias("tail"))
    return F.when(before == after, "").otherwise(E.let(E.let(E.let(both, headed), tailed), hunk))


def indentation_issues(lines: DataFrame) -> DataFrame:
    """lines: (file_path, row, line).  Code lines that should be deeper than the block header before them and aren't: a header
    waits until a deeper line or another header comes, so each line that fails to is an issue; blank lines and comments
    don't count.  The lines of a file, which the limits of a scan bound, are folded in their order."""
    text = F.regexp_replace("line", "[\r\n]+$", "")
    code = lines.withColumn("line", text).filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#") & ~F.col("line").rlike(r"^\s*(#|$)"))
    indent = F.length(F.regexp_extract("line", "^[ \t]*", 0))
    rows = code.select("file_path", F.struct("row", indent.alias("indent"), F.col("line").rlike(r":\s*$").alias("opens")).alias("r"))
    folded = rows.groupBy("file_path").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("waits"), F.array().cast("array<struct<row:bigint,indent:int,header:int>>").alias("issues"))

    def step(a: Column, r: Column) -> Column:
        bad = a["waits"].isNotNull() & (r["indent"] <= a["waits"])
        issue = F.struct(r["row"].cast("long").alias("row"), r["indent"].alias("indent"), a["waits"].alias("header"))
        waits = F.when(r["opens"], r["indent"]).when(bad, a["waits"])
        return F.struct(waits.alias("waits"), F.when(bad, F.array_append(a["issues"], issue)).otherwise(a["issues"]).alias("issues"))

    found = folded.select("file_path", F.explode(F.aggregate("rows", start, step, lambda a: a["issues"])).alias("i"))
    return found.select("file_path", "i.row", "i.indent", "i.header")


# Rules of a report by the word that their name ends with, with what they are called.
SARIF_RULES = {
    "syntax": ("syntax-error", "A syntax error."),
    "binding": ("binding-validation", "A reference of a patch that can't be bound safely."),
    "patch-gate": ("patch-commit-gate", "The decision of the patch gate."),
}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif(patches: DataFrame, issues: DataFrame) -> DataFrame:
    """patch_id and its report as JSON text.  issues: (patch_id, ordinal, rule, level, message, file_path, start_row, start_column,
    end_row, end_column); rows and columns, from 0, are null for issues without a place.  Rules are listed once each, in
    order; results by ordinal."""
    place = F.struct(F.struct(
        F.struct(E.path_uri("file_path").alias("uri")).alias("artifactLocation"),
        F.struct((F.col("start_row") + 1).alias("startLine"), (F.col("start_column") + 1).alias("startColumn"), (F.col("end_row") + 1).alias("endLine"), (F.col("end_column") + 1).alias("endColumn")).alias("region"),
    ).alias("physicalLocation"))
    result = F.struct("ordinal", F.struct(F.concat(F.lit("symloom."), "rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("start_row").isNotNull(), F.array(place)).alias("locations")).alias("r"))
    family = F.regexp_extract("rule", r"^([^.]*)", 1)
    told = F.create_map(*[F.lit(x) for k, v in SARIF_RULES.items() for x in (k, v[0])])
    short = F.create_map(*[F.lit(x) for k, v in SARIF_RULES.items() for x in (k, v[1])])
    rule = F.struct(F.concat(F.lit("symloom."), "rule").alias("id"), F.try_element_at(told, family).alias("name"), F.struct(F.try_element_at(short, family).alias("text")).alias("shortDescription"))
    runs = issues.groupBy("patch_id").agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    met = patches.select("patch_id").join(runs, "patch_id", "left").withColumns({"rules": F.coalesce("rules", F.array().cast(runs.schema["rules"].dataType)), "results": F.coalesce("results", F.array().cast(runs.schema["results"].dataType))})
    driver = F.struct(F.struct(F.lit("symloom").alias("name"), "rules").alias("driver"))
    run = F.struct(driver.alias("tool"), F.lit("utf8CodeUnits").alias("columnKind"), "results")
    return met.select("patch_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))).alias("sarif"))
