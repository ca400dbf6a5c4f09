"""Scalar rules as column expressions; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much a declaration kind counts when candidates compete.  Other kinds count 0.
KIND_RANK = {
    3: ("function_definition", "function_item", "function_signature_item", "class_definition"),
    2: (
        "alias_declaration", "class_specifier", "concept_definition", "enum_specifier", "enumerator", "namespace_alias_definition", "struct_specifier", "template_instantiation", "type_definition",
        "union_specifier", "using_declaration", "const_item", "enum_item", "mod_item", "static_item", "struct_item", "trait_item", "type_item",
    ),
    1: ("declaration", "field_declaration"),
}

# Language to extensions, directories that scans skip, header extensions.
LANGUAGES = {
    "python": ("py", "pyi"),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "cxx", "c++", "tpp", "tcc", "ipp", "inl", "hpp", "hh", "hxx", "h++"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "rust": ("rs",),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "csharp": ("cs",),
}
EXTENSION_LANGUAGE = {e: lang for lang, all_ in LANGUAGES.items() for e in all_}
SKIP_DIRECTORIES = (".git", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "venv")
HEADER_EXTENSIONS = ("h", "hpp", "hh", "hxx", "h++")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(v) with value worked out once: a lambda's body would work a column out again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_rank(kind: Column | str) -> Column:
    k = col(kind)
    return F.when(k.isin(*KIND_RANK[3]), 3).when(k.isin(*KIND_RANK[2]), 2).when(k.isin(*KIND_RANK[1]), 1).otherwise(0)


def base_name(path: Column | str) -> Column:
    """After the last ``::``, then after the last dot."""
    return F.element_at(F.split(F.element_at(F.split(col(path), "::"), -1), r"\."), -1)


def parent_path(path: Column | str) -> Column:
    """Up to the last ``::``, or else the last dot; null for a bare name."""
    p = col(path)
    cut = F.when(p.contains("::"), F.regexp_extract(p, r"^(.*)::", 1)).otherwise(F.regexp_extract(p, r"^(.*)\.", 1))
    return F.when(cut != "", cut)


def evidence_key(symbol_id, file_path, node_kind, origin, start, end, signature) -> Column:
    span = F.concat(col(start).cast("string"), F.lit(".."), col(end).cast("string"))
    return F.concat_ws("|", col(symbol_id), col(file_path), col(node_kind), col(origin), span, F.coalesce(col(signature), F.lit("")))


def key_without_origin(key: Column | str) -> Column:
    """Drops the fourth of the six parts; null for a key with fewer."""
    parts = F.split(col(key), r"\|", 6)
    return F.when(F.size(parts) == 6, F.array_join(F.filter(parts, lambda _, i: i != 3), "|"))


def patch_scope(key: Column | str) -> Column:
    """Whether a key stands for something declared in the patch itself: its origin is a local or module scope."""
    return F.coalesce(F.get(F.split(col(key), r"\|"), F.lit(3)).isin("local_scope", "module_scope"), F.lit(False))


def template_base(path: Column | str) -> Column:
    """Without balanced <...> groups and without round, square and curly brackets; null if that changes nothing or anything
    stays open.  Angle brackets inside other brackets are text, and a > closes a group only at the end or before one of
    ``> , ) ] } : .``, spaces aside."""
    p = col(path)
    start = F.struct(*[F.lit(v).alias(k) for k, v in (("out", ""), ("angle", 0), ("round", 0), ("square", 0), ("curly", 0))])
    # each letter with the first one after it that isn't a space
    following = lambda all_, i: F.coalesce(F.get(F.filter(F.slice(all_, i + 2, F.size(all_)), lambda x: F.trim(x) != ""), F.lit(0)), F.lit(">"))
    letters = F.filter(F.split(p, ""), lambda c: c != "")
    after = let(letters, lambda all_: F.transform(all_, lambda c, i: F.struct(c.alias("c"), F.when(c == ">", following(all_, i)).alias("next"))))

    def step(a: Column, e: Column) -> Column:
        c = e["c"]
        plain = (a["round"] == 0) & (a["square"] == 0) & (a["curly"] == 0)
        opens = (c == "<") & plain
        shuts = (c == ">") & plain & (a["angle"] > 0) & e["next"].isin(">", ",", ")", "]", "}", ":", ".")
        bracket = c.isin("(", ")", "[", "]", "{", "}")
        count = lambda name, o, s: F.when(c == o, a[name] + 1).when(c == s, F.greatest(a[name] - 1, F.lit(0))).otherwise(a[name]).alias(name)
        return F.struct(
            F.when((a["angle"] == 0) & ~opens & ~shuts & ~bracket, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"),
            (a["angle"] + F.when(opens, 1).when(shuts, -1).otherwise(0)).alias("angle"),
            count("round", "(", ")"), count("square", "[", "]"), count("curly", "{", "}"),
        )

    closed = lambda a: (a["angle"] == 0) & (a["round"] == 0) & (a["square"] == 0) & (a["curly"] == 0)
    end = F.aggregate(after, start, step, lambda a: F.when(closed(a), a["out"]))
    return F.when(end != p, end)


def strip_generics(path: Column | str) -> Column:
    """A type path without its balanced <...> groups; null where they don't balance, are empty, or text follows one at once."""
    p = col(path)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("shut"), F.lit(False).alias("full"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        opens, shuts = c == "<", c == ">"
        outside = ~opens & ~shuts & (a["depth"] == 0)
        wrong = (opens & a["shut"]) | (shuts & ((a["depth"] == 0) | ~a["full"])) | (outside & a["shut"] & c.rlike("[A-Za-z0-9_]"))
        return F.struct(
            F.when(outside, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"), (a["depth"] + F.when(opens, 1).when(shuts & (a["depth"] > 0), -1).otherwise(0)).alias("depth"),
            F.when(shuts & (a["depth"] == 1), True).when(outside & (c == "."), False).otherwise(a["shut"]).alias("shut"), F.when(opens, False).when(shuts, True).when(~outside & (F.trim(c) != ""), True).otherwise(a["full"]).alias("full"), (a["ok"] & ~wrong).alias("ok"),
        )

    letters = F.filter(F.split(p, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda a: F.when(a["ok"] & (a["depth"] == 0), a["out"]))


def reference_base(name: Column | str) -> Column:
    n = col(name)
    return base_name(F.coalesce(template_base(n), n))


def _without_brackets(text: Column) -> Column:
    """What stands outside all round, square and curly brackets."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("round"), F.lit(0).alias("square"), F.lit(0).alias("curly"))

    def step(a: Column, c: Column) -> Column:
        count = lambda name, o, s: F.when(c == o, a[name] + 1).when(c == s, F.greatest(a[name] - 1, F.lit(0))).otherwise(a[name]).alias(name)
        outside = (a["round"] == 0) & (a["square"] == 0) & (a["curly"] == 0)
        return F.struct(F.when(outside, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"), count("round", "(", ")"), count("square", "[", "]"), count("curly", "{", "}"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda a: a["out"])


def arity_range(parameters: Column | str) -> Column:
    """(least, most) arguments that a callable with these parameter texts takes: void is none, a last parameter ``...`` takes any
    more (most is null; a parameter pack is an ordinary parameter), and a ``=`` outside brackets makes its parameter optional."""
    p = F.transform(col(parameters), lambda x: F.trim(x))
    p = F.when((F.size(p) == 1) & (F.element_at(p, 1) == "void"), F.array().cast("array<string>")).otherwise(p)
    variadic = (F.size(p) > 0) & (F.try_element_at(p, F.lit(-1)) == "...")
    fixed = F.when(variadic, F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    least = F.size(F.filter(fixed, lambda x: ~_without_brackets(x).contains("=")))
    return F.struct(least.alias("least"), F.when(~variadic, F.size(fixed)).alias("most"))


def accepts_arity(parameters: Column | str, n: Column) -> Column:
    """Whether a callable with these parameter texts takes n arguments."""
    r = arity_range(parameters)
    return (n >= r["least"]) & (r["most"].isNull() | (n <= r["most"]))


def qualifiers(signature: Column | str) -> Column:
    """const and reference qualifiers: what follows the last closing parenthesis."""
    return F.trim(F.regexp_extract(col(signature), r"\)([^)]*)$", 1))


def offset_row(source: Column, offset: Column) -> Column:
    """Row of a byte offset: line feeds before it."""
    before = F.substring(F.encode(source, "UTF-8"), F.lit(1), offset.cast("int"))
    text = F.decode(before, "UTF-8")
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def offset_column(source: Column, offset: Column) -> Column:
    """Bytes since the last line feed before the offset."""
    before = F.decode(F.substring(F.encode(source, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")
    return F.octet_length(F.element_at(F.split(before, "\n"), -1))


def point_offset(source: Column, row: Column, column: Column) -> Column:
    """Byte offset of (row, byte column); null out of bounds.  The end of the file is allowed."""
    lines = F.split(source, "\n")
    size = F.aggregate(F.slice(lines, F.lit(1), row.cast("int")), F.lit(0), lambda t, x: t + F.octet_length(x) + 1)
    return F.when((row < F.size(lines)) & (column <= F.octet_length(F.get(lines, row.cast("int")))), size + column)


def byte_slice(source: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(source, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def json_list(text: Column | str) -> Column:
    """A JSON text as a list of strings; anything else, and a blank item, is an error."""
    t = col(text)
    items = F.from_json(t, "array<string>", {"mode": "FAILFAST"})
    bad = items.isNull() | F.exists(items, lambda x: x.isNull() | (F.trim(x) == ""))
    return F.when(t.isNotNull() & bad, F.raise_error(F.concat(F.lit("no list of names: "), t))).otherwise(items)


def json_map(text: Column | str, values: str = "array<int>") -> Column:
    """A JSON text as a map; anything else, and a key given twice, is an error."""
    t = col(text)
    keys = F.json_object_keys(t)
    bad = keys.isNull() | (F.size(keys) > F.size(F.array_distinct(keys)))
    return F.when(t.isNotNull() & bad, F.raise_error(F.concat(F.lit("no map: "), t))).otherwise(F.from_json(t, f"map<string,{values}>", {"mode": "FAILFAST"}))


def on_boundary(source: Column, offset: Column) -> Column:
    """Whether a byte offset begins a character or ends the text."""
    byte = F.substring(F.encode(source, "UTF-8"), (offset + 1).cast("int"), F.lit(1))
    return (F.hex(byte) < "80") | (F.hex(byte) > "BF") | (offset == F.octet_length(source))


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return F.try_element_at(known, extension(path))


def in_skipped_directory(relative: Column | str) -> Column:
    parts = F.split(col(relative), "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x).isin(*SKIP_DIRECTORIES))


def inside(path: Column | str, root: str) -> Column:
    """Whether a path lies below root once its ``.`` and ``..`` parts are worked out."""
    return normalized_path(path).startswith(root.rstrip("/") + "/")


def stem(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*?)(\.[^./]*)?$", 1)


def normalized_path(path: Column | str) -> Column:
    """Without ``.`` and ``..`` parts; backslashes become slashes."""
    parts = F.filter(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def path_uri(path: Column | str) -> Column:
    """A file URI: backslashes become slashes, a missing first slash is added, every byte that is neither unreserved nor a
    slash or colon is percent-encoded, and a path that begins with two slashes names its host."""
    plain_bytes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~/:"
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    h = F.hex(F.encode(p, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.substr(h, i, F.lit(2)))
    plain = F.create_map(*[F.lit(x) for c in plain_bytes for x in (f"{ord(c):02X}", c)])
    encoded = F.array_join(F.transform(codes, lambda x: F.coalesce(F.try_element_at(plain, x), F.concat(F.lit("%"), x))), "")
    return F.concat(F.when(encoded.startswith("//"), "file:").otherwise("file://"), encoded)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
