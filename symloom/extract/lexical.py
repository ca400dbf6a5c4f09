"""Declarations of brace languages without a parser: comments and strings are blanked, braces are matched, and a
declaration is a header pattern with the block or expression that follows.  What this can't tell apart it leaves out.

Each call comes with the paths that it may mean, the nearest scope first (``calls``); which of them exist is a join.  Paths that
need other files begin with a mark: ``@dir`` the caller's package folder, ``@go:path`` an imported package, ``@crate``, ``@self``
and ``@super`` modules, ``@js:module`` what a script module exports, ``@file`` the caller's file."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_GENERIC = r"(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>)?"
_CALL = re.compile(rf"(?<![\w.:>])((?:new\s+)?[A-Za-z_]\w*{_GENERIC}(?:(?:::|\.|->)~?[A-Za-z_]\w*{_GENERIC})*)\s*(?=\()")
_MADE = re.compile(r"(?:new\s+|&)?([A-Za-z_][\w.]*)(?:<[^<>(){}]*>)?\s*(?:\([^()]*\)|\{[^{}]*\})\s*\)?\s*\.\s*([A-Za-z_]\w*)\s*(?=\()")
_NOT_CALLS = frozenset("if for while switch catch return sizeof function match when throw typeof await fn func fun def class else do try using lock foreach in is as new delete and or not".split())
_N = r"(?P<name>[A-Za-z_~]\w*)"
_A = r"\((?P<args>[^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*)\)"

#: language -> (node kind, header pattern); a header ends before its block, or with the sign before an expression.
HEADERS: dict[str, list[tuple[str, str]]] = {
    "c": [("struct_specifier", rf"\bstruct\s+{_N}\s*(?=\{{)"), ("union_specifier", rf"\bunion\s+{_N}\s*(?=\{{)"), ("enum_specifier", rf"\benum\s+{_N}\s*(?=\{{)"), ("function_definition", rf"(?:^|(?<=[;{{}}]))[ \t]*(?:[\w*&]+[ \t*&]+)+{_N}\s*{_A}\s*(?=\{{)")],
    "cpp": [
        ("class_specifier", rf"\bclass\s+{_N}[^;{{}}()]*(?=\{{)"), ("struct_specifier", rf"\bstruct\s+{_N}[^;{{}}()]*(?=\{{)"), ("namespace_definition", r"\bnamespace\s+(?P<name>[A-Za-z_][\w:]*)\s*(?=\{)"), ("enum_specifier", rf"\benum\s+(?:class\s+)?{_N}[^;{{}}()]*(?=\{{)"),
        ("function_definition", rf"(?:^|(?<=[;{{}}]))[ \t]*(?:(?:public|private|protected)[ \t]*:\s*)?(?P<from>)(?:[\w:<>,*&]+[ \t*&]+)*(?P<owner>(?:[A-Za-z_]\w*::)*){_N}\s*{_A}\s*(?P<tail>(?:const|noexcept|override|final|volatile|&&?|\s)*)(?::(?!:)[^;{{}}]*)?(?=\{{)"),
    ],
    "javascript": [
        ("class_declaration", rf"\bclass\s+{_N}[^;{{}}]*(?=\{{)"), ("function_declaration", rf"\bfunction\s*\*?\s*{_N}\s*\((?P<args>[^{{}}]*?)\)[^;{{}}]*(?=\{{)"),
        ("variable_declarator", rf"\b(?:const|let|var)\s+{_N}\s*=\s*(?:async\s*)?(?:function\s*\w*\s*)?{_A}[^=;{{}}]*(?:=>\s*)?(?=\{{)"), ("variable_declarator", rf"\b(?:const|let|var)\s+{_N}\s*=\s*(?:async\s*)?{_A}[^=;{{}}]*=>(?=\s*[^\s{{])"),
        ("method_definition", rf"^[ \t]*(?:async\s+|static\s+|get\s+|set\s+)*{_N}\s*{_A}[^;{{}}()=]*(?=\{{)"),
    ],
    "rust": [
        ("struct_item", rf"\bstruct\s+{_N}[^;{{}}()]*(?=\{{)"), ("enum_item", rf"\benum\s+{_N}[^;{{}}]*(?=\{{)"), ("trait_item", rf"\btrait\s+{_N}[^;{{}}]*(?=\{{)"), ("mod_item", rf"\bmod\s+{_N}\s*(?=\{{)"),
        ("impl", rf"\bimpl\b(?:<[^>]*>)?\s+(?P<trait>[\w:<>]+\s+for\s+)?{_N}[^;{{}}]*(?=\{{)"), ("function_item", rf"\bfn\s+{_N}(?:<[^>]*>)?\s*\((?P<args>[^;{{}}]*?)\)[^;{{}}]*(?=\{{)"),
    ],
    "go": [("type_spec", rf"\btype\s+{_N}\s+(?:struct|interface)\s*(?=\{{)"), ("method_declaration", rf"\bfunc\s*\(\s*(?P<self>\w*)\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*{_N}\s*{_A}[^{{}}]*(?=\{{)"), ("function_declaration", rf"\bfunc\s+{_N}(?:\[[^\]]*\])?\s*{_A}[^{{}}]*(?=\{{)")],
    "java": [
        ("class_declaration", rf"\b(?:class|record)\s+{_N}[^;{{}}]*(?=\{{)"), ("interface_declaration", rf"\binterface\s+{_N}[^;{{}}]*(?=\{{)"), ("enum_declaration", rf"\benum\s+{_N}[^;{{}}]*(?=\{{)"),
        ("method_declaration", rf"(?:^|(?<=[;{{}}]))[ \t]*(?:[\w<>\[\],.?@]+\s+)+{_N}\s*{_A}[^;{{}}()=]*(?=\{{)"), ("constructor_declaration", rf"(?:^|(?<=[;{{}}]))[ \t]*(?:(?:public|private|protected|internal)\s+)?{_N}\s*{_A}\s*(?::\s*(?:this|base)\s*\([^{{}};]*\)\s*)?(?:throws[^{{;]*)?(?=\{{)"),
    ],
    "kotlin": [
        ("class_declaration", rf"\b(?:class|interface)\s+{_N}[^{{}}\n]*(?=\{{)"), ("object_declaration", rf"\bobject\s+{_N}[^{{}}\n]*(?=\{{)"), ("function_declaration", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?{_N}\s*{_A}[^{{}}=\n]*(?=\{{)"),
        ("function_declaration", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?{_N}\s*{_A}[^{{}}=\n]*=(?!=)"),
    ],
}
HEADERS["typescript"] = HEADERS["tsx"] = [*HEADERS["javascript"], ("interface_declaration", rf"\binterface\s+{_N}[^;{{}}]*(?=\{{)"), ("enum_declaration", rf"\benum\s+{_N}\s*(?=\{{)")]
HEADERS["csharp"] = [
    *HEADERS["java"], ("struct_declaration", rf"\bstruct\s+{_N}[^;{{}}]*(?=\{{)"), ("namespace", r"\bnamespace\s+(?P<name>[\w.]+)\s*(?=\{)"),
    ("method_declaration", rf"(?:^|(?<=[;{{}}]))[ \t]*(?:[\w<>\[\],.?]+\s+)+{_N}\s*{_A}[^;{{}}()=]*=>"),
]
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in rules] for lang, rules in HEADERS.items()}
#: Blocks that name a scope and are no symbol of their own.
_SCOPES = ("impl", "namespace", "namespace_definition")
TYPES = ("class_specifier", "struct_specifier", "union_specifier", "class_declaration", "interface_declaration", "enum_declaration", "struct_declaration", "object_declaration", "struct_item", "enum_item", "trait_item", "type_spec")
_DOTTED = ("java", "kotlin", "csharp")


@lru_cache(maxsize=64)
def _blanked(source: str) -> str:
    return _BLANK.sub(lambda m: "".join(c if c == "\n" else " " for c in m.group()), source)


def strip_generics(text: str) -> str:
    """Without balanced <...> groups; the text itself where they don't balance."""
    out, depth = [], 0
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return text if depth else "".join(out)


def _blocks(text: str) -> dict[int, int]:
    open_, out = [], {}
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def _expression_end(text: str, at: int) -> int:
    """Where an expression body ends: a semicolon or line end outside brackets, or the bracket around it."""
    depth, seen = 0, False
    for k in range(at, len(text)):
        c = text[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if not depth:
                return k
            depth -= 1
        elif not depth and (c == ";" or (c == "\n" and seen)):
            return k
        seen = seen or not c.isspace()
    return len(text)


def split_list(text: str) -> list[str]:
    """Parts between commas outside all brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[k - 1 : k] not in ("-", "=")):
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [p for p in (x.strip() for x in [*out, text[at:]]) if p]


def _arguments(text: str, at: int, end: int) -> int | None:
    """How many arguments the call has whose bracket is at ``at``."""
    depth = 0
    for k in range(at, end):
        if text[k] in "([{":
            depth += 1
        elif text[k] in ")]}":
            depth -= 1
            if not depth:
                return len(split_list(text[at + 1 : k]))
    return None


# ---- what a file says about names: package, imports, exports


_PACKAGE = {
    "java": re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M), "kotlin": re.compile(r"^\s*package\s+([\w.]+)", re.M),
    "csharp": re.compile(r"^\s*namespace\s+([\w.]+)\s*;", re.M), "go": re.compile(r"^\s*package\s+(\w+)", re.M),
}


def package_of(source: str, language: str) -> str | None:
    m = _PACKAGE[language].search(_blanked(source)) if language in _PACKAGE else None
    return m.group(1) if m else None


class Names:
    """Imports of a file: what a local name means, and namespaces that are searched last.  A name bound twice means nothing."""

    def __init__(self, source: str, language: str):
        text = _BLANK.sub(lambda m: m.group() if m.group()[0] in "\"'`" else " " * len(m.group()), source)
        self.local: dict[str, str | None] = {}
        self.static: dict[str, str | None] = {}
        self.open: list[str] = []
        self.open_static: list[str] = []
        self.global_open: list[str] = []
        self.global_static: list[str] = []
        put = lambda table, k, v: table.__setitem__(k, None if k in table and table[k] != v else v)
        joined = lambda dotted: strip_generics(dotted).replace(" ", "").replace(".", "::")
        if language == "java":
            for static, name in re.findall(r"^\s*import\s+(static\s+)?([\w.]+)\s*;", text, re.M):
                put(self.static if static else self.local, name.rpartition(".")[2], joined(name))
        elif language == "kotlin":
            for name, alias in re.findall(r"^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?\s*$", text, re.M):
                put(self.local, alias or name.rpartition(".")[2], joined(name))
        elif language == "csharp":
            for every, static, alias, name in re.findall(r"\b(global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?((?:global::)?[\w.]+(?:<[^;]*>)?)\s*;", text):
                name = joined(name.removeprefix("global::"))
                if alias:
                    put(self.local, alias, name)
                elif static:
                    (self.global_static if every else self.open_static).append(name)
                else:
                    (self.global_open if every else self.open).append(name)
        elif language == "cpp":
            self.open = re.findall(r"\busing\s+namespace\s+([\w:]+)\s*;", text)
            for name in re.findall(r"\busing\s+([A-Za-z_]\w*(?:::\w+)+)\s*;", text):
                put(self.local, name.rpartition("::")[2], name)
            for alias, name in [*re.findall(r"\bnamespace\s+(\w+)\s*=\s*([\w:]+)\s*;", text), *re.findall(r"\busing\s+(\w+)\s*=\s*([\w:]+)(?:<[^;]*>)?\s*;", text)]:
                put(self.local, alias, name)
        elif language == "rust":
            for tree in re.findall(r"\buse\s+([^;]+);", text):
                for path, alias in _use_paths("".join(tree.split("\n"))):
                    put(self.local, alias, path)
        elif language == "go":
            for block in re.findall(r"\bimport\s*\(([^)]*)\)", text) + re.findall(r"^\s*import\s+((?:\w+\s+)?\"[^\"]+\")", text, re.M):
                for alias, path in re.findall(r"(?:(\w+)\s+)?\"([^\"]+)\"", block):
                    put(self.local, alias or path.rpartition("/")[2], path)
        elif language in ("javascript", "typescript", "tsx"):
            for local, module, name in script_imports(text):
                put(self.local, local, f"{module}|{name}")


def _use_paths(tree: str):
    """(path, local name) of a use tree; wildcards are left out."""
    tree = tree.strip()
    m = re.match(r"^(.*?)(?:::)?\{(.*)\}$", tree, re.S)
    if m:
        for part in split_list(m.group(2)):
            for path, alias in _use_paths(part):
                yield ("::".join(p for p in (m.group(1), path) if p), alias) if path != "self" else (m.group(1), m.group(1).rpartition("::")[2])
        return
    path, _, alias = (p.strip() for p in tree.partition(" as "))
    if "*" not in path and path:
        yield path, alias or path.rpartition("::")[2]


def script_imports(text: str):
    """(local name, module, imported name): default, * for the module itself, or the name."""
    for names, module in re.findall(r"\bimport\s+(?:type\s+)?([^'\";]+?)\s+from\s*['\"]([^'\"]+)['\"]", text):
        m = re.match(r"^([A-Za-z_$][\w$]*)?\s*,?\s*(.*)$", names, re.S)
        if m.group(1):
            yield m.group(1), module, "default"
        rest = m.group(2).strip()
        if star := re.match(r"^\*\s*as\s+([\w$]+)$", rest):
            yield star.group(1), module, "*"
        elif rest.startswith("{"):
            for part in split_list(rest.strip("{} \n")):
                name, _, alias = (p.strip() for p in part.partition(" as "))
                yield alias or name, module, name
    for local, module in re.findall(r"\b(?:const|let|var|import)\s+([A-Za-z_$][\w$]*)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        yield local, module, "*"
    for names, module in re.findall(r"\b(?:const|let|var)\s*\{([^}]*)\}\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        for part in split_list(names):
            name, _, alias = (p.strip() for p in part.partition("=")[0].partition(":"))
            yield alias or name, module, name


def script_exports(source: str):
    """(kind, name, module or local name, name there): direct exports of the file's own names, named ones from other modules, stars."""
    text = _BLANK.sub(lambda m: m.group() if m.group()[0] in "\"'`" else " " * len(m.group()), source)
    own = {local: (module, name) for local, module, name in script_imports(text)}

    def export(name: str, local: str):
        if local in own and own[local][1] != "*":
            return "named", name, own[local][0], own[local][1]
        return "direct", name, local, ""

    for default, name in re.findall(r"\bexport\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|enum)\s+([A-Za-z_$][\w$]*)", text):
        yield "direct", "default" if default else name, name, ""
    for name in re.findall(r"\bexport\s+default\s+([A-Za-z_$][\w$]*)\s*;?\s*$", text, re.M):
        if name not in ("function", "class", "async"):
            yield export("default", name)
    for names, module in re.findall(r"\bexport\s*(?:type\s*)?\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?", text):
        for part in split_list(names):
            name, _, alias = (p.strip() for p in part.partition(" as "))
            yield ("named", alias or name, module, name) if module else export(alias or name, name)
    for module in re.findall(r"\bexport\s*\*\s*from\s*['\"]([^'\"]+)['\"]", text):
        yield "star", "", module, ""
    for module in re.findall(r"\bmodule\.exports\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", text):
        yield "star", "", module, ""
        yield "named", "default", module, "default"
    for name in re.findall(r"\b(?:module\.exports|export)\s*=\s*([A-Za-z_$][\w$]*)\s*;?\s*$", text, re.M):
        yield export("default", name)
    for names in re.findall(r"\bmodule\.exports\s*=\s*\{([^{}]*)\}", text):
        for part in split_list(names):
            if spread := re.match(r"^\.\.\.\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)$", part):
                yield "star", "", spread.group(1), ""
            elif re.match(r"^[\w$]+(\s*:\s*[\w$]+)?$", part):
                name, _, local = (p.strip() for p in part.partition(":"))
                yield export(name, local or name)
    for name, local in re.findall(r"\b(?:module\.)?exports\.([\w$]+)\s*=\s*([A-Za-z_$][\w$]*)\s*;?\s*$", text, re.M):
        yield export(name, local)
    for name in re.findall(r"\b(?:module\.)?exports\.([\w$]+)\s*=\s*(?:async\s*)?function", text):
        yield "direct", name, name, ""


# ---- declarations and calls


_LOCALS = {
    "c": r"\b(?P<type>[A-Za-z_][\w:]*)(?:<[^;(){}]*>)?[\s*&]+(?P<var>[A-Za-z_]\w*)\s*(?=[=;,)\[{:])", "kotlin": r"\b(?:val|var)\s+(?P<var>\w+)(?:\s*:\s*(?P<type>[\w.]+))?(?:<[^=\n]*>)?(?:\??\s*=\s*(?P<made>[A-Z][\w.]*)\s*(?:<[^()]*>)?\()?",
    "go": r"\b(?P<var>\w+)\s*:=\s*&?(?P<made>[A-Z]\w*)?(?:\[[^\]]*\])?|\bvar\s+(?P<var2>\w+)\s+\*?(?P<type>\w+)", "rust": r"\blet\s+(?:mut\s+)?(?P<var>\w+)(?:\s*:\s*&?(?:mut\s+)?(?P<type>[\w:]+))?(?:[^=;]*=\s*&?(?P<made>[A-Z]\w*)\s*(?:::|\{))?",
    "javascript": r"\b(?:const|let|var)\s+(?P<var>[\w$]+)(?:\s*:\s*(?P<type>\w+))?(?:\s*=\s*new\s+(?P<made>[\w$.]+))?|\bfunction\s+(?P<var2>[\w$]+)|\bcatch\s*\(\s*(?P<var3>[\w$]+)",
}
_LOCALS |= dict.fromkeys(("cpp", "java", "csharp"), _LOCALS["c"]) | dict.fromkeys(("typescript", "tsx"), _LOCALS["javascript"])
_LOCALS = {k: re.compile(v) for k, v in _LOCALS.items()}
_NO_TYPES = frozenset("return new throw else case goto using typedef delete await yield in out ref not is as var let const val auto".split())


def _locals(text: str, language: str, args: str, begin: int, end: int) -> tuple[set[str], dict[str, str]]:
    """Names that a body binds, and the types of those whose type is written."""
    bound: set[str] = set()
    types: dict[str, str] = {}

    def put(name: str, kind: str | None) -> None:
        bound.add(name)
        if kind:
            types[name] = strip_generics(kind)

    for p in split_list(args):
        p = re.sub(r"=.*$", "", strip_generics(p)).strip()
        if language in ("kotlin", "rust", "typescript", "tsx", "javascript"):
            name, _, kind = (x.strip() for x in p.partition(":"))
            names = re.findall(r"[A-Za-z_$][\w$]*", name)
            if names:
                put(names[-1], re.sub(r"^&?\s*(?:mut\s+)?", "", kind).rstrip("?") or None)
        elif language == "go":
            words = p.split()
            if words:
                put(words[0], words[-1].lstrip("*") if len(words) > 1 else None)
        elif m := re.match(r"^(?:[\w@]+\s+)*?(?P<type>[A-Za-z_][\w:.]*)[\s*&]+(?P<var>[A-Za-z_]\w*)(?:\[\])?$", p):
            put(m.group("var"), m.group("type"))
    for m in _LOCALS[language].finditer(text, begin, end):
        g = m.groupdict()
        name = g.get("var") or g.get("var2") or g.get("var3")
        kind = g.get("type") or g.get("made")
        if kind in _NO_TYPES:
            if kind not in ("var", "auto", "let", "const", "val"):
                continue
            made = re.match(r"\s*=\s*new\s+([\w.]+)|\s*=\s*([A-Z][\w.:]*)\s*[({]", text[m.end() : m.end() + 120])
            kind = (made.group(1) or made.group(2)) if made else None
        if name and name not in _NOT_CALLS:
            put(name, kind)
    return bound, types


class _Scopes:
    """The paths that a name may mean at a place of a file."""

    def __init__(self, language: str, names: Names, package: list[str]):
        self.language, self.names, self.package = language, names, package

    def outward(self, scope: list[str], tail: list[str]) -> list[str]:
        return ["::".join([*scope[:k], *tail]) for k in range(len(scope), -1, -1)]

    def of_type(self, scope: list[str], kind: list[str]) -> list[str]:
        """A type's paths; scope: the enclosing types and namespaces."""
        first, lang, n = kind[0], self.language, self.names
        if lang in ("javascript", "typescript", "tsx"):
            return self.of_script(kind)
        alias = n.local.get(first, "")
        found = ["::".join([alias, *kind[1:]])] if alias else []
        if alias is None:
            return []
        if lang in _DOTTED:
            near = ["::".join([*scope[:k], *kind]) for k in range(len(scope), len(self.package), -1)]
            here = ["::".join([*scope[:k], *kind]) for k in range(len(self.package), -1, -1)] if lang == "csharp" else ["::".join([*self.package, *kind])]
            whole = ["::".join(kind)] if len(kind) > 1 or not self.package else []
            return [*near, *found, *here, *("::".join([o, *kind]) for o in n.open), *whole]
        if lang == "cpp":
            return [*found, *self.outward(scope, kind), *("::".join([o, *kind]) for o in n.open)]
        if lang == "rust":
            return self.of_rust(scope, kind)
        if lang == "go":
            return [f"@dir::{self.package[0] if self.package else ''}.{'::'.join(kind)}"]
        return found

    def of_rust(self, scope: list[str], path: list[str]) -> list[str]:
        alias = self.names.local.get(path[0], "")
        if alias is None:
            return []
        if alias:
            path = [*alias.split("::"), *path[1:]]
        scope = list(scope)
        while path[0] == "super" and scope:  # out of an inline module
            scope, path = scope[:-1], ["self" if len(path) > 1 and path[1] != "super" else "", *path[1:]]
            path = path if path[0] else path[1:]
        if path[0] in ("crate", "super"):
            return ["@" + "::".join(path)]
        return ["@self::" + "::".join([*scope, *(path[1:] if path[0] == "self" else path)])]

    def of_script(self, path: list[str]) -> list[str]:
        alias = self.names.local.get(path[0], "")
        if alias is None:
            return []
        if alias:
            module, _, name = alias.rpartition("|")
            if name == "*":
                return [f"@js:{module}|{'::'.join(path[1:]) if len(path) > 1 else 'default'}"]
            return [f"@js:{module}|{'::'.join([name, *path[1:]])}"]
        return ["@file::" + "::".join(path)]

    def of_call(self, spelling: str, made: bool, scope: list[str], types: list[str], bound: set[str], known: dict[str, str], self_name: str | None) -> tuple[str, list[str]]:
        """(kind, paths): bare, this, super, new, path or value; no path where the name is bound by the body itself.
        types: the path of the innermost type around the call, or nothing; scope: the scopes around the declaration."""
        lang, n = self.language, self.names
        parts = [p for p in re.split(r"::|\.|->", strip_generics(spelling)) if p]
        if not parts or not all(re.fullmatch(r"~?[A-Za-z_$][\w$]*", p) for p in parts):
            return "other", []
        if made:
            kinds = self.of_type(scope, parts)
            return "new", [x for k in kinds for x in (f"{k}::{parts[-1]}", k)] if lang in (*_DOTTED, "cpp") else kinds
        first, rest = parts[0], parts[1:]
        if lang == "csharp" and first == "global" and spelling.startswith("global::"):
            return "path", ["::".join(rest)]
        if first == "this" and not rest and lang in _DOTTED:  # another constructor of the type
            return "this", ["::".join([*types, types[-1]])] if types else []
        if first in ("this", "self", "Self") and lang != "go" and not (lang == "rust" and first == "self" and "::" in spelling):
            return ("this", ["::".join([*types, *rest])]) if types and len(rest) == 1 else ("this", [])
        if first in ("super", "base") and lang in _DOTTED:
            return "super", []
        if lang == "go" and self_name and first == self_name and len(rest) == 1 and types:
            return "this", [f"@dir::{self.package[0]}.{types[-1]}::{rest[0]}"]
        if first in bound:
            if not rest or first not in known or len(rest) != 1:
                return "value", []
            kind = [p for p in re.split(r"::|\.", known[first]) if p]
            return "value", [f"{k}::{rest[0]}" for k in self.of_type(scope, kind)] if kind and all(re.fullmatch(r"\w+", k) for k in kind) else []
        if lang in ("javascript", "typescript", "tsx"):
            return ("path" if rest else "bare"), self.of_script(parts)
        if lang == "rust":
            return ("path" if rest else "bare"), self.of_rust(scope, parts)
        if lang == "go":
            if not rest:
                return "bare", [f"@dir::{self.package[0] if self.package else ''}.{first}"]
            return "path", [f"@go:{n.local[first]}|{'::'.join(rest)}"] if n.local.get(first) else []
        if lang == "cpp":
            alias = n.local.get(first)
            return ("path" if rest else "bare"), [*self.outward(scope, parts), *(["::".join([alias, *rest])] if alias else []), *("::".join([o, *parts]) for o in n.open)]
        if lang == "c":
            return "bare", []
        if not rest:  # enclosing types, then what is imported
            own = ["::".join([*scope[:k], first]) for k in range(len(scope), len(self.package), -1)]
            package = ["::".join([*self.package, first])] if lang == "kotlin" else []
            static = [p for p in (n.static.get(first), n.local.get(first) if lang == "kotlin" else None) if p]
            return "bare", [*own, *static, *package, *(f"{o}::{first}" for o in n.open_static)]
        return "path", [f"{k}::{rest[-1]}" for k in self.of_type(scope, parts[:-1])]


def declarations(source: str, language: str) -> list[dict]:
    text = _blanked(source)
    blocks = _blocks(text)
    found: dict[int, tuple[str, re.Match, int]] = {}
    for kind, pattern in _COMPILED.get(language, ()):
        for m in pattern.finditer(text):
            name, at = m.group("name"), m.end()
            if at in found or name in _NOT_CALLS:
                continue
            if at in blocks:
                found[at] = (kind, m, blocks[at])
            elif m.group().endswith("=") or m.group().endswith("=>"):
                found[at] = (kind, m, _expression_end(text, at))
    start_of = lambda m: m.start("from") if "from" in m.groupdict() else m.start() + len(m.group()) - len(m.group().lstrip())
    rows = sorted(((start_of(m), end, begin, kind, m) for begin, (kind, m, end) in found.items()), key=lambda r: (r[0], -r[1]))
    package = [p for p in (package_of(source, language) or "").split(".") if p]
    scopes = _Scopes(language, Names(source, language), package)
    prefix = package if language in _DOTTED else []
    sizes = [0]
    for line in source.split("\n"):
        sizes.append(sizes[-1] + len(line) + 1)
    out, stack = [], []
    inner = [(begin, end) for _, end, begin, kind, _ in rows if kind not in _SCOPES]
    for start, end, begin, kind, m in rows:
        while stack and stack[-1][0] <= start:
            stack.pop()
        groups = m.groupdict()
        around = stack[-1][1] if stack else prefix
        name = m.group("name")
        if kind == "method_declaration" and language in _DOTTED and around and around[-1] == name:  # a modifier looked like a type
            kind = "constructor_declaration"
        if kind == "constructor_declaration" and (not around or around[-1] != name):
            continue
        owner = [p for p in (groups.get("owner") or "").split("::") if p]
        path = [*around, *owner, *(name.split(".") if kind == "namespace" else name.split("::") if kind == "namespace_definition" else [name])]
        held = kind in TYPES or kind == "impl"
        stack.append((end, path, held, bool(groups.get("trait")) or (bool(stack) and stack[-1][3]), kind))
        if kind in _SCOPES or stack[-1][3]:  # members of a trait's implementation aren't symbols
            continue
        args = groups.get("args")
        names: set[str] = set()
        arities: dict[str, set[int]] = {}
        calls: dict[tuple, None] = {}
        if args is not None:
            bound, known = _locals(text, language, args, begin, end)
            type_path = next((p for _, p, t, _, _ in reversed(stack[:-1]) if t), [])
            if owner:
                type_path = [*around, *owner]
            # modules alone are scopes of Rust's names
            scope = [p[-1] for _, p, _, _, k in stack[:-1] if k == "mod_item"] if language == "rust" else [*around, *owner]
            nested = [(a, e) for a, e in inner if begin < a and e <= end and language not in ("go", "rust")]
            self_name = groups.get("self") or None
            hits = [(c.group(1), c.end(), None) for c in _CALL.finditer(text, begin, end)]
            hits += [(f"{c.group(1)}.{c.group(2)}", c.end(), c.group(1)) for c in _MADE.finditer(text, begin, end) if language == "go" or text[c.start() : c.start() + 4] == "new "]
            if kind == "constructor_declaration" and (c := re.search(r":\s*(this|base)\s*(?=\()", text[start:begin])):  # C# names it in the header
                word, at = c.group(1), start + c.end()
                sort, paths = scopes.of_call(word, False, scope, type_path, bound, known, None)
                calls[(word, _arguments(text, at, begin), sort, tuple(paths), "::".join(type_path))] = None
            for spelled, at, of in hits:
                made = spelled.startswith("new ")
                word = strip_generics(re.sub(r"^new\s+", "", spelled))
                if re.split(r"\.|::|->", word)[0] in _NOT_CALLS or any(a <= at <= e for a, e in nested):
                    continue
                n = _arguments(text, at, end)
                names.add(word)
                if n is not None:
                    arities.setdefault(word, set()).add(n)
                if of is None:
                    sort, paths = scopes.of_call(word, made, scope, type_path, bound, known, self_name)
                else:  # a member of an object made on the spot
                    sort, paths = "value", [f"{k}::{word.rpartition('.')[2]}" for k in scopes.of_type(scope, of.split("."))]
                calls[(word, n, sort, tuple(dict.fromkeys(paths)), "::".join(type_path))] = None
        spelled_path = "::".join(path)
        scope_path = "::".join(path[:-1]) or None
        if language == "go":
            spelled_path = f"{package[0] if package else 'main'}.{spelled_path}"
            scope_path = f"{package[0] if package else 'main'}" + (f".{path[0]}" if len(path) > 1 else "")
        first, last = len(source[:start].encode()), len(source[:end].encode())
        out.append({
            "semantic_path": spelled_path, "scope_path": scope_path, "node_kind": kind, "start_byte": first, "end_byte": last, "signature": " ".join(source[start:begin].split()).removesuffix("=").rstrip().removesuffix("=").rstrip(),
            "parameters": split_list(args or ""), "return_type": None, "docstring": None, "reference_names": sorted(names - {path[-1]}),
            "reference_call_arities": {k: sorted(v) for k, v in sorted(arities.items())}, "is_overload": False,
            "calls": [{"name": w, "arity": n, "kind": s, "paths": list(p), "within": t} for w, n, s, p, t in calls],
            "bases": _bases(m.group(), language, scopes, around) if kind in TYPES else [],
            "interfaces": _interfaces(m.group(), kind, scopes, around) if language == "java" and kind in TYPES else [],
        })
    return out


def _bases(header: str, language: str, scopes: _Scopes, around: list[str]) -> list[list[str]]:
    """For each base class that a header names: the paths that it may mean."""
    if language == "java":
        m = re.search(r"\bextends\s+([\w.]+)", header)
    elif language in ("csharp", "kotlin", "cpp"):
        m = re.search(r"(?<!:):(?!:)\s*(?:public\s+|virtual\s+)?([\w.:]+)", strip_generics(header))
    elif language in ("javascript", "typescript", "tsx"):
        m = re.search(r"\bextends\s+([\w.$]+)", header)
    else:
        m = None
    kind = [p for p in re.split(r"::|\.", m.group(1)) if p] if m else []
    if kind[:1] == ["global"]:
        return [["::".join(kind[1:])]]
    return [scopes.of_type(around, kind)] if kind else []


def _interfaces(header: str, kind: str, scopes: _Scopes, around: list[str]) -> list[list[str]]:
    """For each interface that a Java header names: the paths that it may mean."""
    m = re.search(r"\b(?:extends|implements)\s+(.*)$" if kind == "interface_declaration" else r"\bimplements\s+(.*)$", " ".join(header.split()))
    names = split_list(strip_generics(m.group(1))) if m else []
    return [scopes.of_type(around, n.split(".")) for n in names if re.fullmatch(r"[\w.]+", n)]


# ---- file dependencies and issues


_IMPORTS = {
    "javascript": re.compile(r"(?:from\s*|import\s*|require\s*\(\s*)['\"]([^'\"]+)['\"]"),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*\"([^\"]+)\"", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)", re.M), "kotlin": re.compile(r"^\s*import\s+([\w.]+)", re.M), "csharp": re.compile(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", re.M),
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", re.M),
}
_IMPORTS |= {"typescript": _IMPORTS["javascript"], "tsx": _IMPORTS["javascript"], "cpp": _IMPORTS["c"]}


def imported_modules(source: str, language: str) -> list[str]:
    if language == "go":
        return sorted({p for p in Names(source, language).local.values() if p})
    pattern = _IMPORTS.get(language)
    return sorted({next(g for g in m.groups() if g) for m in pattern.finditer(source)}) if pattern else []


def facts(source: str, language: str) -> list[tuple[str, str, str, str]]:
    """(kind, name, target, target name): package, script exports, module declarations, namespaces open to all files."""
    out = [("package", "", p, "") for p in [package_of(source, language)] if p]
    if language in ("javascript", "typescript", "tsx"):
        out += list(dict.fromkeys(script_exports(source)))
    if language == "csharp":
        n = Names(source, language)
        out += [("global_static", "", t, "") for t in n.global_static] + [("global_open", "", t, "") for t in n.global_open]
    return out


def issues(source: str) -> list[dict]:
    """Brackets that don't match."""
    text, stack = _blanked(source), []
    pairs = {")": "(", "]": "[", "}": "{"}
    lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(at: int) -> dict:
        row = bisect_right(lines, at) - 1
        return {"row": row, "column_no": len(source[lines[row] : at].encode())}

    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group()
        if c in "([{":
            stack.append((c, m.start()))
        elif not stack or stack.pop()[0] != pairs[c]:
            return [{"kind": "error", "message": f"unmatched {c}"} | place(m.start())]
    return [{"kind": "missing", "message": f"unclosed {c}"} | place(at) for c, at in stack[-1:]]
