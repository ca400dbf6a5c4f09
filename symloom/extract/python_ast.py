"""Declarations, references and syntax issues of Python sources, from the standard library's syntax tree."""

from __future__ import annotations

import ast

DEFINITIONS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


class _Offsets:
    """Byte offsets of (line, UTF-8 column)."""

    def __init__(self, source: str):
        self.starts, at = [0], 0
        for line in source.split("\n"):
            at += len(line.encode()) + 1
            self.starts.append(at)

    def __call__(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column


def _imports(tree: ast.AST) -> dict[str, str]:
    """Local name to ``module`` or ``module.symbol``."""
    out = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out[a.asname or a.name] = "." * node.level + (f"{node.module}." if node.module else "") + a.name
    return out


def _bound(node: ast.AST) -> set[str]:
    """Names that a function binds itself: parameters, targets, handlers, captures - not nested definitions."""
    names: set[str] = set()
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        a = node.args
        names |= {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
        outer: set[str] = set()
        todo = list(node.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.Global, ast.Nonlocal)):
                outer |= set(x.names)
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                names.add(x.id)
            elif isinstance(x, ast.ExceptHandler) and x.name:
                names.add(x.name)
            elif isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
                names.add(x.name)
            if not isinstance(x, (*DEFINITIONS, ast.Lambda)):
                todo.extend(ast.iter_child_nodes(x))
        names -= outer
    return names


def _instances(node: ast.AST) -> dict[str, str]:
    """x = T() makes x.m a reference to T.m."""
    out = {}
    for x in ast.walk(node):
        if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name):
            out[x.targets[0].id] = x.value.func.id
    return out


def _references(node: ast.AST, imports: dict[str, str]) -> tuple[list[str], dict[str, list[int]]]:
    """Names that the definition refers to, nested bodies included, and the argument counts of calls."""
    found: set[str] = set()
    arities: dict[str, set[int]] = {}
    own = {getattr(node, "name", None)}

    def name_of(x: ast.AST, hidden: set[str], types: dict[str, str]) -> str | None:
        if isinstance(x, ast.Name):
            return None if x.id in hidden else imports.get(x.id, x.id)
        if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name):
            root = x.value.id
            if root in types:
                return f"{types[root]}.{x.attr}"
            if root not in hidden and root in imports:
                return f"{imports[root]}.{x.attr}"
        return None

    def visit(x: ast.AST, hidden: set[str], types: dict[str, str]) -> None:
        if isinstance(x, ast.Attribute) and (name := name_of(x, hidden, types)):
            found.add(name)
            return
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and (name := name_of(x, hidden, types)):
            found.add(name)
        if isinstance(x, ast.Call) and (name := name_of(x.func, hidden, types)) and not any(isinstance(a, ast.Starred) for a in x.args):
            arities.setdefault(name, set()).add(len(x.args) + len(x.keywords))
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in [*x.decorator_list, *x.args.defaults, *filter(None, x.args.kw_defaults)]:
                visit(d, hidden, types)
            inner, kinds = hidden | _bound(x), types | _instances(x)
            for b in x.body:
                visit(b, inner, kinds)
        elif isinstance(x, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp, ast.Lambda)):
            inner = hidden | {n.id for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            if isinstance(x, ast.Lambda):
                inner |= {a.arg for a in x.args.args}
            for c in ast.iter_child_nodes(x):
                visit(c, inner, types)
        else:
            for field, value in ast.iter_fields(x):
                if field in ("annotation", "returns"):
                    continue
                for c in value if isinstance(value, list) else [value]:
                    if isinstance(c, ast.AST):
                        visit(c, hidden, types)

    visit(node, set(), {})
    return sorted(found - own), {k: sorted(v) for k, v in sorted(arities.items())}


_TYPING = ("typing", "typing_extensions")


def _overloads(tree: ast.Module) -> set[int]:
    """ids of the nodes that an overload decorator stands on.  Names for it are followed in source order: imports and
    assignments make one, any other binding of the name ends it; inner scopes see what was so far."""
    found: set[int] = set()

    def meaning(x: ast.AST, env: dict[str, str]) -> str | None:
        if isinstance(x, ast.Name):
            return env.get(x.id)
        if isinstance(x, ast.Attribute) and x.attr == "overload" and isinstance(x.value, ast.Name) and env.get(x.value.id) == "module":
            return "overload"
        return None

    def bind(env: dict[str, str], name: str, sense: str | None) -> None:
        env.pop(name, None)
        if sense:
            env[name] = sense

    def run(body: list[ast.stmt], env: dict[str, str]) -> None:
        for x in body:
            if isinstance(x, DEFINITIONS):
                if any(meaning(d, env) == "overload" for d in x.decorator_list):
                    found.add(id(x))
                bind(env, x.name, None)
                inner = dict(env)
                for name in _bound(x):
                    inner.pop(name, None)
                run(x.body, inner)
            elif isinstance(x, ast.Import):
                for a in x.names:
                    bind(env, a.asname or a.name.split(".")[0], "module" if a.name in _TYPING else None)
            elif isinstance(x, ast.ImportFrom):
                typing = x.module in _TYPING and not x.level
                for a in x.names:
                    name = "overload" if a.name == "*" else a.asname or a.name  # an unknown module may bind any name
                    bind(env, name, "overload" if typing and a.name in ("overload", "*") else None)
            else:
                sense = meaning(x.value, env) if isinstance(x, (ast.Assign, ast.AnnAssign)) and x.value else None
                for n in ast.walk(x):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
                        bind(env, n.id, sense)
                    elif isinstance(n, (ast.MatchAs, ast.MatchStar, ast.ExceptHandler)) and n.name:
                        bind(env, n.name, None)
                    elif isinstance(n, ast.MatchMapping) and n.rest:
                        bind(env, n.rest, None)
                for field in ("body", "orelse", "finalbody"):
                    run([c for c in getattr(x, field, []) if isinstance(c, ast.stmt)], env)
                for part in [*getattr(x, "handlers", []), *getattr(x, "cases", [])]:
                    run(part.body, env)

    run(tree.body, {})
    return found


def declarations(source: str) -> list[dict]:
    """One row per class and function at any depth, in source order; nothing for a source that doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    at, imports, out = _Offsets(source), _imports(tree), []
    overloads = _overloads(tree)

    def walk(node: ast.AST, path: list[str]) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, DEFINITIONS):
                here = [*path, x.name]
                first = min([x, *x.decorator_list], key=lambda n: (n.lineno, n.col_offset))
                column = first.col_offset - (first is not x)  # the @ before a decorator
                is_class = isinstance(x, ast.ClassDef)
                parameters = [] if is_class else [p for p in ast.unparse(x.args).split(", ") if p]
                head = f"class {x.name}" + (f"({', '.join(map(ast.unparse, x.bases))})" if x.bases else "") if is_class else f"def {x.name}({ast.unparse(x.args)})"
                names, arities = _references(x, imports)
                out.append({
                    "semantic_path": ".".join(here), "scope_path": ".".join(path) or None, "node_kind": "class_definition" if is_class else "function_definition",
                    "start_byte": at(first.lineno, column), "end_byte": at(x.end_lineno, x.end_col_offset), "signature": head, "parameters": parameters,
                    "return_type": ast.unparse(x.returns) if not is_class and x.returns else None, "docstring": ast.get_docstring(x), "reference_names": names,
                    "reference_call_arities": arities, "is_overload": id(x) in overloads,
                })
                walk(x, here)
            else:
                walk(x, path)

    walk(tree, [])
    return out


def issues(source: str) -> list[dict]:
    """Syntax errors with their place: kind, row, column_no, message."""
    try:
        ast.parse(source)
        return []
    except SyntaxError as e:
        return [{"kind": "error", "row": (e.lineno or 1) - 1, "column_no": max(0, (e.offset or 1) - 1), "message": e.msg or "syntax error"}]
    except (ValueError, RecursionError) as e:
        return [{"kind": "error", "row": 0, "column_no": 0, "message": str(e)}]


def imported_modules(source: str) -> list[str]:
    """Modules as written: dots, then the name; for ``from m import x`` both m and m.x."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            stem = "." * node.level + (node.module or "")
            out.add(stem)
            out |= {f"{stem}{'' if stem.endswith('.') else '.'}{a.name}" for a in node.names if a.name != "*"}
    return sorted(out)
