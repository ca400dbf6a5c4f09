"""Source files as rows of a syntax tree: node_id, parent_id, field, kind, start_byte, end_byte, text.

Python comes from the standard syntax tree, under the kind and field names that are usual for concrete trees.  The brace
languages have declarations, their names and parameters, and calls; that is what their extractor knows."""

from __future__ import annotations

import ast
import re

from symloom.extract import lexical, python_ast

# Kinds and fields of nodes by class of the standard tree.
KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Name": "identifier", "Attribute": "attribute",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "Return": "return_statement", "If": "if_statement",
    "For": "for_statement", "While": "while_statement", "With": "with_statement", "Try": "try_statement", "Raise": "raise_statement", "Lambda": "lambda", "ListComp": "list_comprehension", "DictComp": "dictionary_comprehension",
    "SetComp": "set_comprehension", "GeneratorExp": "generator_expression", "BinOp": "binary_operator", "BoolOp": "boolean_operator", "Compare": "comparison_operator", "UnaryOp": "unary_operator", "Subscript": "subscript",
    "List": "list", "Dict": "dictionary", "Set": "set", "Tuple": "tuple", "Expr": "expression_statement", "arg": "identifier", "arguments": "parameters", "Assert": "assert_statement", "Delete": "delete_statement",
    "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Await": "await", "Yield": "yield", "JoinedStr": "string", "Starred": "list_splat", "keyword": "keyword_argument",
}
FIELDS = {"func": "function", "args": "arguments", "targets": "left", "target": "left", "value": "right", "test": "condition", "body": "body", "bases": "superclasses", "returns": "return_type", "orelse": "alternative"}


def python_nodes(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    at, raw, out = python_ast._Offsets(source), source.encode(), []

    def put(parent: int | None, field: str | None, kind: str, start: int, end: int) -> int:
        out.append((len(out), parent, field, kind, start, end, raw[start:end].decode()))
        return len(out) - 1

    def kind_of(x: ast.AST) -> str:
        if isinstance(x, ast.Constant):
            return "string" if isinstance(x.value, (str, bytes)) else "none" if x.value is None else str(x.value).lower() if isinstance(x.value, bool) else "integer" if isinstance(x.value, int) else "float"
        return KINDS.get(type(x).__name__, re.sub(r"(?<=[a-z])(?=[A-Z])", "_", type(x).__name__).lower())

    def walk(x: ast.AST, parent: int | None, field: str | None) -> None:
        if isinstance(x, ast.Module):
            me = put(parent, field, "module", 0, len(raw))
        elif getattr(x, "lineno", None) is None:
            me = None
        else:
            me = put(parent, field, kind_of(x), at(x.lineno, x.col_offset), at(x.end_lineno, x.end_col_offset))
        here = parent if me is None else me
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            word = re.compile(rb"\b" + x.name.encode() + rb"\b").search(raw, at(x.lineno, x.col_offset))
            if word:
                put(here, "name", "identifier", *word.span())
        if isinstance(x, ast.Attribute):
            end = at(x.end_lineno, x.end_col_offset)
            put(here, "attribute", "identifier", end - len(x.attr.encode()), end)
        for name, value in ast.iter_fields(x):
            label = "object" if isinstance(x, ast.Attribute) and name == "value" else None if isinstance(x, (ast.Expr, ast.Return)) else FIELDS.get(name)
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    walk(child, here, label)

    walk(tree, None, None)
    return out


def lexical_nodes(source: str, language: str) -> list[tuple]:
    raw = source.encode()
    out = [(0, None, None, "program", 0, len(raw), source)]
    stack = [(len(raw), 0)]
    declared = sorted(lexical.declarations(source, language), key=lambda d: (d["start_byte"], -d["end_byte"]))
    for d in declared:
        inner = [(o["start_byte"], o["end_byte"]) for o in declared if o is not d and d["start_byte"] <= o["start_byte"] and o["end_byte"] <= d["end_byte"]]
        while stack[-1][0] <= d["start_byte"] and len(stack) > 1:
            stack.pop()
        me = len(out)
        text = raw[d["start_byte"] : d["end_byte"]]
        out.append((me, stack[-1][1], None, d["node_kind"], d["start_byte"], d["end_byte"], text.decode()))
        stack.append((d["end_byte"], me))
        name = re.split(r"::|\.", d["semantic_path"])[-1].encode()
        named = -1
        if word := re.compile(rb"\b" + re.escape(name) + rb"\b").search(text):
            named = d["start_byte"] + word.start()
            out.append((len(out), me, "name", "identifier", d["start_byte"] + word.start(), d["start_byte"] + word.end(), name.decode()))
        head = text.find(b"{")
        for c in lexical._CALL.finditer(lexical._blanked(text.decode()), max(0, len(text[:head].decode()) if head >= 0 else 0)):
            spelled = re.sub(r"^new\s+", "", c.group(1))
            if re.split(r"\.|::|->", spelled)[0] in lexical._NOT_CALLS:
                continue
            start = d["start_byte"] + len(text.decode()[: c.start()].encode())
            end = d["start_byte"] + len(text.decode()[: c.end()].encode())
            if start == named or any(a <= start < e for a, e in inner):  # the declared name; the inner declaration has it
                continue
            call = len(out)
            out.append((call, me, None, "call_expression", start, end, raw[start:end].decode()))
            out.append((len(out), call, "function", "identifier", start, end, spelled))
    return out


def nodes(source: str, language: str) -> list[tuple]:
    return python_nodes(source) if language == "python" else lexical_nodes(source, language)
