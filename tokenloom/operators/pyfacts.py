"""Per-file Python facts (the row helper behind U1/U1b).

Runs inside Arrow-batched pandas UDFs on executors; one ``ast`` parse per
file.  Counting rules follow the grammar-node view of a Python file:
if/elif, for, while, except handlers, conditional expressions and boolean
operators add to complexity (``a and b and c`` adds two); comprehension
clauses and match cases do not.  Imports keep ``a.b`` of ``import a.b`` and
of ``from a.b import c``; relative and ``__future__`` imports are dropped.
"""
from __future__ import annotations

import ast
import re

_DEF_RE = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", re.M)
_CLASS_RE = re.compile(r"^[ \t]*class[ \t]+([A-Za-z_]\w*)", re.M)
_IMPORT_RE = re.compile(r"^[ \t]*import[ \t]+([^\n#;]+)", re.M)
_FROM_RE = re.compile(r"^[ \t]*from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b", re.M)
_BRANCH_RE = re.compile(r"\b(?:if|elif|for|while|except|and|or)\b")
_TYPED_RE = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(.*\)[ \t]*->", re.M)

_DEFS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))
_BRANCHES = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp))
# Nodes and values that hold nothing counted here; fields that hold only such.
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, type(None), str, int, bool))
_PLAIN = frozenset(("id", "ctx", "op", "ops", "name", "names", "attr", "arg", "level", "module", "kind", "type_comment", "conversion"))
_FIELDS: dict[type, tuple[str, ...]] = {}


def _child_fields(kind: type) -> tuple[str, ...]:
    """Fields of a node to walk, last one first; decorators come first in the source."""
    fields = [f for f in kind._fields if f not in _PLAIN]
    fields.sort(key=lambda f: f != "decorator_list")
    return tuple(reversed(fields))


def python_facts(source: str) -> tuple[list[str], list[str], list[str], int, int, bool]:
    """(functions, classes, imports, complexity, typed_functions, has_syntax_error)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _fallback(source)
    functions: list[str] = []
    classes: list[str] = []
    imports: list[str] = []
    cx = typed = 0
    stack: list[ast.AST] = [tree]
    while stack:
        node = stack.pop()
        kind = type(node)
        if kind in _DEFS:
            functions.append(node.name)
            if node.returns is not None:
                typed += 1
        elif kind is ast.ClassDef:
            classes.append(node.name)
        elif kind is ast.Import:
            imports.extend(a.name for a in node.names)
        elif kind is ast.ImportFrom:
            if node.level == 0 and node.module and node.module != "__future__":
                imports.append(node.module)
        elif kind in _BRANCHES:
            cx += 1
        elif kind is ast.BoolOp:
            cx += len(node.values) - 1
        fields = _FIELDS.get(kind)
        if fields is None:
            fields = _FIELDS[kind] = _child_fields(kind)
        for name in fields:
            child = getattr(node, name, None)
            if type(child) is list:
                stack.extend([c for c in reversed(child) if type(c) not in _LEAVES])
            elif type(child) not in _LEAVES:
                stack.append(child)
    return functions, classes, imports, cx, typed, False


def _fallback(source: str):
    """Tolerant line-regex facts for files the parser rejects."""
    functions = _DEF_RE.findall(source)
    classes = _CLASS_RE.findall(source)
    imports: list[str] = []
    for m in re.finditer(rf"{_IMPORT_RE.pattern}|{_FROM_RE.pattern}", source, re.M):
        if m.group(1) is not None:
            for part in m.group(1).split(","):
                name = part.strip().split(" as ")[0].strip().rstrip("\\").strip()
                if name and not name.startswith("("):
                    imports.append(name)
        elif m.group(2) and m.group(2) != "__future__":
            imports.append(m.group(2))
    cx = len(_BRANCH_RE.findall(source))
    typed = len(_TYPED_RE.findall(source))
    return functions, classes, imports, cx, typed, True
