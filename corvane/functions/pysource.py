"""Symbols of Python source texts, by the standard ``ast`` module, in Arrow batches."""

from __future__ import annotations

import ast
import gc
import inspect
import re
import warnings
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa

_LINE = re.compile(r"\r\n|\r|\n")
_STEM = re.compile(r"([^/]*?)(\.py)?$")

#: One row a module, class and function. ``own_docstring`` is what Python itself takes as
#: docstring, dedented; null if there is none. ``bases`` are a class's base expressions,
#: ``base_origins`` their full dotted names where the file imports them, else null.
SYMBOL_SCHEMA = (
    "file_id bigint, symbol_type string, symbol_name string, name string, parent_class string, line_number int,"
    " code string, own_docstring string, bases array<string>, base_origins array<string>, walk_order int"
)
_COLUMNS = ["file_id", "symbol_type", "symbol_name", "name", "parent_class", "line_number", "code", "own_docstring", "bases", "base_origins", "walk_order"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32()]
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(source: str | None) -> ast.Module | None:
    """The syntax tree, or None where the text isn't Python 3 (null included)."""
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def docstring(node: ast.AST) -> str | None:
    text = ast.get_docstring(node, clean=False)
    return None if text is None else inspect.cleandoc(text)


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """The module and all statements, breadth first; expressions hold no definitions."""
    queue: deque[ast.AST] = deque([tree])
    while queue:
        node = queue.popleft()
        yield node
        for block in ("body", "handlers", "cases", "orelse", "finalbody"):
            queue.extend(getattr(node, block, ()))


def module_name(path: str) -> str:
    """The dotted name of the module in a file."""
    parts = path.removesuffix(".py").strip("/").split("/")
    return ".".join(p for p in (parts[:-1] if parts[-1] == "__init__" else parts) if p)


def imported_names(nodes: list[ast.AST], path: str) -> dict[str, str]:
    """Local names and the full dotted names that imports anywhere in the file give them."""
    package = module_name(path).split(".")
    if not path.endswith("__init__.py"):
        package = package[:-1]
    names = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            above = package[: len(package) - node.level + 1] if node.level else []
            for a in node.names:
                if a.name != "*":
                    names[a.asname or a.name] = ".".join([*above, *((node.module or "").split(".") if node.module else []), a.name])
    return names


def symbols(source: str | None, path: str = "module.py") -> list[tuple]:
    """(type, qualified name, name, class, line, code, docstring, bases, their origins, order)
    of every module, class and function, breadth first. A function that stands directly in
    a class body is a method and named ``Class.name``, by its innermost class only."""
    tree = parse(source)
    if tree is None:
        return []
    stem = _STEM.search(path)[1] or "module"
    lines = _LINE.split(source)
    nodes = list(statements(tree))
    imports = imported_names(nodes, path)
    owner: dict[ast.AST, str] = {}
    found = []

    def origin(base: str) -> str | None:
        first, dot, rest = base.split("[")[0].partition(".")
        return imports[first] + dot + rest if first in imports else None

    for order, node in enumerate(nodes):
        if isinstance(node, ast.Module):
            found.append(("module", stem, stem, None, 1, None, docstring(node), None, None, order))
        elif isinstance(node, ast.ClassDef):
            for child in node.body:
                if isinstance(child, _FUNCTION):
                    owner[child] = node.name
            bases = [ast.unparse(b) for b in node.bases]
            found.append(("class", node.name, node.name, None, node.lineno, None, docstring(node), bases, [origin(b) for b in bases], order))
        elif isinstance(node, _FUNCTION):
            start = min([node.lineno, *(x.lineno for x in node.decorator_list)])
            code = "\n".join(lines[start - 1 : node.end_lineno])
            parent = owner.get(node)
            name = f"{parent}.{node.name}" if parent else node.name
            found.append(("method" if parent else "function", name, node.name, parent, node.lineno, code, docstring(node), None, None, order))
    return found


def symbol_batches(keep: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (file_id, path, source) and ``keep`` more columns of the file,
    which come back before those of ``SYMBOL_SCHEMA``."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            gc.disable()  # trees hold no cycles, and there are a great many nodes
            try:
                for k, (i, path, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    found = symbols(text, path or "module.py")
                    rows.extend((i, *s) for s in found)
                    owner.extend([k] * len(found))
            finally:
                gc.enable()
            columns = zip(*rows) if rows else [[] for _ in _TYPES]
            kept = [batch.column(3 + c).take(pa.array(owner, pa.int64())) for c in range(keep)]
            yield pa.record_batch([*kept, *(pa.array(_storable(c), t) for c, t in zip(columns, _TYPES))], names=[*batch.schema.names[3 : 3 + keep], *_COLUMNS])

    return batches_of


def _storable(column) -> list:
    """Lone surrogates, which escapes in a docstring can make, don't fit into UTF-8."""
    return [x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in column]
