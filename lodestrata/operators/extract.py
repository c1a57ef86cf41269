"""Table functions over Python source: symbols, functions with their measures, imports. One parse of a file gives all.

Files that do not parse give no rows. Batches go to Python as Arrow; nothing is evaluated or imported.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTS = "repo_path string, file_path string, kind string, name string, parent string, line int, end_line int, complexity int, body_lines int, doc string, level int, used boolean"


def _decisions(node: ast.AST) -> int:
    """1 + branches, loops, handlers and assertions, and each further operand of and/or; nested functions count too."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.If | ast.IfExp | ast.For | ast.While | ast.ExceptHandler | ast.Assert):
            n += 1
    return n


def _facts(tree: ast.Module) -> Iterator[tuple]:
    """(kind, name, parent, line, end_line, complexity, body_lines, doc, level, used) of one module."""
    names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    public: set[str] | None = None
    for s in tree.body:
        if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) and isinstance(s.value, ast.List | ast.Tuple):
            public = {e.value for e in s.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}

    def walk(node: ast.AST, parent: str) -> Iterator[tuple]:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if isinstance(node, ast.ClassDef) else "function"
                end = c.end_lineno or c.lineno
                yield kind, c.name, parent, c.lineno, end, _decisions(c), end - c.body[0].lineno + 1, ast.get_docstring(c), 0, c.name in names
                yield from walk(c, c.name)
            elif isinstance(c, ast.ClassDef):
                yield "class", c.name, parent, c.lineno, c.end_lineno, None, None, ast.get_docstring(c), 0, c.name in names
                yield from walk(c, c.name)
            elif isinstance(c, ast.Import):
                for a in c.names:
                    yield "import", a.name, a.asname or a.name, c.lineno, c.lineno, None, None, None, 0, True
            elif isinstance(c, ast.ImportFrom):
                for a in c.names:
                    yield "from", a.name, c.module or "", c.lineno, c.lineno, None, None, a.asname, c.level, True
            else:
                yield from walk(c, parent)

    for fact in walk(tree, ""):
        yield fact
    for s in tree.body:
        for t in s.targets if isinstance(s, ast.Assign) else []:
            if isinstance(t, ast.Name) and t.id.isupper():
                yield "constant", t.id, "", s.lineno, s.end_lineno, None, None, None, 0, t.id in names
    for name in sorted(public or ()):
        yield "public", name, "", 1, 1, None, None, None, 0, True
    if public is not None:
        yield "public", "", "", 1, 1, None, None, None, 0, True  # marks that the module lists its names


def facts(files: DataFrame) -> DataFrame:
    """FACTS rows of every Python file of ``files`` (repo_path, file_path, content)."""

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in FACTS.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        for batch in it:
            out = []
            for repo, path, text in zip(*(batch[c].to_pylist() for c in ("repo_path", "file_path", "content"))):
                try:
                    tree = ast.parse(text.lstrip("﻿"))
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                out += [(repo, path, *f) for f in _facts(tree)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    rows = files.filter(F.col("content").isNotNull() & F.lower("file_path").endswith(".py")).select("repo_path", "file_path", "content")
    return rows.mapInArrow(parsed, FACTS)


def functions(rows: DataFrame) -> DataFrame:
    return rows.filter("kind in ('function', 'method')").select("repo_path", "file_path", "kind", "name", F.col("parent").alias("class_or_function"), "line", "end_line", "complexity", "body_lines", "doc")


def classes(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'class'").select("repo_path", "file_path", "name", "line", "end_line", "doc")


def imports(rows: DataFrame) -> DataFrame:
    """(repo_path, file_path, line, module, name, level): name is null for plain imports."""
    plain = F.col("kind") == "import"
    return rows.filter("kind in ('import', 'from')").select(
        "repo_path", "file_path", "line", F.when(plain, F.col("name")).otherwise(F.col("parent")).alias("module"), F.when(~plain, F.col("name")).alias("name"), "level"
    )
