"""Column expressions over paths and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that no scan enters.
SKIP_DIRS = [
    ".egg-info", ".eggs", ".git", ".hg", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".turbo", ".venv",
    "__pycache__", "build", "coverage", "dist", "node_modules", "out", "venv",
]
# Language by file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "rs": "rust", "md": "markdown"}


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def in_skipped_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))


def language(path: Column) -> Column:
    """Language by extension; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.nullif(extension(path), F.lit("")))


def is_test_file(path: Column) -> Column:
    """By name (test_*, *_test, *.test.*, *.spec.*) or by a folder named test, tests or __tests__."""
    name = basename(path)
    return name.rlike(r"^(?:test_.*|.*_test\.[a-z]+|.*\.(?:test|spec)\.[a-z]+|conftest\.py)$") | path.rlike(r"(?:^|/)(?:tests?|__tests__)/")


def module_name(path: Column) -> Column:
    """Dotted Python module of a path, without a leading src or lib and without __init__."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^(?:src/)?(?:lib/)?", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"(?:^|\.)__init__$", "")


def normalized_package(name: Column) -> Column:
    """PEP 503: runs of - _ . are one hyphen, lower case."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def lines(content: Column) -> Column:
    """Array of lines; line ends of any kind; no empty line after a final line end."""
    return F.split(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n\z", ""), "\n")
