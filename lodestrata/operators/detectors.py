"""Detectors: pure functions from relations of a corpus to findings, each a declarative plan.

All work on many repositories at once; a path, module or package is only looked up within its own repository.
``files`` is (repo_path, file_path, content) throughout, ``lines`` what ``sources.repository.numbered_lines`` gives and
``facts`` what ``operators.extract.facts`` gives. Findings have the columns of FINDING. The order of findings that the
reporting side needs comes from their place, not from the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import code

FINDING = ["repo_path", "detector", "category", "severity", "confidence", "title", "description", "file_path", "line_start", "line_end", "context_json"]


def finding(rows: DataFrame, detector: str, category: str, severity: Column | str, confidence: Column | float, title: Column, description: Column, path: str = "file_path", line: str | None = "line", end: str | None = None, context: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    first = F.col(line).cast("int") if line else F.lit(None).cast("int")
    return rows.select(
        "repo_path", F.lit(detector).alias("detector"), F.lit(category).alias("category"), lit(severity).alias("severity"),
        lit(confidence).cast("double").alias("confidence"), title.alias("title"), description.alias("description"), F.col(path).alias("file_path"),
        first.alias("line_start"), (F.col(end).cast("int") if end else first).alias("line_end"),
        (F.to_json(context) if context is not None else F.lit(None).cast("string")).alias("context_json"),
    )


def union(*found: DataFrame) -> DataFrame:
    """All findings of several detectors."""
    return reduce(DataFrame.unionByName, found)


# --- markers ------------------------------------------------------------------------------------------------------------

_TAG = r"(?i)\b(?:TODO|FIXME|HACK|XXX)\b(?!-)"
# Documentation formats, scanned for markers in HTML comments only.
DOCS = ["md", "rst", "adoc", "html", "htm"]


def markers(lines: DataFrame) -> DataFrame:
    """TODO, FIXME, HACK and XXX in comments: at most five characters after the nearest comment mark, outside strings.

    A line is cut before each marker; the piece before a marker decides whether it stands in a comment, the piece from it
    on gives its message. In documentation only HTML comments count.
    """
    ext = code.extension(F.col("file_path"))
    hits = lines.filter(F.col("text").rlike(_TAG))
    plain = hits.filter(~ext.isin(*[e for e in DOCS if e not in ("html", "htm")]))
    parts = plain.withColumn("_p", F.split("text", f"(?={_TAG})"))
    pieces = parts.select("repo_path", "file_path", "line", "text", F.posexplode(F.transform("_p", lambda p, i: F.struct(p.alias("own"), F.array_join(F.slice(F.col("_p"), 1, i), "").alias("before")))).alias("_n", "s"))
    pieces = pieces.filter(F.col("s.own").rlike("^" + _TAG))
    bare = F.regexp_replace("s.before", r"\\.", "")
    quoted = (F.regexp_count(bare, F.lit('"')) % 2 == 1) | (F.regexp_count(bare, F.lit("'")) % 2 == 1)
    near = F.col("s.before").rlike(r"(?:#|//|/\*|^\s*\*|--|<!--).{0,5}$")
    in_code = pieces.filter(near & ~quoted).select("repo_path", "file_path", "line", F.regexp_extract("s.own", r"^(\w+)", 1).alias("tag"), F.regexp_extract("s.own", r"^\w+\s*[:(]?\s*(.*?)\s*$", 1).alias("message"))
    comment = F.explode(F.regexp_extract_all("text", F.lit(r"(?i)<!--\s*\b((?:TODO|FIXME|HACK|XXX)\b[:\s]*.*?)\s*-->"), 1))
    in_docs = hits.filter(ext.isin(DOCS)).select("repo_path", "file_path", "line", comment.alias("m"))
    in_docs = in_docs.select("repo_path", "file_path", "line", F.regexp_extract("m", r"^(\w+)", 1).alias("tag"), F.regexp_extract("m", r"^\w+[:\s]*(.*)$", 1).alias("message"))
    rows = in_code.unionByName(in_docs).withColumns({"tag": F.upper("tag"), "message": F.when(F.trim("message") == "", "(no description)").otherwise(F.trim("message"))})
    severity = F.when(F.col("tag").isin("HACK", "XXX"), "high").when(F.col("tag") == "FIXME", "medium").otherwise("low")
    title = F.concat("tag", F.lit(": "), F.substring("message", 1, 80))
    place = F.concat("tag", F.lit(" comment in "), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "message")
    return finding(rows, "todo-scanner", "todo-fixme", severity, 0.9, title, place, context=F.struct("tag"))


# --- tool reports -------------------------------------------------------------------------------------------------------


def linted(messages: DataFrame, detector: str) -> DataFrame:
    """Findings of a linter's messages (see ``sources.repository``)."""
    title = F.concat("code", F.lit(": "), "message")
    return finding(messages, detector, "code-quality", F.col("severity"), 1.0, title, F.col("message"), line="line_start", end="line_end", context=F.struct(F.col("code").alias("rule")))


def audited(vulnerabilities: DataFrame) -> DataFrame:
    """Findings of known weaknesses of packages."""
    rows = vulnerabilities.withColumn("file_path", F.lit(None).cast("string"))
    title = F.concat("vuln_id", F.lit(": "), "package", F.lit("=="), "version")
    fix = F.when(F.coalesce("fix_versions", F.lit("")) != "", F.concat(F.lit(" Fixed in: "), "fix_versions")).otherwise("")
    return finding(rows, "dep-audit", "security", "high", 1.0, title, F.concat(F.coalesce("description", F.lit("")), fix), line=None, context=F.struct("vuln_id", "package"))


# --- paths that documents and configuration refer to ----------------------------------------------------------------------


def resolved(path: Column) -> Column:
    """A relative path without '.', '..' and empty parts; null if it leaves the repository."""
    state = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda s, p: F.when(s.isNull() | p.isin("", "."), s).when(p == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))).otherwise(F.concat(s, F.array(p))),
    )
    return F.array_join(state, "/")


def existing_paths(files: DataFrame) -> DataFrame:
    """(repo_path, target): all files and their folders."""
    parts = F.split("file_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("repo_path", F.explode(ups).alias("target")).distinct()


def path_tails(files: DataFrame) -> DataFrame:
    """(repo_path, target): every tail of every path, so that a suffix match is an equality."""
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    return files.select("repo_path", F.explode(tails).alias("target")).distinct()


def _missing(refs: DataFrame, candidates: Column, known: DataFrame) -> DataFrame:
    """References none of whose candidate paths is known. ``refs`` has a unique ``_ref``."""
    keyed = refs.select("_ref", "repo_path", F.explode(candidates).alias("target")).filter("target is not null")
    hit = keyed.join(known, ["repo_path", "target"], "left_semi").select("_ref").distinct()
    return refs.join(hit, "_ref", "left_anti")


def _numbered(rows: DataFrame) -> DataFrame:
    key = F.xxhash64(*rows.columns)
    return rows.withColumn("_ref", F.concat(F.hex(key), F.lit(":"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("repo_path", "file_path", "line", "target_text"))))


def unfenced(lines: DataFrame) -> DataFrame:
    """Markdown lines outside fenced blocks; the fence lines themselves are left out."""
    fence = F.col("text").rlike(r"^ {0,3}`{3,}")
    so_far = Window.partitionBy("repo_path", "file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_f", F.sum(fence.cast("int")).over(so_far)).filter(~fence & (F.col("_f") % 2 == 0)).drop("_f")


def _is_template(path: Column) -> Column:
    """Whether a path is a placeholder: two generic words as parts, or a variable in it."""
    generic = F.array(*map(F.lit, ["path", "to", "your", "example", "sample", "placeholder"]))
    return (F.size(F.array_intersect(F.split(F.lower(path), "[/\\\\]"), generic)) >= 2) | path.rlike(r"[{}<>$]|-N+-")


def stale_links(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Markdown links to paths that exist neither beside the document nor below the root."""
    md = unfenced(lines.filter(code.extension(F.col("file_path")).isin("md", "rst", "adoc")))
    link = F.explode(F.regexp_extract_all("text", F.lit(r"(\[[^\]]*\]\([^)]+\))"), 1))
    refs = md.select("repo_path", "file_path", "line", link.alias("_l")).distinct()
    refs = refs.withColumns({"label": F.regexp_extract("_l", r"^\[([^\]]*)\]", 1), "target_text": F.regexp_extract("_l", r"\]\(([^)]+)\)$", 1)}).drop("_l")
    refs = refs.filter(~F.col("target_text").rlike(r"^(?:https?://|mailto:|ftp://|#)") & ~F.col("target_text").rlike(r"\\[dDwWsS]|[^/]\*|\{\d+\}|\[\^|\(\?"))
    refs = _numbered(refs).withColumn("bare", F.substring_index("target_text", "#", 1)).filter((F.col("bare") != "") & ~_is_template(F.col("bare")))
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "[^/]*$", "")).otherwise("")
    rows = _missing(refs, F.array(resolved(F.concat(folder, "bare")), resolved(F.col("bare"))), existing_paths(files))
    title = F.concat(F.lit("Stale link: ["), "label", F.lit("]("), "target_text", F.lit(")"))
    text = F.concat(F.lit("Documentation links to `"), "target_text", F.lit("`, which exists neither beside it nor below the root."))
    return finding(rows, "docs-drift", "docs-drift", "medium", 0.95, title, text, context=F.struct(F.lit("stale-reference").alias("pattern"), F.col("target_text").alias("target"), F.coalesce(resolved(F.concat(folder, "bare")), "bare").alias("resolved")))


# First parts that make a bare path look like one of the repository.
ROOTS = ["src", "docs", "lib", "test", "tests", "e2e", "public", "ingestion", "branding"]


def stale_inline_paths(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Paths in code spans of Markdown that no file of the repository ends with."""
    md = unfenced(lines.filter(code.extension(F.col("file_path")).isin("md", "rst", "adoc")))
    span = F.explode(F.regexp_extract_all("text", F.lit(r"`([a-zA-Z0-9_./-]+(?:\.[a-zA-Z0-9]+)?)`"), 1))
    refs = md.select("repo_path", "file_path", "line", "text", span.alias("target_text")).distinct()
    t = F.col("target_text")
    at = F.position(F.concat(F.lit("`"), t, F.lit("`")), F.col("text"))
    before = F.lower(F.substring(F.col("text"), F.greatest(at - 30, F.lit(1)), F.least(at - 1, F.lit(30))))
    parts = F.split(t, "/")
    looks = t.rlike(r"\.[a-zA-Z0-9]{1,10}$") | F.get(parts, F.lit(0)).isin(*ROOTS, ".") | F.array_contains(parts, "..") | F.exists(parts, lambda p: p.contains("."))
    wrong = t.rlike(r"^(?:/|#|https?:)") | t.rlike(r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/") | t.rlike(r"^\d{1,4}/\d{1,4}(?:/\d{1,4})?$") | _is_template(t) | F.col("text").rlike(r"~~[^~]*`[^`]*`[^~]*~~") | before.rlike(r"e\.g\.|for example|such as|like $")
    refs = _numbered(refs.filter(t.contains("/") & looks & ~wrong).drop("text"))
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "[^/]*$", "")).otherwise("")
    known = existing_paths(files).unionByName(path_tails(files)).distinct()
    rows = _missing(refs, F.array(resolved(F.concat(folder, t)), resolved(t), t), known)
    text = F.concat(F.lit("Documentation refers to `"), t, F.lit("`, which no file of the repository matches."))
    return finding(rows, "docs-drift", "docs-drift", "low", 0.8, F.concat(F.lit("Stale path reference: "), t), text, context=F.struct(F.lit("stale-inline-path").alias("pattern"), t.alias("target")))


def stale_ci_paths(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Paths in GitHub workflows and Dockerfiles that do not exist; for Dockerfiles also not beside them."""
    flow = lines.filter(F.col("file_path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$"))
    step = F.regexp_replace(F.trim("text"), r"^-\s+", "")
    key = F.regexp_extract(step, r"^(uses|working-directory|path|file|entrypoint):", 1)
    value = F.trim(F.translate(F.regexp_extract(step, r"^[\w-]+:\s*(.*?)\s*$", 1), "'\"", ""))
    refs = flow.select("repo_path", "file_path", "line", key.alias("kind"), value.alias("target_text")).filter("kind <> '' and target_text <> ''")
    local = F.when(F.col("kind") == "uses", F.startswith("target_text", F.lit("./"))).otherwise(~F.col("target_text").rlike(r"^[$~/{]|[*?\[{}]"))
    refs = refs.filter(local).withColumn("kind", F.when(F.col("kind") == "uses", "local action").otherwise(F.col("kind")))
    docker = lines.filter(code.basename(F.col("file_path")).rlike(r"^Dockerfile(?:\..*)?$|\.Dockerfile$") & F.col("text").rlike(r"(?i)^\s*(?:COPY|ADD)\s") & ~F.col("text").rlike(r"(?i)--from="))
    source = F.regexp_extract("text", r"(?i)^\s*(?:COPY|ADD)\s+(?:--[a-z-]+=\S+\s+)*(\S+)", 1)
    copies = docker.select("repo_path", "file_path", "line", F.lit("COPY/ADD source").alias("kind"), source.alias("target_text"))
    copies = copies.filter(~F.col("target_text").rlike(r"(?i)^(?:https?://|ftp://|--)|[$*?\[{}]|^\.?/?$|^$"))
    refs = _numbered(refs.unionByName(copies))
    own = F.when((F.col("kind") == "COPY/ADD source") & F.col("file_path").contains("/"), resolved(F.concat(F.regexp_replace("file_path", "[^/]*$", ""), "target_text")))
    rows = _missing(refs, F.array(resolved(F.col("target_text")), own), existing_paths(files))
    title = F.concat(F.lit("Stale "), "kind", F.lit(" reference: "), "target_text")
    return finding(rows, "cicd-drift", "config-drift", "medium", 0.9, title, F.concat(F.lit("`"), "target_text", F.lit("` does not exist in the repository.")))


# --- configuration and dependencies ---------------------------------------------------------------------------------------

# Variables of systems and tools that nobody documents.
COMMON_VARIABLES = [
    "CI", "COMPOSE_PROJECT_NAME", "DOCKER_HOST", "GITHUB_ACTIONS", "GITHUB_REF", "GITHUB_REPOSITORY", "GITHUB_SHA", "GITHUB_TOKEN", "HOME", "LANG",
    "LC_ALL", "NODE_ENV", "NODE_OPTIONS", "NODE_PATH", "NPM_TOKEN", "PATH", "PWD", "PYTHONDONTWRITEBYTECODE", "PYTHONPATH", "PYTHONUNBUFFERED",
    "SHELL", "TEMP", "TERM", "TMP", "TMPDIR", "TZ", "USER", "VIRTUAL_ENV",
]
# Names of sample files, the first that lists anything counts.
ENV_SAMPLES = [".env.example", ".env.sample", ".env.template", "env.example", "env.sample"]


def env_drift(lines: DataFrame) -> DataFrame:
    """Variables that the sample file lists but no code reads, and the reverse, in repositories that have a sample."""
    rank = F.array_position(F.array(*map(F.lit, ENV_SAMPLES)), F.col("file_path"))
    listed = lines.filter(F.col("file_path").isin(ENV_SAMPLES)).select("repo_path", "file_path", rank.alias("_r"), F.regexp_extract(F.trim("text"), r"^([A-Z_][A-Z0-9_]*)(?:\s*=.*)?$", 1).alias("var")).filter("var <> ''")
    first = listed.groupBy("repo_path").agg(F.min("_r").alias("_r"), F.min_by("file_path", "_r").alias("sample"))
    listed = listed.join(first, ["repo_path", "_r"], "left_semi").select("repo_path", "var").distinct()
    ext = code.extension(F.col("file_path"))
    python = r"os\.(?:environ\[|environ\.get\(\s*|getenv\(\s*)['\"]([A-Z_][A-Z0-9_]*)['\"]"
    script = r"process\.env(?:\.|\[['\"])([A-Z_][A-Z0-9_]*)"
    pattern = F.when(ext == "py", python).otherwise(script)
    read = lines.filter(ext.isin("py", "js", "jsx", "ts", "tsx", "mjs", "cjs") & F.col("text").rlike(r"os\.environ|os\.getenv|process\.env"))
    read = read.select("repo_path", F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("var")).distinct()
    both = listed.withColumn("_l", F.lit(True)).join(read.withColumn("_u", F.lit(True)), ["repo_path", "var"], "full_outer").filter(~F.col("var").isin(COMMON_VARIABLES) & (F.col("_l").isNull() | F.col("_u").isNull()))
    rows = both.join(first.select("repo_path", "sample"), "repo_path")
    unused = F.col("_u").isNull()
    title = F.concat(F.when(unused, "Documented env var never used: ").otherwise("Undocumented env var: "), "var")
    return finding(rows, "stale-env", "config-drift", F.when(unused, "low").otherwise("medium"), F.when(unused, 0.8).otherwise(0.75), title, title, path="sample", line=None)


# Packages whose import has another name.
IMPORT_NAMES = {
    "attrs": "attr", "beautifulsoup4": "bs4", "google_protobuf": "google", "msgpack_python": "msgpack", "opencv_python": "cv2", "opencv_python_headless": "cv2",
    "pillow": "pil", "protobuf": "google", "pyjwt": "jwt", "python_dateutil": "dateutil", "python_dotenv": "dotenv", "python_jose": "jose",
    "python_multipart": "multipart", "pyyaml": "yaml", "ruamel_yaml": "ruamel", "scikit_learn": "sklearn",
}
# Packages that are run, not imported, by name or by beginning of the name.
TOOLS = [
    "bandit", "black", "build", "check_manifest", "coverage", "covdefaults", "debugpy", "flake8", "flit", "flit_core", "hatch", "hatchling", "ipdb",
    "ipython", "isort", "maturin", "mkautodoc", "mkdocs", "mkdocs_material", "mypy", "mypy_extensions", "myst_parser", "nox", "pip", "pip_audit",
    "poetry", "poetry_core", "pre_commit", "pylint", "pyright", "pytest", "ruff", "safety", "setuptools", "setuptools_scm", "sphinx",
    "sphinx_rtd_theme", "tox", "twine", "wheel",
]
TOOL_PREFIXES = ("flake8_", "mypy_", "pylint_", "pytest_", "trio_", "types_")


def declared_dependencies(lines: DataFrame) -> DataFrame:
    """(repo_path, file_path, line, package): of requirements files and of the dependency lists of pyproject.toml."""
    req = lines.filter(code.basename(F.col("file_path")).rlike(r"^requirements[\w.-]*\.txt$") & ~F.col("text").rlike(r"^\s*(?:#|-|$)"))
    a = req.select("repo_path", "file_path", "line", F.regexp_extract("text", r"^\s*([A-Za-z0-9][\w.-]*)", 1).alias("package"))
    toml = lines.filter(code.basename(F.col("file_path")) == "pyproject.toml")
    order = Window.partitionBy("repo_path", "file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    toml = toml.withColumn("_s", F.last(F.when(F.col("text").rlike(r"^\s*\["), F.regexp_extract("text", r"^\s*\[+([^\]]*)\]", 1)), ignorenulls=True).over(order))
    head = F.regexp_extract("text", r"^([\w-]+)\s*=", 1)
    toml = toml.withColumn("_k", F.last(F.when(head != "", head), ignorenulls=True).over(order))
    inside = ((F.col("_s") == "project") & (F.col("_k") == "dependencies")) | (F.col("_s") == "project.optional-dependencies")
    b = toml.filter(inside).select("repo_path", "file_path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[\"']([A-Za-z0-9][\w.-]*)[^\"']*[\"']"), 1)).alias("package"))
    poetry = F.col("_s").rlike(r"^tool\.poetry(?:\.group\.[^.]+)?\.dependencies$") & (head != "") & (head != "python")
    c = toml.filter(poetry).select("repo_path", "file_path", "line", head.alias("package"))
    return union(a, b, c).filter("package <> ''")


def unused_dependencies(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """Declared Python packages that no file of the repository imports under any expected name."""
    plain = F.regexp_replace(F.lower("package"), "[-.]", "_")
    names = F.create_map(*(F.lit(x) for kv in IMPORT_NAMES.items() for x in kv))
    first = Window.partitionBy("repo_path", "_n").orderBy("file_path", "line")
    rows = declared.withColumn("_n", plain).withColumn("_o", F.row_number().over(first)).filter("_o = 1")
    rows = rows.filter(~F.col("_n").isin(TOOLS) & ~reduce(Column.__or__, (F.startswith("_n", F.lit(p)) for p in TOOL_PREFIXES)))
    wanted = rows.select("repo_path", "_n", F.explode(F.array_distinct(F.array("_n", F.coalesce(F.element_at(names, F.col("_n")), "_n")))).alias("module"))
    used = imports.filter("level = 0 and module <> ''").select("repo_path", F.lower(F.substring_index("module", ".", 1)).alias("module")).distinct()
    met = wanted.join(used, ["repo_path", "module"], "left_semi").select("repo_path", "_n").distinct()
    left = rows.join(met, ["repo_path", "_n"], "left_anti")
    title = F.concat(F.lit("Unused dependency: "), "package")
    return finding(left, "unused-deps", "dependency", "low", 0.8, title, F.concat(title, F.lit(" is declared, but nothing imports it.")), line=None)


# --- code -----------------------------------------------------------------------------------------------------------------


def complex_functions(facts: DataFrame, complexity: int = 10, lines: int = 50) -> DataFrame:
    """Python functions over a limit of cyclomatic complexity or body lines; in tests they matter less."""
    rows = facts.filter("kind in ('function', 'method')").filter((F.col("complexity") > complexity) | (F.col("body_lines") > lines))
    cc, n = F.col("complexity"), F.col("body_lines")
    issues = F.array_compact(F.array(
        F.when(cc > complexity, F.concat(F.lit("cyclomatic complexity "), cc.cast("string"), F.lit(f" (threshold: {complexity})"))),
        F.when(n > lines, F.concat(n.cast("string"), F.lit(f" lines (threshold: {lines})"))),
    ))
    test = F.startswith("file_path", F.lit("test")) | F.col("file_path").contains("/test")
    severity = F.when(test, "low").when((cc > 2 * complexity) | (n > 3 * lines), "high").when((cc > 1.5 * complexity) | (n > 2 * lines), "medium").otherwise("low")
    title = F.concat(F.lit("Complex function: "), "name", F.lit(" ("), F.array_join(issues, ", "), F.lit(")"))
    return finding(rows, "complexity", "code-quality", severity, F.when(test, 0.6).otherwise(0.95), title, F.concat(F.lit("`"), "name", F.lit("` has "), F.array_join(issues, " and "), F.lit(".")), end="end_line")


# Top-level names that frameworks use without an import.
ENTRY_NAMES = ["main", "app", "application", "setup", "configure", "conftest"]


def dead_symbols(facts: DataFrame) -> DataFrame:
    """Public top-level Python symbols that nothing in the repository imports or refers to, nor their module or package.

    Three anti-joins, on the name, the module and, exploded, every package above the module.
    """
    listed = facts.filter("kind = 'public'").select("repo_path", "file_path", "name")
    lists = listed.filter("name = ''").select("repo_path", "file_path", F.lit(True).alias("_lists"))
    own = facts.filter("kind in ('function', 'class', 'constant') and parent = '' and not used")
    own = own.filter(~F.startswith("name", F.lit("_")) & ~F.col("name").isin(ENTRY_NAMES) & ~F.col("name").rlike("^(?:pytest_|build_|get_requires_for_|prepare_metadata_)"))
    own = own.filter(~code.is_test_file(F.col("file_path")) & ~code.basename(F.col("file_path")).isin("conftest.py", "setup.py", "__init__.py"))
    own = own.join(lists, ["repo_path", "file_path"], "left").join(listed.withColumn("_in", F.lit(True)), ["repo_path", "file_path", "name"], "left").filter("_lists is null or _in")
    bound = F.when(F.col("kind") == "import", F.col("parent")).otherwise(F.coalesce("doc", "name"))  # the name in the importing module
    names = facts.filter("kind in ('import', 'from')").select("repo_path", bound.alias("name")).distinct()
    rows = own.join(names, ["repo_path", "name"], "left_anti").withColumn("_m", F.split(code.module_name(F.col("file_path")), r"\."))
    modules = facts.filter("kind = 'import'").select("repo_path", F.col("name").alias("_p")).distinct()
    keyed = rows.select("repo_path", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size("_m")), lambda n: F.array_join(F.slice(F.col("_m"), F.lit(1), n), "."))).alias("_p")).distinct()
    met = keyed.join(modules, ["repo_path", "_p"], "left_semi").select("repo_path", "file_path").distinct()
    left = rows.join(met, ["repo_path", "file_path"], "left_anti")
    title = F.concat(F.lit("Unused "), "kind", F.lit(": "), "name")
    return finding(left, "dead-code", "code-quality", "low", 0.7, title, F.concat(title, F.lit(" is never imported.")), end="end_line")


def import_edges(facts: DataFrame) -> DataFrame:
    """(repo_path, file_path, line, source, target): imports between modules; relative ones are resolved."""
    source = code.module_name(F.col("file_path"))
    parts = F.split(source, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    module = F.when(F.col("kind") == "import", F.col("name")).otherwise(F.col("parent"))
    target = F.when(F.col("level") == 0, module).when(F.col("level") <= F.size(parts), F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit(""))))
    return facts.filter("kind in ('import', 'from')").select("repo_path", "file_path", "line", source.alias("source"), target.alias("target")).filter("source <> '' and target <> ''").distinct()


def layer_violations(edges: DataFrame, layers: list[str], shared: list[str] = (), forbidden: list[tuple[str, str]] = ()) -> DataFrame:
    """Imports from a lower into a higher layer (``layers`` from high to low), and forbidden ones. The rules are few and literal.

    A module belongs to the longest declared prefix of it; shared targets are exempt from layers, not from prohibitions.
    """
    within = lambda m, p: (F.col(m) == p) | F.startswith(m, F.lit(f"{p}."))
    out = []
    for a, b in forbidden:
        title = F.concat(F.lit("Forbidden import: "), "source", F.lit(" -> "), "target")
        out.append(finding(edges.filter(within("source", a) & within("target", b)), "architecture-drift", "architecture", "high", 0.95, title, F.concat(title, F.lit(f" ({a} -> {b})."))))
    if layers:
        longest = sorted(range(len(layers)), key=lambda i: -len(layers[i]))
        rank = lambda m: F.coalesce(*(F.when(within(m, layers[i]), F.lit(i)) for i in longest))
        rows = edges.withColumns({"_s": rank("source"), "_t": rank("target")}).filter("_s > _t")
        for s in shared:
            rows = rows.filter(~within("target", s))
        title = F.concat(F.lit("Layer violation: "), "source", F.lit(" -> "), "target")
        out.append(finding(rows, "architecture-drift", "architecture", "medium", 0.9, title, F.concat(title, F.lit(": a lower layer imports from a higher one."))))
    return union(*out) if out else finding(edges.limit(0), "architecture-drift", "architecture", "low", 0.0, F.lit(""), F.lit(""))


# --- history ----------------------------------------------------------------------------------------------------------------

# Words in commit subjects, by kind of change; the first kind that matches counts.
CHANGES = {
    "fix": r"(?i)\b(?:fix|bug|patch|hotfix|revert|regression|broke|crash)\b",
    "refactor": r"(?i)\b(?:refactor|rename|restructure|reorganize|cleanup|clean[- ]?up|simplif|extract)\b",
    "feature": r"(?i)\b(?:feat|feature|implement|introduce|support|enable)\b",
}


def churn(commits: DataFrame) -> DataFrame:
    """(repo_path, file_path, commits, authors, fix, refactor, feature, other) of commit rows (author, subject, file_path)."""
    kind = F.when(F.col("subject").rlike(CHANGES["fix"]), "fix").when(F.col("subject").rlike(CHANGES["refactor"]), "refactor").when(F.col("subject").rlike(CHANGES["feature"]), "feature").otherwise("other")
    rows = commits.filter(~code.in_skipped_dir(F.col("file_path"))).withColumn("_k", kind).groupBy("repo_path", "file_path")
    return rows.agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"), *(F.count_if(F.col("_k") == k).alias(k) for k in (*CHANGES, "other")))


def hotspots(churned: DataFrame, least: int = 10, deviations: float = 2.0) -> DataFrame:
    """Files changed at least ``least`` times and ``deviations`` above their repository's mean (population deviation >= 1)."""
    stats = churned.groupBy("repo_path").agg(F.avg("commits").alias("_m"), F.stddev_pop("commits").alias("_d"), F.count("*").alias("_n"))
    rows = churned.join(stats, "repo_path").filter("_n >= 2 and _d >= 1").filter(F.col("commits") >= F.greatest(F.lit(float(least)), F.col("_m") + deviations * F.col("_d")))
    doc = code.extension(F.col("file_path")).isin("md", "rst", "txt", "adoc", "asciidoc")
    busy = (F.col("commits") >= 30) | ((F.col("commits") >= 15) & (F.col("fix") / F.col("commits") > 0.5))
    base = F.least(0.5 + F.col("commits") / 100, F.lit(0.85))
    base = F.when((F.col("fix") > F.col("feature")) & (F.col("fix") >= 3), F.least(base + 0.1, F.lit(0.9))).otherwise(base)
    confidence = F.when(doc, F.least(base, F.lit(0.3))).otherwise(base)
    top = F.greatest("fix", "refactor", "feature", "other")
    kind = F.when(F.round(100 * top / F.col("commits")) <= 40, "mixed").when(F.col("fix") == top, "fix").when(F.col("refactor") == top, "refactor").when(F.col("feature") == top, "feature").otherwise("other")
    title = F.concat(F.lit("Git hotspot: "), "file_path", F.lit(" ("), F.col("commits").cast("string"), F.lit(" commits)"))
    text = F.concat(title, F.lit("; dominant kind of change: "), kind, F.lit("; authors: "), F.col("authors").cast("string"))
    return finding(rows, "git-hotspots", "git-health", F.when(busy & ~doc, "medium").otherwise("low"), confidence, title, text, line=None, context=F.struct("commits", "authors", "fix", "refactor", "feature", "other"))


# --- pairs for a judge ------------------------------------------------------------------------------------------------------


def sections(lines: DataFrame) -> DataFrame:
    """(repo_path, file_path, title, level, line_start, line_end, body): Markdown sections from heading to heading."""
    by_file = Window.partitionBy("repo_path", "file_path").orderBy("line")
    heading = F.col("text").rlike(r"^#{1,6}\s+\S")
    rows = lines.withColumn("_s", F.sum(heading.cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, 0))).filter("_s > 0")
    parts = F.sort_array(F.collect_list(F.struct("line", "text")))
    one = rows.groupBy("repo_path", "file_path", "_s").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), parts.alias("_p"))
    head = F.get("_p", F.lit(0))["text"]
    body = F.array_join(F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda p: p["text"]), "\n")
    return one.select("repo_path", "file_path", F.trim(F.regexp_replace(head, r"^#+\s+|\s*#*\s*$", "")).alias("title"), F.length(F.regexp_extract(head, r"^(#+)", 1)).alias("level"), "line_start", "line_end", body.alias("body"))


def section_code_pairs(sections_: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_path, doc_path, title, code_path): sections with the files whose paths they name in code spans or links."""
    named = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[`(]((?:[\w.-]+/)*[\w-]+\.(?:py|js|ts|tsx|jsx|go|rs))[`)]"), 1)))
    refs = sections_.select("repo_path", F.col("file_path").alias("doc_path"), "title", "line_start", named.alias("target"))
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    known = files.select("repo_path", F.col("file_path").alias("code_path"), F.explode(tails).alias("target"))
    return refs.join(known, ["repo_path", "target"]).select("repo_path", "doc_path", "title", "line_start", "code_path").distinct()


def test_implementation_pairs(facts: DataFrame) -> DataFrame:
    """(repo_path, test_path, test_name, file_path, name): tests with the function they name, exactly or as longest beginning.

    The test's file must name the implementation's file (test_x.py or x_test.py for x.py). A test name is cut at every
    underscore, so that the longest beginning is found by equality.
    """
    f = facts.filter("kind in ('function', 'method')")
    base = code.basename(F.col("file_path"))
    tests = f.filter(base.rlike(r"^test_.*\.py$|_test\.py$") & F.startswith("name", F.lit("test_")))
    parts = F.split(F.substring("name", F.lit(6), F.lit(1000)), "_")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    tests = tests.select("repo_path", F.col("file_path").alias("test_path"), F.col("name").alias("test_name"), F.regexp_replace(base, r"^test_|_test(?=\.py$)", "").alias("_b"), F.explode(cuts).alias("name"))
    own = f.filter(~code.is_test_file(F.col("file_path"))).select("repo_path", "file_path", "name", base.alias("_b")).distinct()
    best = Window.partitionBy("repo_path", "test_path", "test_name").orderBy(F.desc(F.length("name")), "file_path")
    return tests.join(own, ["repo_path", "_b", "name"]).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("repo_path", "test_path", "test_name", "file_path", "name")


def replayed(prompts: DataFrame, recordings: DataFrame, default: str = "{}") -> DataFrame:
    """Prompts (id, prompt) with the recorded response of the same prompt (prompt_hash, response), else a default."""
    keyed = prompts.withColumn("prompt_hash", F.substring(F.sha2("prompt", 256), 1, 16))
    return keyed.join(recordings.select("prompt_hash", "response").dropDuplicates(["prompt_hash"]), "prompt_hash", "left").select("id", "prompt_hash", F.coalesce("response", F.lit(default)).alias("response"), F.col("response").isNotNull().alias("matched"))


def documented(facts: DataFrame, least: int = 30) -> DataFrame:
    """(repo_path, file_path, name, line, end_line, doc): functions, methods and classes with a docstring of ``least`` characters."""
    rows = facts.filter(F.col("kind").isin("function", "method", "class") & (F.length("doc") >= least))
    return rows.select("repo_path", "file_path", "name", "line", "end_line", "doc")


def intent_artifacts(facts: DataFrame, sections_: DataFrame, least: int = 3, per_file: int = 10) -> DataFrame:
    """(repo_path, file_path, name, line, end_line, doc, tests, sections, artifacts): symbols with at least ``least`` kinds of
    statement about them: code, docstring, tests that name them, document sections that quote them.

    At most three tests and two sections of a symbol come along, and ``per_file`` symbols of a file: budgets of the judge
    that reads them, ordered by name and line.
    """
    own = facts.filter(F.col("kind").isin("function", "method") & ~code.is_test_file(F.col("file_path")) & (F.col("end_line") - F.col("line") >= 3))
    own = own.select("repo_path", "file_path", "name", "line", "end_line", F.nullif(F.trim("doc"), F.lit("")).alias("doc"))
    tests = test_implementation_pairs(facts)
    by_test = Window.partitionBy("repo_path", "file_path", "name").orderBy("test_path", "test_name")
    tests = tests.withColumn("_n", F.row_number().over(by_test)).filter("_n <= 3").groupBy("repo_path", "file_path", "name").agg(F.sort_array(F.collect_list("test_name")).alias("tests"))
    quoted = sections_.select("repo_path", F.col("file_path").alias("_d"), "title", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"`([A-Za-z_]\w*)(?:\(\))?`"), 1))).alias("name"))
    by_name = Window.partitionBy("repo_path", "name").orderBy("_d", "title")
    quoted = quoted.withColumn("_n", F.row_number().over(by_name)).filter("_n <= 2").groupBy("repo_path", "name").agg(F.sort_array(F.collect_list("title")).alias("sections"))
    rows = own.join(tests, ["repo_path", "file_path", "name"], "left").join(quoted, ["repo_path", "name"], "left")
    count = F.lit(1) + F.col("doc").isNotNull().cast("int") + F.col("tests").isNotNull().cast("int") + F.col("sections").isNotNull().cast("int")
    rows = rows.withColumn("artifacts", count).filter(F.col("artifacts") >= least)
    first = Window.partitionBy("repo_path", "file_path").orderBy("line")
    return rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_file).drop("_n")
