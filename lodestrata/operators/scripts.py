"""Detectors over JavaScript and TypeScript modules, package manifests and install instructions; regular expressions in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import code
from lodestrata.operators.detectors import finding

EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]
# Exports that frameworks and test runners use by name.
ALWAYS_USED = [
    "App", "DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT", "action", "afterAll", "afterEach", "beforeAll", "beforeEach", "default",
    "generateMetadata", "generateStaticParams", "getServerSideProps", "getStaticPaths", "getStaticProps", "handler", "links", "loader", "main",
    "meta", "middleware", "setup", "teardown",
]
# Packages that are run or configured, not imported.
TOOLS = [
    "@changesets/changelog-github", "@changesets/cli", "@commitlint/cli", "@commitlint/config-conventional", "@manypkg/cli", "@types/hast",
    "@types/jest", "@types/node", "@types/react", "@types/react-dom", "autoprefixer", "biome", "concurrently", "cross-env", "cypress", "dotenv-cli",
    "esbuild", "eslint", "husky", "jest", "lerna", "lint-staged", "mocha", "nodemon", "parcel", "playwright", "postcss", "prettier", "pretty-quick",
    "puppeteer", "rollup", "start-server-and-test", "tailwindcss", "ts-node", "tsconfig-paths", "tsx", "turbo", "typescript", "vite", "vitest",
    "webpack",
]
TOOL_PREFIXES = ("@ianvs/prettier-plugin-", "@typescript-eslint/", "eslint-config-", "eslint-plugin-", "prettier-plugin-")


def _scripts(files: DataFrame) -> DataFrame:
    return files.filter(F.col("content").isNotNull() & code.extension(F.col("file_path")).isin(EXTENSIONS))


def _names(listed: Column, imported: bool) -> Column:
    """The names of a brace list: of ``a as b`` the first where imported, the second where exported."""
    one = r"^\s*(?:type\s+)?([\w$]+)" if imported else r"([\w$]+)\s*$"
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_extract(x, one, 1)), lambda x: x != "")


def exports(files: DataFrame) -> DataFrame:
    """(repo_path, file_path, name, line, uses): exported names with their line (null in lists) and occurrences in the file."""
    rows = _scripts(files)
    lines = rows.select("repo_path", "file_path", "content", F.posexplode(code.lines(F.col("content"))).alias("_n", "_t"))
    single = r"^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|type|interface|enum)\s+([\w$]+)"
    a = lines.select("repo_path", "file_path", "content", F.regexp_extract("_t", single, 1).alias("name"), (F.col("_n") + 1).alias("line")).filter("name <> ''")
    groups = F.regexp_extract_all("content", F.lit(r"(?m)^export\s*(?:type\s*)?\{([^}]+)\}"), 1)
    b = rows.select("repo_path", "file_path", "content", F.explode(F.flatten(F.transform(groups, lambda g: _names(g, imported=False)))).alias("name"), F.lit(None).cast("int").alias("line"))
    both = a.unionByName(b)
    quoted = F.concat(F.lit(r"(?<![\w$])"), F.regexp_replace("name", r"\$", r"\\\$"), F.lit(r"(?![\w$])"))
    return both.select("repo_path", "file_path", "name", "line", F.regexp_count("content", quoted).alias("uses"))


def imports(files: DataFrame) -> DataFrame:
    """(repo_path, file_path, module, name): imported names; '*' for whole modules, '' for imports without names."""
    rows = _scripts(files)
    clause = F.regexp_extract_all("content", F.lit(r"(?s)(?:import|export)\s+((?:type\s+)?(?:[\w$]+\s*,\s*)?(?:\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?|[\w$]+)\s+from\s+['\"][^'\"]+['\"])"), 1)
    c = rows.select("repo_path", "file_path", F.explode(clause).alias("c")).select("repo_path", "file_path", F.regexp_extract("c", r"['\"]([^'\"]+)['\"]\s*$", 1).alias("module"), F.regexp_extract("c", r"(?s)^(.*?)\s+from\s", 1).alias("c"))
    braces = _names(F.regexp_extract("c", r"(?s)\{([^}]*)\}", 1), imported=True)
    plain = F.regexp_extract("c", r"^(?:type\s+)?([\w$]+)\s*(?:,|$)", 1)
    names = F.concat(braces, F.filter(F.array(plain, F.when(F.col("c").contains("*"), "*").otherwise("")), lambda x: x != ""))
    named = c.select("repo_path", "file_path", "module", F.explode(names).alias("name"))
    bare = F.regexp_extract_all("content", F.lit(r"(?:require\s*\(\s*|import\s*\(\s*|import\s+)['\"]([^'\"]+)['\"]"), 1)
    whole = rows.select("repo_path", "file_path", F.explode(bare).alias("module")).withColumn("name", F.lit(""))
    return named.unionByName(whole).distinct()


def entry_points(files: DataFrame) -> DataFrame:
    """(repo_path, file_path): files that package manifests name as main, module, types or exports, at any depth of these."""
    rows = files.filter((code.basename(F.col("file_path")) == "package.json") & F.col("content").isNotNull())
    shape = "struct<main:string,module:string,types:string,typings:string,exports:string>"
    fields = rows.select("repo_path", F.regexp_replace("file_path", r"[^/]*$", "").alias("_d"), F.from_json("content", shape).alias("j"))
    paths = F.concat(F.array("j.main", "j.module", "j.types", "j.typings"), F.coalesce(F.regexp_extract_all("j.exports", F.lit(r"\"(\.?/?[\w./-]+\.\w+)\""), 1), F.array().cast("array<string>")), F.array("j.exports"))
    flat = fields.select("repo_path", "_d", F.explode(F.array_compact(paths)).alias("p")).filter(~F.col("p").contains("{"))
    return flat.select("repo_path", F.concat("_d", F.regexp_replace("p", r"^\./", "")).alias("file_path")).distinct()


def dead_exports(files: DataFrame) -> DataFrame:
    """Exports that nothing in the repository imports, that their own file does not use, of no entry point or starred module."""
    mods = imports(files)
    out = exports(files).filter((F.col("uses") <= 1) & ~F.col("name").isin(ALWAYS_USED) & ~code.is_test_file(F.col("file_path")))
    out = out.join(mods.select("repo_path", "name").distinct(), ["repo_path", "name"], "left_anti").join(entry_points(files), ["repo_path", "file_path"], "left_anti")
    stem = F.regexp_replace(F.regexp_replace("module", r"^(?:\.{1,2}/)+", ""), r"\.(?:js|jsx|ts|tsx|mjs|cjs)$", "")
    starred = mods.filter("name = '*'").select("repo_path", stem.alias("target")).distinct()
    bare = files.select("repo_path", "file_path").join(out.select("repo_path", "file_path").distinct(), ["repo_path", "file_path"], "left_semi")
    parts = F.split(F.regexp_replace("file_path", r"\.\w+$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    met = bare.select("repo_path", "file_path", F.explode(tails).alias("target")).join(starred, ["repo_path", "target"], "left_semi").select("repo_path", "file_path").distinct()
    left = out.join(met, ["repo_path", "file_path"], "left_anti")
    title = F.concat(F.lit("Unused export: "), "name")
    return finding(left, "dead-code", "code-quality", "low", 0.6, title, F.concat(title, F.lit(" is never imported.")))


def declared(files: DataFrame) -> DataFrame:
    """(repo_path, file_path, package) of package.json files; wrong JSON declares nothing."""
    rows = files.filter((code.basename(F.col("file_path")) == "package.json") & F.col("content").isNotNull())
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    j = F.from_json("content", "struct<" + ",".join(f"{k}:map<string,string>" for k in kinds) + ">")
    none = F.array().cast("array<string>")
    keys = F.array_distinct(F.concat(*(F.coalesce(F.map_keys(j[k]), none) for k in kinds)))
    return rows.select("repo_path", "file_path", F.explode(keys).alias("package"))


def package_of(module: Column) -> Column:
    """The package of an import: two parts for scoped ones, else the first; null for relative, absolute and built-in ones."""
    parts = F.split(module, "/")
    name = F.when(F.startswith(module, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))
    return F.when(~module.rlike(r"^(?:[./]|node:|https?:)"), name)


def unused_packages(files: DataFrame) -> DataFrame:
    """Declared JavaScript packages that no file of the repository imports; tools and types are not expected to be."""
    used = imports(files).select("repo_path", package_of(F.col("module")).alias("package")).filter("package is not null").distinct()
    first = Window.partitionBy("repo_path", "package").orderBy("file_path")
    rows = declared(files).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    tool = reduce(Column.__or__, (F.startswith("package", F.lit(p)) for p in TOOL_PREFIXES)) | F.col("package").isin(TOOLS)
    left = rows.filter(~tool).join(used, ["repo_path", "package"], "left_anti")
    title = F.concat(F.lit("Unused dependency: "), "package")
    return finding(left, "unused-deps", "dependency", "low", 0.8, title, F.concat(title, F.lit(" is declared, but nothing imports it.")), line=None)


def documented_packages(lines: DataFrame) -> DataFrame:
    """(repo_path, file_path, package): what install commands in fenced blocks of start-up documents install, PEP 503 form."""
    docs = lines.filter(F.upper(code.basename(F.col("file_path"))).rlike(r"^(?:README|CONTRIBUTING|INSTALL|GETTING[-_]STARTED)(?:\.\w+)?$"))
    fence = F.col("text").rlike(r"^ {0,3}`{3,}")
    so_far = Window.partitionBy("repo_path", "file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = docs.withColumn("_f", F.sum(fence.cast("int")).over(so_far)).filter(~fence & (F.col("_f") % 2 == 1))
    args = F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(?:pip|npm)\s+install\s+([^#]+)"), 1))
    words = inside.select("repo_path", "file_path", args.alias("_a")).select("repo_path", "file_path", F.explode(F.split(F.trim("_a"), r"\s+")).alias("_w")).filter(~F.startswith("_w", F.lit("-")))
    name = code.normalized_package(F.regexp_extract(F.translate("_w", "'\"", ""), r"^([^>=<\[!~]*)", 1))
    return words.select("repo_path", "file_path", name.alias("package")).filter(~F.col("package").isin(".", "-", "e", "") & (F.length("package") >= 2)).distinct()


def dependency_drift(lines: DataFrame, actual: DataFrame, projects: DataFrame) -> DataFrame:
    """Packages that documents install but the repository does not declare. ``actual`` (repo_path, package), ``projects``
    (repo_path, name). Repositories that declare nothing are left out, as nothing can be compared."""
    known = actual.select("repo_path", code.normalized_package(F.col("package")).alias("package"))
    comparable = known.select("repo_path").distinct()
    known = known.unionByName(projects.select("repo_path", code.normalized_package(F.col("name")).alias("package"))).distinct()
    rows = documented_packages(lines).join(comparable, "repo_path", "left_semi").join(known, ["repo_path", "package"], "left_anti")
    title = F.concat(F.lit("Dependency drift: `"), "package", F.lit("` in docs but not in project"))
    return finding(rows, "docs-drift", "docs-drift", "medium", 0.9, title, title, line=None, context=F.struct(F.lit("dependency-drift").alias("pattern"), "package"))
