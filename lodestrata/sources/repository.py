"""Sources of a repository: its files, git history and tool reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import code

MAX_BYTES = 500_000


def files(spark: SparkSession, root: str, repo_path: str | None = None) -> DataFrame:
    """(repo_path, file_path, content) of text files below ``root``: no skipped folders, empty or oversized files.

    The size filter reaches the scan, so that large files are never read. Wrong bytes become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.filter(F.col("length").between(1, MAX_BYTES))
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(root) + "/*", "")
    rows = kept.select(F.lit(repo_path or root).alias("repo_path"), name.alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.filter(~code.in_skipped_dir(F.col("file_path")))


def _quoted(text: str) -> str:
    return "\\Q" + text.rstrip("/").replace("\\E", "\\E\\\\E\\Q") + "\\E"


def numbered_lines(rows: DataFrame) -> DataFrame:
    """(repo_path, file_path, line, text): the lines of files, from 1."""
    cut = rows.filter("content is not null").select("repo_path", "file_path", F.posexplode(code.lines(F.col("content"))).alias("_n", "text"))
    return cut.select("repo_path", "file_path", (F.col("_n") + 1).alias("line"), "text")


def git_log(log: DataFrame, mark: str = "@commit@") -> DataFrame:
    """(repo_path, author, subject, file_path) from the text of ``git log --name-only``.

    ``log`` has repo_path, n (order) and text: a line "<mark><author>\\t<subject>" and then one path a line. The commit is
    carried forward over its paths.
    """
    order = Window.partitionBy("repo_path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("_h", F.when(F.startswith("text", F.lit(mark)), F.substring("text", F.lit(len(mark) + 1), F.lit(1 << 30))))
    rows = rows.withColumn("_c", F.last("_h", ignorenulls=True).over(order)).filter(F.col("_h").isNull() & (F.trim("text") != ""))
    return rows.select("repo_path", F.substring_index("_c", "\t", 1).alias("author"), F.regexp_extract("_c", r"^[^\t]*\t(.*)$", 1).alias("subject"), F.trim("text").alias("file_path"))


def _read(report: Column, schema: str) -> Column:
    return F.from_json(report, schema, {"mode": "PERMISSIVE"})


def ruff(reports: DataFrame) -> DataFrame:
    """(repo_path, code, message, file_path, line_start, line_end, severity) from ruff's JSON; ``reports``: repo_path, report."""
    r = reports.select("repo_path", F.explode(_read(F.col("report"), "array<struct<code:string,message:string,filename:string,location:struct<row:int>,end_location:struct<row:int>>>")).alias("r"))
    letter = F.substring("r.code", 1, 1)
    severity = F.when(letter.isin("F", "S"), "high").when(letter.isin("W", "I", "C"), "low").otherwise("medium")
    return r.select("repo_path", F.col("r.code").alias("code"), F.col("r.message").alias("message"), F.col("r.filename").alias("file_path"), F.col("r.location.row").alias("line_start"), F.coalesce("r.end_location.row", "r.location.row").alias("line_end"), severity.alias("severity"))


def eslint(reports: DataFrame) -> DataFrame:
    """The same columns from ESLint's JSON: files, each with its messages."""
    f = reports.select("repo_path", F.explode(_read(F.col("report"), "array<struct<filePath:string,messages:array<struct<ruleId:string,message:string,line:int,endLine:int,severity:int>>>>")).alias("f"))
    m = f.select("repo_path", F.col("f.filePath").alias("file_path"), F.explode("f.messages").alias("m"))
    return m.select("repo_path", F.coalesce("m.ruleId", F.lit("unknown")).alias("code"), F.col("m.message").alias("message"), "file_path", F.col("m.line").alias("line_start"), F.coalesce("m.endLine", "m.line").alias("line_end"), F.when(F.col("m.ruleId").isin("no-eval", "no-implied-eval", "no-new-func", "no-script-url", "no-proto"), "high").when(F.col("m.severity") == 2, "medium").otherwise("low").alias("severity"))


def biome(reports: DataFrame) -> DataFrame:
    """The same columns from Biome's JSON; a message is a list of parts."""
    schema = "diagnostics:array<struct<category:string,severity:string,message:array<struct<content:string>>,location:struct<path:struct<file:string>>>>"
    d = reports.select("repo_path", F.explode(_read(F.col("report"), f"struct<{schema}>")["diagnostics"]).alias("d"))
    text = F.array_join(F.transform("d.message", lambda p: p["content"]), "")
    risky = F.col("d.category").rlike(r"(?:^|/)(?:suspicious|security)(?:/|$)")
    severity = F.when(risky, "high").when(F.col("d.severity") == "error", "medium").otherwise("low")
    none = F.lit(None).cast("int")
    return d.select("repo_path", F.coalesce("d.category", F.lit("unknown")).alias("code"), text.alias("message"), F.col("d.location.path.file").alias("file_path"), none.alias("line_start"), none.alias("line_end"), severity.alias("severity"))


def golangci(reports: DataFrame) -> DataFrame:
    """The same columns from golangci-lint's JSON, whose list of issues may be null."""
    schema = "struct<Issues:array<struct<Text:string,FromLinter:string,Severity:string,Pos:struct<Filename:string,Line:int>>>>"
    i = reports.select("repo_path", F.explode(_read(F.col("report"), schema)["Issues"]).alias("i"))
    linter = F.col("i.FromLinter")
    severity = F.when(linter.isin("gosec", "govet", "staticcheck", "errcheck"), "high").when(F.col("i.Severity").isin("warning", "info"), "low").otherwise("medium")
    return i.select("repo_path", linter.alias("code"), F.col("i.Text").alias("message"), F.col("i.Pos.Filename").alias("file_path"), F.col("i.Pos.Line").alias("line_start"), F.col("i.Pos.Line").alias("line_end"), severity.alias("severity"))


def clippy(lines: DataFrame) -> DataFrame:
    """The same columns from cargo clippy's JSON lines (repo_path, line): compiler messages at their primary span, once each."""
    schema = "struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:array<struct<is_primary:boolean,file_name:string,line_start:int,line_end:int>>>>"
    m = lines.select("repo_path", _read(F.col("line"), schema).alias("m")).filter("m.reason = 'compiler-message' and m.message.level in ('warning', 'error')")
    spans = F.col("m.message.spans")
    primary = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0)), F.get(spans, F.lit(0)))
    rows = m.withColumn("s", primary).filter("s is not null and m.message.code is not null")
    lint = F.col("m.message.code.code")
    severity = F.when((F.col("m.message.level") == "error") | lint.rlike("^clippy::(?:correctness|suspicious|security)"), "high").otherwise("medium")
    out = rows.select("repo_path", F.col("m.message.code.code").alias("code"), F.col("m.message.message").alias("message"), F.col("s.file_name").alias("file_path"), F.col("s.line_start").alias("line_start"), F.col("s.line_end").alias("line_end"), severity.alias("severity"))
    return out.dropDuplicates(["repo_path", "file_path", "line_start", "message"])


def pip_audit(reports: DataFrame) -> DataFrame:
    """(repo_path, package, version, vuln_id, description, fix_versions) from pip-audit's JSON."""
    schema = "struct<dependencies:array<struct<name:string,version:string,vulns:array<struct<id:string,description:string,fix_versions:array<string>>>>>>"
    d = reports.select("repo_path", F.explode(_read(F.col("report"), schema)["dependencies"]).alias("d"))
    v = d.select("repo_path", F.col("d.name").alias("package"), F.col("d.version").alias("version"), F.explode("d.vulns").alias("v"))
    return v.select("repo_path", "package", "version", F.col("v.id").alias("vuln_id"), F.col("v.description").alias("description"), F.array_join("v.fix_versions", ", ").alias("fix_versions"))
