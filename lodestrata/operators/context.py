"""What surrounds a finding: lines of its file, its stored persistence, its context as columns, and risk of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import code
from lodestrata.operators import findings as ops


def surrounding(findings: DataFrame, files: DataFrame, around: int = 5) -> DataFrame:
    """(id, first_line, excerpt): the lines ``around`` the first line of findings (id, repo_path, file_path, line_start).

    Only findings whose file is in ``files`` (repo_path, file_path, content) and has that line. The text of a file is joined
    to its findings once and cut by an array slice, so lines are never rows.
    """
    placed = findings.filter("line_start >= 1").select("id", "repo_path", "file_path", "line_start")
    split = files.filter("content is not null").select("repo_path", "file_path", code.lines(F.col("content")).alias("l"))
    rows = placed.join(split, ["repo_path", "file_path"]).filter(F.col("line_start") <= F.size("l"))
    first = F.greatest(F.lit(1), F.col("line_start") - around)
    return rows.select("id", first.cast("int").alias("first_line"), F.array_join(F.slice("l", first, F.col("line_start") + around - first + 1), "\n").alias("excerpt"))


def with_persistence(findings: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings with occurrence_count, first_seen and last_seen of their fingerprint; count 1 and nulls where none is stored."""
    rows = findings.join(stored.select("fingerprint", "first_seen", "last_seen", "occurrence_count"), "fingerprint", "left")
    return rows.withColumn("occurrence_count", F.coalesce("occurrence_count", F.lit(1).cast("long")))


def decoded(findings: DataFrame, fields: list[str]) -> DataFrame:
    """(id, fields...): chosen fields of ``context_json`` as texts; null where the context has none or is no JSON."""
    return findings.select("id", *(F.get_json_object("context_json", f"$.{f}").alias(f) for f in fields))


def risk(churned: DataFrame) -> DataFrame:
    """(repo_path, file_path, commits, fix_ratio, risk, place): files of a repository by churn, plus ten where fixes are over 30 %."""
    ratio = F.col("fix") / F.col("commits")
    rows = churned.withColumn("fix_ratio", ratio).withColumn("risk", F.col("commits") + F.when(ratio > 0.3, 10).otherwise(0))
    place = F.row_number().over(Window.partitionBy("repo_path").orderBy(F.desc("risk"), "file_path"))
    return rows.select("repo_path", "file_path", "commits", "fix_ratio", "risk", place.alias("place"))


def combined_clusters(findings: DataFrame, min_size: int = 3) -> DataFrame:
    """(id, kind, name, cluster_size): pattern clusters within run and severity first; what is in none clusters by directory."""
    pattern, folder = ops.title_pattern(F.col("title")), ops.parent_directory(F.col("file_path"))
    rows = findings.select("id", "run_id", "severity", "detector", pattern.alias("_p"), folder.alias("_d"))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("run_id", "severity", "detector", "_p")))
    rows = rows.withColumn("_left", F.col("_n") < min_size)
    rows = rows.withColumn("_m", F.count_if("_left").over(Window.partitionBy("run_id", "severity", "_d")))
    own = F.when(~F.col("_left"), "pattern").when(F.col("_m") >= min_size, "directory")
    name = F.when(own == "pattern", F.col("_p")).when(own == "directory", F.col("_d"))
    size = F.when(own == "pattern", F.col("_n")).when(own == "directory", F.col("_m"))
    return rows.select("id", own.alias("kind"), name.alias("name"), size.alias("cluster_size"))


def clusters_by_size(findings: DataFrame) -> DataFrame:
    """(run_id, directory, size, place): directory clusters of at least three findings, the largest of a run first."""
    rows = findings.groupBy("run_id", ops.parent_directory(F.col("file_path")).alias("directory")).agg(F.count("*").alias("size")).filter("size >= 3")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("size"), "directory")))
