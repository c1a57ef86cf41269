"""Operators over the findings relation: selection, identity, recurrence, comparison, clustering, persistence, reports.

Every function takes and returns DataFrames, adds no action, and names its columns. Ties are broken by id, so that results
are the same on any number of partitions. Null keys never match anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from low to high.
SEVERITIES = ["low", "medium", "high", "critical"]
# Fixed value: what a title has besides its pattern: places, line numbers and a trailing bracket.
FILE_SPECIFIC = r"\b(?:in|at|from)\s+`?[\w./\\-]+`?|(?::\s*\d+)|\s*\([^)]{1,60}\)\s*$"


def severity_rank(severity: Column) -> Column:
    """0 to 3; null for anything else."""
    rank = F.when(severity == SEVERITIES[0], 0)
    for n, s in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(severity == s, n)
    return rank


def select(findings: DataFrame, min_severity: str | None = None, min_confidence: float | None = None, **equal: object) -> DataFrame:
    """Rows that equal the given column values, reach the minimum severity and confidence; pushed down to the scan."""
    for column, value in equal.items():
        findings = findings.filter(F.col(column) == F.lit(value))
    if min_severity is not None:
        findings = findings.filter(F.col("severity").isin(SEVERITIES[SEVERITIES.index(min_severity) :]))
    if min_confidence is not None:
        findings = findings.filter(F.col("confidence") >= min_confidence)
    return findings


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of rows, newest id first; the page is the feature."""
    return rows.orderBy(F.desc("id")).offset(offset).limit(limit)


def first_per_fingerprint(findings: DataFrame) -> DataFrame:
    """Of each run and fingerprint the first finding; findings without fingerprint are all kept."""
    first = F.row_number().over(Window.partitionBy("run_id", "fingerprint").orderBy("id"))
    return findings.withColumn("_n", F.when(F.col("fingerprint").isNull(), 1).otherwise(first)).filter("_n = 1").drop("_n")


def without_suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings whose fingerprint nobody suppressed."""
    return findings.join(suppressions.select("fingerprint").distinct(), "fingerprint", "left_anti")


def known(findings: DataFrame, key: str, as_of: Column, days: int) -> DataFrame:
    """Distinct non-empty ``key`` of findings created within ``days`` before ``as_of``; 0 days means always."""
    rows = findings.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    if days:
        rows = rows.filter(F.col("created_at") >= as_of - F.make_interval(days=F.lit(days)))
    return rows.select(key).distinct()


def mark_recurring(findings: DataFrame, known_strict: DataFrame, known_fuzzy: DataFrame) -> DataFrame:
    """With ``recurring`` and ``fuzzy_match``: seen before by fingerprint, else by the fingerprint without path."""
    strict = known_strict.select(F.col("fingerprint"), F.lit(True).alias("_s"))
    fuzzy = known_fuzzy.select(F.col("fuzzy_fingerprint"), F.lit(True).alias("_f"))
    rows = findings.join(strict, "fingerprint", "left").join(fuzzy, "fuzzy_fingerprint", "left")
    by_fuzzy = F.col("_s").isNull() & F.col("_f").isNotNull()
    return rows.withColumns({"recurring": F.col("_s").isNotNull() | F.col("_f").isNotNull(), "fuzzy_match": by_fuzzy}).drop("_s", "_f")


def compare_runs(base: DataFrame, target: DataFrame) -> DataFrame:
    """(change, fingerprint, id): new and persistent rows of the target, resolved ones of the base; last of a fingerprint."""
    last = Window.partitionBy("fingerprint").orderBy(F.desc("id"))

    def latest(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter("fingerprint is not null").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        return rows.select("fingerprint", F.col("id").alias(name))

    both = latest(base, "b").join(latest(target, "t"), "fingerprint", "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("t").isNull(), "resolved").otherwise("persistent")
    return both.select(change.alias("change"), "fingerprint", F.coalesce("t", "b").alias("id"))


def persistence(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """(fingerprint, first_seen, last_seen, occurrence_count): over the runs a fingerprint was found in, once a run."""
    seen = findings.filter("fingerprint is not null").select("fingerprint", "run_id").distinct()
    when = seen.join(runs.select(F.col("id").alias("run_id"), "started_at"), "run_id")
    return when.groupBy("fingerprint").agg(
        F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"), F.count("*").alias("occurrence_count")
    )


def merge_persistence(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Stored persistence after a batch of fingerprints: counts rise by the batch's rows, last_seen moves, new ones start."""
    new = batch.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("_n"))
    rows = stored.join(new, "fingerprint", "full_outer")
    seen = F.col("_n").isNotNull()
    return rows.select(
        "fingerprint",
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("occurrence_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("occurrence_count"),
    )


def parent_directory(path: Column) -> Column:
    """The path without its last part; '.' for a bare name, '' for none."""
    bare = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")
    up = F.when(bare.contains("/"), F.regexp_replace(bare, "/[^/]*$", "")).otherwise(F.lit("."))
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.when(up == "", "/").otherwise(up))


def title_pattern(title: Column) -> Column:
    """A title without places, line numbers and a trailing bracket."""
    return F.trim(F.regexp_replace(title, FILE_SPECIFIC, ""))


def cluster(findings: DataFrame, keys: dict[str, Column], min_size: int = 3) -> DataFrame:
    """Findings with the given keys and ``cluster_size``, null where fewer than ``min_size`` of a run share the keys.

    Sizes come from a map-side combined count, so a key that a third of all findings share costs no sort.
    """
    rows = findings.withColumns(keys)
    by = ["run_id", *keys]
    sizes = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("cluster_size")).filter(F.col("cluster_size") >= min_size)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return rows.join(sizes, same, "left").drop(*(f"_{c}" for c in by))


def cluster_by_directory(findings: DataFrame, min_size: int = 3) -> DataFrame:
    return cluster(findings, {"directory": parent_directory(F.col("file_path"))}, min_size)


def cluster_by_pattern(findings: DataFrame, min_size: int = 3) -> DataFrame:
    return cluster(findings, {"detector_key": F.col("detector"), "pattern": title_pattern(F.col("title"))}, min_size)


def counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Number of findings by keys."""
    return findings.groupBy(*keys).agg(F.count("*").alias("n"))


def severity_category_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and category with subtotals; nulls of a subtotal are told from null values by ``level``."""
    return findings.rollup("severity", "category").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def with_annotations(findings: DataFrame, annotations: DataFrame) -> DataFrame:
    """(finding_id, notes, last_note_at): non-empty notes of findings."""
    notes = annotations.filter(F.trim("content") != "").groupBy("finding_id").agg(F.count("*").alias("notes"), F.max("created_at").alias("last_note_at"))
    return findings.select(F.col("id").alias("finding_id")).join(notes, "finding_id")


def prune(tables: dict[str, DataFrame], cutoff: Column) -> dict[str, DataFrame]:
    """Tables without what is older than ``cutoff``: log rows by time, runs by start, their findings and annotations.

    ``tables``: runs, findings, annotations, llm_log. Suppressions are decisions and are never pruned.
    """
    old = tables["runs"].filter(F.col("started_at") < cutoff).select(F.col("id").alias("run_id"))
    gone = tables["findings"].join(old, "run_id", "left_semi").select(F.col("id").alias("finding_id"))
    return {
        "runs": tables["runs"].filter(~(F.col("started_at") < cutoff) | F.col("started_at").isNull()),
        "findings": tables["findings"].join(old, "run_id", "left_anti"),
        "annotations": tables["annotations"].join(gone, "finding_id", "left_anti"),
        "llm_log": tables["llm_log"].filter(~(F.col("timestamp") < cutoff) | F.col("timestamp").isNull()),
    }


def report_items(findings: DataFrame, low_limit: int = 20) -> DataFrame:
    """Findings in report order within their run with ``position``; of low ones the first ``low_limit`` are visible."""
    order = Window.partitionBy("run_id", "severity").orderBy(F.desc("confidence"), "id")
    place = F.row_number().over(order)
    return findings.withColumn("position", place).withColumn("visible", (F.col("severity") != "low") | (F.col("position") <= low_limit))
