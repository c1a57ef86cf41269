"""Evaluating findings against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(entry, finding_id): the detector is equal and the entry's path and title are part of the finding's.

    ``expected`` has entry (unique), detector, file_path and title; an empty path or title fits all. Joined on the
    detector; the parts are a residual condition.
    """
    e = expected.select("entry", F.col("detector").alias("_d"), F.coalesce("file_path", F.lit("")).alias("_p"), F.lower(F.coalesce("title", F.lit(""))).alias("_t"))
    fits = (F.col("detector") == F.col("_d")) & F.coalesce("file_path", F.lit("")).contains(F.col("_p")) & F.lower("title").contains(F.col("_t"))
    return findings.select("id", "detector", "file_path", "title").join(e, fits).select("entry", F.col("id").alias("finding_id"))


def per_detector(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(detector, findings, expected, true_positives, precision, recall) over the detectors of either side.

    Guarded: a side without rows gives 0. Precision counts entries found against findings, as many-to-one.
    """
    hit = matches(findings, expected).select("entry").distinct().withColumn("_hit", F.lit(1))
    e = expected.join(hit, "entry", "left").groupBy("detector").agg(F.count("*").alias("expected"), F.count("_hit").alias("true_positives"))
    f = findings.groupBy("detector").agg(F.count("*").alias("findings"))
    rows = f.join(e, "detector", "full_outer").na.fill(0)
    return rows.select(
        "detector", "findings", "expected", "true_positives",
        F.when(F.col("findings") > 0, F.col("true_positives") / F.col("findings")).otherwise(0.0).alias("precision"),
        F.when(F.col("expected") > 0, F.col("true_positives") / F.col("expected")).otherwise(0.0).alias("recall"),
    )


def totals(findings: DataFrame, expected: DataFrame, false_positives: DataFrame | None = None) -> DataFrame:
    """One row: findings, true positives, missing, known false positives found, precision, recall.

    Only entries of detectors that found anything count, so that detectors that did not run cost no recall.
    """
    ran = findings.select("detector").distinct()
    active = expected.join(ran, "detector", "left_semi")
    hit = matches(findings, active).agg(F.count_distinct("entry").alias("true_positives"))
    fps = matches(findings, false_positives).agg(F.count_distinct("entry").alias("false_positives_found")) if false_positives is not None else hit.select(F.lit(0).cast("long").alias("false_positives_found"))
    row = findings.agg(F.count("*").alias("total_findings")).crossJoin(active.agg(F.count("*").alias("expected"))).crossJoin(hit).crossJoin(fps)  # one row each
    tp, n, e = F.col("true_positives"), F.col("total_findings"), F.col("expected")
    return row.select(
        "total_findings", "true_positives", (e - tp).alias("missing"), "false_positives_found",
        F.when(n > 0, tp / n).otherwise(0.0).alias("precision"), F.when(e > 0, tp / e).otherwise(0.0).alias("recall"),
    )


def judge_metrics(judged: DataFrame) -> DataFrame:
    """One row over (judge_verdict): judged, confirmed, rejected, inconclusive."""
    v = F.col("judge_verdict")
    return judged.filter(v.isNotNull()).agg(
        F.count("*").alias("total_judged"),
        F.count_if(v == "confirmed").alias("confirmed"),
        F.count_if(v == "likely_false_positive").alias("rejected"),
        F.count_if(~v.isin("confirmed", "likely_false_positive")).alias("inconclusive"),
    )
