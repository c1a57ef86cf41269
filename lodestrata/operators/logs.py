"""Operators over the model-call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Verdicts and purposes that the summary counts.
VERDICTS = {"confirmed": "confirmed", "likely_fp": "likely_false_positive", "drift_detected": "drift_detected", "accurate": "accurate", "errors": "error", "no_parse": "no_parse"}
PURPOSES = {"judge_calls": "judge", "doc_code_calls": "doc-code-comparison"}


def delivered_once(log: DataFrame) -> DataFrame:
    """One row an id."""
    return log.dropDuplicates(["id"])


def stats(log: DataFrame) -> DataFrame:
    """One row: calls, calls by purpose and verdict, tokens and times. Sums over no rows are null."""
    return log.agg(
        F.count("*").alias("total_calls"),
        *(F.count_if(F.col("purpose") == v).alias(n) for n, v in PURPOSES.items()),
        *(F.count_if(F.col("verdict") == v).alias(n) for n, v in VERDICTS.items()),
        F.sum("tokens_generated").alias("total_tokens"),
        F.avg("tokens_generated").alias("avg_tokens"),
        F.round(F.sum("generation_ms"), 3).alias("total_generation_ms"),
        F.round(F.avg("generation_ms"), 6).alias("avg_generation_ms"),
    )


def model_speed(log: DataFrame) -> DataFrame:
    """(model, calls, total_tokens, avg_tok_s): tokens a second of every model, over calls with both measured."""
    rows = log.filter("tokens_generated is not null and generation_ms > 0").groupBy("model")
    sums = rows.agg(F.count("*").alias("calls"), F.sum("tokens_generated").alias("total_tokens"), F.sum("generation_ms").alias("_ms"))
    return sums.select("model", "calls", "total_tokens", F.round(F.col("total_tokens") / (F.col("_ms") / 1000), 1).alias("avg_tok_s"))


def filter_values(log: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column, sorted."""
    return log.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def entries(log: DataFrame, limit: int = 50, offset: int = 0, **equal: object) -> DataFrame:
    """A page of the log, newest first, for the filters that are given."""
    for column, value in equal.items():
        if value not in (None, ""):
            log = log.filter(F.col(column) == F.lit(value))
    return log.orderBy(F.desc("id")).offset(offset).limit(limit)


def judged(findings: DataFrame, log: DataFrame, cap: float = 0.3) -> DataFrame:
    """Findings with the last judgement of their fingerprint: rejected ones are damped to ``cap`` and turn false positive.

    A judgement counts if it is parsed: verdict confirmed or likely_false_positive. The adjusted severity replaces the own.
    """
    verdicts = log.filter("purpose = 'judge' and verdict in ('confirmed', 'likely_false_positive') and finding_fingerprint is not null")
    last = verdicts.groupBy("finding_fingerprint").agg(F.max_by(F.struct("verdict", "adjusted_severity"), F.struct("timestamp", "id")).alias("v"))
    rows = findings.join(last, findings["fingerprint"] == last["finding_fingerprint"], "left")
    rejected = F.col("v.verdict") == "likely_false_positive"
    return rows.select(
        findings["id"],
        F.col("v.verdict").alias("judge_verdict"),
        F.coalesce(F.nullif("v.adjusted_severity", F.lit("")), findings["severity"]).alias("severity"),
        F.when(rejected, F.least(findings["confidence"], F.lit(cap))).otherwise(findings["confidence"]).alias("confidence"),
    )
