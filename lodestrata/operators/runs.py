"""Operators over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history(runs: DataFrame, limit: int = 20, **equal: object) -> DataFrame:
    """The latest runs, by start and id."""
    for column, value in equal.items():
        runs = runs.filter(F.col(column) == F.lit(value))
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def last_completed(runs: DataFrame) -> DataFrame:
    """Of every repository its last completed run."""
    done = runs.filter("completed_at is not null")
    newest = F.row_number().over(Window.partitionBy("repo_path").orderBy(F.desc("completed_at"), F.desc("id")))
    return done.withColumn("_n", newest).filter("_n = 1").drop("_n")


def count_check(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(run_id, stored, actual) of runs whose stored number of findings is wrong."""
    actual = findings.groupBy("run_id").agg(F.count("*").alias("actual"))
    rows = runs.select(F.col("id").alias("run_id"), F.col("finding_count").alias("stored")).join(actual, "run_id", "left")
    return rows.select("run_id", "stored", F.coalesce("actual", F.lit(0)).alias("actual")).filter("stored <> actual or stored is null")
