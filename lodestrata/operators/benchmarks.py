"""Comparing benchmark runs and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_model(results: DataFrame, models: list[str], value: str = "findings") -> DataFrame:
    """(detector, one column a model): a value of every detector by model; ``models`` are given, so no pass looks for them."""
    return results.groupBy("detector").pivot("model", models).agg(F.first(value, ignorenulls=True))


def split_by_kind(per_detector: DataFrame, model_detectors: list[str]) -> DataFrame:
    """(uses_model, findings, expected, true_positives, precision, recall): detectors that ask a model against the others."""
    rows = per_detector.groupBy(F.col("detector").isin(model_detectors).alias("uses_model"))
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("findings", "expected", "true_positives")))
    tp = F.col("true_positives")
    return sums.withColumns({"precision": F.coalesce(F.try_divide(tp, F.col("findings")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(tp, F.col("expected")), F.lit(0.0))})


def quality_matrix(detectors: DataFrame, ratings: DataFrame, classes: list[str]) -> DataFrame:
    """(detector, one column a model class): ratings, 'untested' where there is none."""
    rows = detectors.select("detector").join(ratings, "detector", "left").groupBy("detector").pivot("model_class", classes).agg(F.first("rating"))
    return rows.na.fill("untested", classes)


def model_class(log: DataFrame, classes: dict[str, str]) -> DataFrame:
    """With ``model_class``: the class of the longest key that the model's name contains; null if none does."""
    whens = [F.when(F.contains(F.lower("model"), F.lit(k.lower())), F.lit(classes[k])) for k in sorted(classes, key=len, reverse=True)]
    return log.withColumn("model_class", F.coalesce(*whens) if whens else F.lit(None).cast("string"))


def class_speed(speeds: DataFrame) -> DataFrame:
    """(model_class, calls, tok_s): call-weighted mean speed of the models of a class (model_class, calls, avg_tok_s)."""
    rows = speeds.filter("model_class is not null").groupBy("model_class")
    return rows.agg(F.sum("calls").alias("calls"), F.round(F.sum(F.col("calls") * F.col("avg_tok_s")) / F.sum("calls"), 1).alias("tok_s"))


def recommended(ratings: DataFrame) -> DataFrame:
    """(detector, model_class, rating): of every detector the class with the best rating, ties by name."""
    rank = F.array_position(F.array(*map(F.lit, ["excellent", "good", "fair", "poor", "untested"])), F.col("rating"))
    return ratings.groupBy("detector").agg(F.min_by(F.struct("model_class", "rating"), F.struct(rank, F.col("model_class"))).alias("b")).select("detector", "b.model_class", "b.rating")
