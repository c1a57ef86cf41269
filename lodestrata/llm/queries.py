"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.fingerprints import fingerprint_key, strict_fingerprint
from lodestrata.llm import docpairs, handwritten, incremental, leakage, neardup, neighbours, packing, responses, splitting, subjects
from lodestrata.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and methods with a documentation that says something."""
    return docpairs.found(table(spark, sf, "source_files")).distinct()


@query
def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same functions with documentation and code."""
    return docpairs.docstring_pairs(table(spark, sf, "source_files"))


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of different files, one being among the five most similar of the other."""
    near = neighbours.nearest(table(spark, sf, "chunks"), "id", "embed_model", ["repo_path", "file_path"], "embedding")
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Findings that earlier accepted ones or suppressions cover."""
    findings = table(spark, sf, "findings")
    own = strict_fingerprint(*(F.col(c) for c in ("detector", "category", "file_path", "title", "context_json")))
    records = findings.select("id", "run_id", "title", "description", F.coalesce(fingerprint_key(F.col("fingerprint")), own).alias("fp"))
    suppressed = table(spark, sf, "suppressions").select(fingerprint_key(F.col("fingerprint")).alias("fp")).filter("fp is not null")
    return incremental.covered(records, suppressed, ["title", "description"], "run_id").select(F.col("id").alias("finding_id"))


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of findings with nearly the same words."""
    near = neardup.near_duplicates(table(spark, sf, "findings"), "id", ["title", "description"], tenths=7)
    return near.pairs().select(F.col("a").alias("finding_id_a"), F.col("b").alias("finding_id_b"))


@query
def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with its class of equal word sets and the number of other classes similar to it."""
    near = neardup.near_duplicates(table(spark, sf, "findings"), "id", ["title", "description"], tenths=7)
    return near.per_record().select(F.col("id").alias("finding_id"), F.col("rep").alias("class_id"), "links")


def _chunk_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select(F.col("id").alias("item"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("declared"), "content")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of oversized chunks at which new units begin."""
    first = table(spark, sf, "chunks").filter(F.char_length("content") > 6000).select(F.col("id").alias("item"), "start_line")
    cuts = splitting.cut_lines(_chunk_items(spark, sf)).join(first, "item")
    line = F.when(F.col("line") < 0, 0).otherwise(F.col("start_line") + F.col("line"))
    return cuts.select(F.col("item").alias("chunk_id"), line.cast("int").alias("cut_line"))


@query
def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Oversized chunks as pieces of at most 6,000 characters with their lines in the file."""
    source = table(spark, sf, "chunks").filter(F.char_length("content") > 6000).select(F.col("id").alias("item"), "start_line", "content")
    cut = splitting.split(_chunk_items(spark, sf)).join(source, "item")
    text = F.substring(F.col("content"), (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    lines = [(F.col("start_line") + F.col(c)).cast("int").alias(n) for c, n in (("first_line", "start_line"), ("last_line", "end_line"))]
    return cut.select(F.col("item").alias("chunk_id"), "piece", *lines, text.alias("content"))


@query
def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents assigned to containers of 2,048 tokens."""
    return packing.pack(table(spark, sf, "documents"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Source files that nobody here wrote by hand."""
    return handwritten.not_handwritten(table(spark, sf, "source_files")).select("repo_path", "file_path").distinct()


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows whose response is no proper answer, with the defect."""
    return responses.defects(table(spark, sf, "llm_log")).select(F.col("id").alias("log_id"), "defect")


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the subjects that a paragraph or list of them is about."""
    return subjects.subjects_of(table(spark, sf, "documents"), table(spark, sf, "subject_examples"))
