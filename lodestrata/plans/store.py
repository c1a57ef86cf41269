"""A store of append-only parquet tables; what a database would update is an event, resolved when read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "runs": "id long, repo_path string, started_at timestamp, completed_at timestamp, scope string, finding_count long, commit_sha string",
    "findings": "id long, run_id long, fingerprint string, fuzzy_fingerprint string, detector string, category string, severity string, confidence double, title string, description string, file_path string, line_start int, line_end int, evidence_json string, context_json string, status string, created_at timestamp",
    "suppressions": "fingerprint string, reason string, suppressed_at timestamp",
    "status_events": "finding_id long, status string, at timestamp",
    "annotations": "id long, finding_id long, content string, created_at timestamp, deleted boolean",
    "llm_log": "id long, run_id long, timestamp timestamp, purpose string, model string, detector string, finding_fingerprint string, finding_title string, prompt string, response string, tokens_generated long, generation_ms double, verdict string, is_real boolean, adjusted_severity string, summary string",
    "eval_results": "repo_path string, evaluated_at timestamp, total_findings long, true_positives long, false_positives_found long, missing_count long, precision double, recall double",
    "chunks": "repo_path string, file_path string, start_line int, end_line int, content_hash string, content string, embedding array<float>, embed_model string, updated_at timestamp, deleted boolean",
    "meta": "key string, value string, at timestamp",
}


class Store:
    """Tables below ``root``; findings are partitioned by run, so that a run's findings are one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """All rows of a table; empty before anything is written."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; columns are cast to the table's and missing ones are null."""
        fields = [f.strip().split(" ", 1) for f in TABLES[name].split(", ")]
        cols = [(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
        writer = rows.select(*cols).write.mode("append")
        (writer.partitionBy("run_id") if name == "findings" else writer).parquet(f"{self.root}/{name}")

    def findings(self, run_id: int | None = None) -> DataFrame:
        """Findings with their current status: the last event of a finding, suppression of its fingerprint, else its own."""
        rows = self.table("findings")
        rows = rows if run_id is None else rows.filter(F.col("run_id") == run_id)
        last = self.table("status_events").groupBy("finding_id").agg(F.max_by("status", "at").alias("_status"))
        quiet = self.suppressed().select("fingerprint", F.lit("suppressed").alias("_quiet"))
        out = rows.join(last, rows["id"] == last["finding_id"], "left").join(quiet, "fingerprint", "left")
        return out.withColumn("status", F.coalesce("_status", "_quiet", "status")).drop("_status", "_quiet", "finding_id")

    def suppressed(self) -> DataFrame:
        """One row a fingerprint: the first decision counts."""
        first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("suppressed_at"))
        return self.table("suppressions").filter("fingerprint is not null").withColumn("_n", first).filter("_n = 1").drop("_n")

    def suppress(self, finding_ids: DataFrame, reason: str | None = None) -> None:
        """Suppress the fingerprints of findings (id), unless they are already."""
        fps = self.table("findings").join(finding_ids.select("id"), "id", "left_semi").select("fingerprint").distinct()
        new = fps.filter("fingerprint is not null").join(self.suppressed(), "fingerprint", "left_anti")
        self.append("suppressions", new.select("fingerprint", F.lit(reason).alias("reason"), F.current_timestamp().alias("suppressed_at")))

    def set_status(self, finding_ids: DataFrame, status: str) -> None:
        """Record a status for findings (id), such as approved; one call for many is the bulk form."""
        self.append("status_events", finding_ids.select(F.col("id").alias("finding_id"), F.lit(status).alias("status"), F.current_timestamp().alias("at")))

    def annotations(self, finding_id: int) -> DataFrame:
        """Notes of a finding that were not deleted, in order."""
        rows = self.table("annotations").filter(F.col("finding_id") == finding_id)
        gone = rows.filter("deleted").select("id")
        return rows.filter(~F.coalesce("deleted", F.lit(False))).join(gone, "id", "left_anti").orderBy("created_at", "id")

    def replace_chunks(self, chunks: DataFrame) -> None:
        """Put the chunks of files in place of those stored for the same files."""
        self.append("chunks", chunks.withColumn("deleted", F.lit(False)))

    def chunks(self) -> DataFrame:
        """Chunks of the last writing of every file."""
        rows = self.table("chunks")
        last = rows.groupBy("repo_path", "file_path").agg(F.max("updated_at").alias("updated_at"))
        return rows.join(last, ["repo_path", "file_path", "updated_at"], "left_semi").filter(~F.coalesce("deleted", F.lit(False))).drop("deleted")

    def meta(self) -> DataFrame:
        """The last value of every key."""
        return self.table("meta").groupBy("key").agg(F.max_by("value", "at").alias("value"))

    def pending_issues(self, existing: DataFrame) -> DataFrame:
        """Approved findings for which there is no issue (fingerprint) yet, one a fingerprint; nothing is sent."""
        rows = self.findings().filter("status = 'approved'").join(existing.select("fingerprint").distinct(), "fingerprint", "left_anti")
        first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("id"))
        return rows.withColumn("_n", first).filter("_n = 1").drop("_n")
