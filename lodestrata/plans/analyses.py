"""More registered queries: context, risk, benchmarks and models, clusters, parts of the stores; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import benchmarks, chunks, context, detectors, evaluation, extract, findings, logs
from lodestrata.plans.catalogue import _PARENT, _TITLE, _TRUTH, _HIT, _micros, _truth, query
from lodestrata.sources.tables import table

_LINES = "string_split(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with the repository of their run."""
    runs = table(spark, sf, "runs").select(F.col("id").alias("run_id"), "repo_path")
    return table(spark, sf, "findings").join(runs, "run_id")


@query(
    f"WITH s AS (SELECT repo_path, file_path, {_LINES} AS l FROM source_files WHERE content IS NOT NULL) SELECT f.id, greatest(1, line_start - 5)::INT AS first_line,"
    " array_to_string(l[greatest(1, line_start - 5):line_start + 5], chr(10)) AS excerpt FROM findings f JOIN runs r ON r.id = f.run_id JOIN s ON s.repo_path = r.repo_path AND s.file_path = f.file_path WHERE line_start >= 1 AND line_start <= len(l)"
)
def surrounding_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Five lines before and after every finding."""
    return context.surrounding(_placed(spark, sf), table(spark, sf, "source_files"))


@query(
    "WITH p AS (SELECT fingerprint, min(started_at) a, max(started_at) z, count(*) n FROM (SELECT DISTINCT fingerprint, run_id FROM findings WHERE fingerprint IS NOT NULL) f JOIN runs r ON r.id = f.run_id GROUP BY 1)"
    " SELECT f.id, coalesce(n, 1) AS occurrence_count, epoch_us(a) AS first_seen, epoch_us(z) AS last_seen FROM findings f LEFT JOIN p ON p.fingerprint = f.fingerprint"
)
def findings_with_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with how often and since when they have been seen."""
    f = table(spark, sf, "findings")
    rows = context.with_persistence(f, findings.persistence(f, table(spark, sf, "runs")))
    return _micros(rows, "first_seen", "last_seen").select("id", "occurrence_count", "first_seen", "last_seen")


@query("SELECT id, json_extract_string(context_json, '$.rule') AS rule, json_extract_string(context_json, '$.pattern') AS pattern, json_extract_string(context_json, '$.vuln_id') AS vuln_id, json_extract_string(context_json, '$.package') AS package FROM findings")
def findings_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the stored context as columns."""
    return context.decoded(table(spark, sf, "findings"), ["rule", "pattern", "vuln_id", "package"])


_KIND = {k: p.replace("'", "''") for k, p in detectors.CHANGES.items()}
_CHURN = (
    "(SELECT repo_path, file_path, count(*) AS commits, count(DISTINCT detector) AS authors, count(*) FILTER (k = 'fix') AS fix, count(*) FILTER (k = 'refactor') AS refactor, count(*) FILTER (k = 'feature') AS feature,"
    f" count(*) FILTER (k = 'other') AS other FROM (SELECT r.repo_path, file_path, detector, CASE WHEN regexp_matches(title, '{_KIND['fix']}') THEN 'fix' WHEN regexp_matches(title, '{_KIND['refactor']}') THEN 'refactor'"
    f" WHEN regexp_matches(title, '{_KIND['feature']}') THEN 'feature' ELSE 'other' END AS k FROM findings f JOIN runs r ON r.id = f.run_id WHERE file_path IS NOT NULL AND NOT regexp_matches(file_path, '{{skipped}}')) GROUP BY 1, 2)"
)


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Findings taken as changes of their file: detectors as authors, titles as subjects."""
    return _placed(spark, sf).filter("file_path is not null").select("repo_path", "file_path", F.col("detector").alias("author"), F.col("title").alias("subject"))


def _skipped() -> str:
    from lodestrata.functions import code

    return "(^|/)(" + "|".join(d.replace(".", "\\.") for d in code.SKIP_DIRS) + ")/"


_CHURN = _CHURN.replace("{skipped}", _skipped())


@query(f"SELECT * FROM {_CHURN}")
def file_churn(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of every file with authors and kinds of change."""
    return detectors.churn(_commits(spark, sf))


@query(
    f"WITH c AS (SELECT *, fix / commits AS fix_ratio FROM {_CHURN}), r AS (SELECT *, commits + CASE WHEN fix_ratio > 0.3 THEN 10 ELSE 0 END AS risk FROM c)"
    " SELECT repo_path, file_path, commits, fix_ratio, risk, row_number() OVER (PARTITION BY repo_path ORDER BY risk DESC, file_path)::INT AS place FROM r"
)
def file_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every repository in order of risk."""
    return context.risk(detectors.churn(_commits(spark, sf)))


@query(
    f"WITH c AS (SELECT * FROM {_CHURN}), s AS (SELECT repo_path, avg(commits) m, stddev_pop(commits) d, count(*) n FROM c GROUP BY 1) SELECT c.repo_path, c.file_path, 'Git hotspot: ' || c.file_path || ' (' || commits || ' commits)' AS title"
    " FROM c JOIN s ON s.repo_path = c.repo_path WHERE n >= 2 AND d >= 1 AND commits >= greatest(10, m + 2 * d)"
)
def detect_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Files that change far more often than their repository's others."""
    return detectors.hotspots(detectors.churn(_commits(spark, sf))).select("repo_path", "file_path", "title")


@query(
    f"WITH a AS (SELECT id, run_id, severity, detector, {_TITLE} AS p, {_PARENT} AS d FROM findings), b AS (SELECT *, count(*) OVER (PARTITION BY run_id, severity, detector, p) AS n FROM a),"
    " c AS (SELECT *, count(*) FILTER (n < 3) OVER (PARTITION BY run_id, severity, d) AS m FROM b) SELECT id, CASE WHEN n >= 3 THEN 'pattern' WHEN m >= 3 THEN 'directory' END AS kind,"
    " CASE WHEN n >= 3 THEN p WHEN m >= 3 THEN d END AS name, CASE WHEN n >= 3 THEN n WHEN m >= 3 THEN m END AS cluster_size FROM c"
)
def clusters_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a run's severities: by pattern, and by directory for the rest."""
    return context.combined_clusters(table(spark, sf, "findings"))


@query(f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, directory)::INT AS place FROM (SELECT run_id, {_PARENT} AS directory, count(*) AS size FROM findings GROUP BY ALL HAVING count(*) >= 3)")
def clusters_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return context.clusters_by_size(table(spark, sf, "findings"))


# --- models and benchmarks ----------------------------------------------------------------------------------------------

#: Example classes by parts of model names, longest part first wherever several match.
CLASSES = {"model": "any", "a": "a-like", "er": "er-like", "in": "in-like", "4b": "small", "mini": "small", "large": "large"}
_CLASS = "CASE " + " ".join(f"WHEN contains(lower(model), '{k}') THEN '{CLASSES[k]}'" for k in sorted(CLASSES, key=len, reverse=True)) + " END"
_ONCE = "(SELECT DISTINCT ON (id) * FROM llm_log)"


@query(f"SELECT id, model, {_CLASS} AS model_class FROM {_ONCE}")
def model_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every call's model, by the longest known part of its name."""
    return benchmarks.model_class(logs.delivered_once(table(spark, sf, "llm_log")), CLASSES).select("id", "model", "model_class")


@query(
    f"SELECT model_class, sum(calls)::BIGINT AS calls, round(sum(calls * avg_tok_s) / sum(calls), 1) AS tok_s FROM (SELECT {_CLASS} AS model_class, count(*) AS calls, round(sum(tokens_generated) / (sum(generation_ms) / 1000), 1) AS avg_tok_s"
    f" FROM {_ONCE} WHERE tokens_generated IS NOT NULL AND generation_ms > 0 GROUP BY model) WHERE model_class IS NOT NULL GROUP BY 1"
)
def class_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Mean speed of every class of models, weighted by calls."""
    speeds = logs.model_speed(logs.delivered_once(table(spark, sf, "llm_log")))
    return benchmarks.class_speed(benchmarks.model_class(speeds, CLASSES).drop("total_tokens"))


_JUDGED = f"(SELECT detector, verdict, count(*) AS n FROM {_ONCE} WHERE detector IS NOT NULL GROUP BY ALL)"


@query(
    "SELECT detector, max(n) FILTER (verdict = 'confirmed') AS confirmed, max(n) FILTER (verdict = 'likely_false_positive') AS likely_false_positive FROM " + _JUDGED + " GROUP BY detector"
)
def verdicts_by_detector(spark: SparkSession, sf: str) -> DataFrame:
    """A benchmark-like pivot: calls of every detector by verdict."""
    rows = logs.delivered_once(table(spark, sf, "llm_log")).filter("detector is not null").groupBy("detector", F.col("verdict").alias("model")).agg(F.count("*").alias("n"))
    return benchmarks.by_model(rows, ["confirmed", "likely_false_positive"], "n")


_RATED = (
    f"(SELECT detector, purpose AS model_class, CASE WHEN share >= 0.5 THEN 'excellent' WHEN share >= 0.35 THEN 'good' WHEN share >= 0.2 THEN 'fair' ELSE 'poor' END AS rating FROM (SELECT detector, purpose, count(*) FILTER (verdict = 'confirmed') / count(*) AS share FROM {_ONCE}"
    " WHERE detector IS NOT NULL AND purpose IS NOT NULL GROUP BY ALL))"
)


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of detectors by purpose, from the share of confirmed calls."""
    log = logs.delivered_once(table(spark, sf, "llm_log")).filter("detector is not null and purpose is not null")
    share = log.groupBy("detector", F.col("purpose").alias("model_class")).agg((F.count_if(F.col("verdict") == "confirmed") / F.count("*")).alias("share"))
    rating = F.when(F.col("share") >= 0.5, "excellent").when(F.col("share") >= 0.35, "good").when(F.col("share") >= 0.2, "fair").otherwise("poor")
    return share.select("detector", "model_class", rating.alias("rating"))


@query(
    f"SELECT d.detector, coalesce(max(rating) FILTER (model_class = 'judge'), 'untested') AS judge, coalesce(max(rating) FILTER (model_class = 'synthesis'), 'untested') AS synthesis"
    f" FROM (SELECT DISTINCT detector FROM findings) d LEFT JOIN {_RATED} r ON r.detector = d.detector GROUP BY d.detector"
)
def quality_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings of every detector, 'untested' where there is none."""
    return benchmarks.quality_matrix(table(spark, sf, "findings").select("detector").distinct(), _ratings(spark, sf), ["judge", "synthesis"])


@query(f"SELECT detector, model_class, rating FROM {_RATED} QUALIFY row_number() OVER (PARTITION BY detector ORDER BY list_position(['excellent','good','fair','poor','untested'], rating), model_class) = 1")
def best_ratings(spark: SparkSession, sf: str) -> DataFrame:
    """The best rated class of every detector."""
    return benchmarks.recommended(_ratings(spark, sf))


_ASKING = ["semantic-drift", "test-coherence", "inline-comment-drift", "intent-comparison", "docs-drift"]
_SPLIT = "detector IN (" + ",".join(f"'{d}'" for d in _ASKING) + ")"


@query(
    f"WITH e AS (SELECT {_SPLIT} AS m, count(*) AS expected, count(h.entry) AS tp FROM {_TRUTH} t LEFT JOIN {_HIT} h ON h.entry = t.entry GROUP BY 1), f AS (SELECT {_SPLIT} AS m, count(*) AS n FROM findings GROUP BY 1)"
    " SELECT f.m AS uses_model, n AS findings, expected, tp AS true_positives, tp / n AS precision, tp / expected AS recall FROM f JOIN e ON e.m = f.m"
)
def evaluation_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of detectors that ask a model against the others."""
    f = table(spark, sf, "findings")
    return benchmarks.split_by_kind(evaluation.per_detector(f, _truth(f)), _ASKING)


@query("SELECT 'purpose' AS field, purpose AS value FROM (SELECT DISTINCT purpose FROM llm_log WHERE purpose IS NOT NULL) UNION ALL SELECT 'model', model FROM (SELECT DISTINCT model FROM llm_log WHERE model IS NOT NULL) UNION ALL SELECT 'verdict', verdict FROM (SELECT DISTINCT verdict FROM llm_log WHERE verdict IS NOT NULL)")
def log_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every value by which the log can be filtered."""
    log, out = table(spark, sf, "llm_log"), None
    for field in ("purpose", "model", "verdict"):
        own = logs.filter_values(log, field).select(F.lit(field).alias("field"), F.col(field).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"SELECT purpose, verdict, count(*) AS n FROM {_ONCE} GROUP BY ALL")
def log_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Number of calls for each pair of filters, which a page is a part of."""
    return logs.delivered_once(table(spark, sf, "llm_log")).groupBy("purpose", "verdict").agg(F.count("*").alias("n"))


@query("SELECT repo_path, file_path, string_agg(DISTINCT content_hash, ',' ORDER BY content_hash) AS hashes FROM chunks GROUP BY ALL")
def indexed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the chunk index with the set of their content hashes."""
    return chunks.hashes(table(spark, sf, "chunks")).select("repo_path", "file_path", F.array_join("hashes", ",").alias("hashes"))


@query()
def detect_complexity_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Python functions over lower limits: complexity 5 or 20 lines."""
    return detectors.complex_functions(extract.facts(table(spark, sf, "source_files")), complexity=5, lines=20)
