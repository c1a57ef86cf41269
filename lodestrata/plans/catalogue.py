"""The registered queries and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import code, fingerprints
from lodestrata.operators import chunks, detectors, evaluation, extract, findings, logs, runs, scripts
from lodestrata.sources import repository
from lodestrata.sources.tables import table
from lodestrata.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "findings_report"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _latest(df: DataFrame, column: str) -> F.Column:
    """The table's own newest time as a literal, in place of the clock, so that results can be repeated."""
    return F.lit(df.agg(F.max(column)).first()[0])


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    """Times as microseconds since 1970, which compare alike everywhere."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


_PARENT = r"CASE WHEN coalesce(file_path,'')='' THEN '' WHEN contains(file_path,'/') THEN regexp_replace(file_path,'/[^/]*$','') ELSE '.' END"
_DAYS_90 = "(SELECT max(created_at) FROM findings) - INTERVAL 90 DAY"
_BASE = "(SELECT min(run_id) FROM findings)"
_TARGET = "(SELECT max(run_id) FROM findings)"


# --- selection and counts ---------------------------------------------------------------------------------------------


@query(
    "SELECT id, run_id, severity, position, (severity <> 'low' OR position <= 20) AS visible FROM (SELECT id, run_id, severity,"
    " row_number() OVER (PARTITION BY run_id, severity ORDER BY confidence DESC, id)::INT AS position FROM findings)"
)
def findings_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding at its place in its run's report; of low ones the first 20 are visible."""
    return findings.report_items(table(spark, sf, "findings")).select("id", "run_id", "severity", "position", "visible")


@query("SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def findings_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return findings.counts(table(spark, sf, "findings"), "severity")


@query("SELECT detector, count(*) AS n FROM findings GROUP BY detector")
def findings_by_detector(spark: SparkSession, sf: str) -> DataFrame:
    return findings.counts(table(spark, sf, "findings"), "detector")


@query("SELECT severity, category, count(*) AS n, grouping(severity, category)::INT AS level FROM findings GROUP BY ROLLUP (severity, category)")
def findings_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by severity and category with subtotals."""
    return findings.severity_category_rollup(table(spark, sf, "findings"))


@query("SELECT id, detector, severity, confidence FROM findings WHERE severity IN ('high','critical') AND confidence >= 0.7 AND status = 'new'")
def findings_min_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum severity, confidence floor and equality at once."""
    return findings.select(table(spark, sf, "findings"), min_severity="high", min_confidence=0.7, status="new").select("id", "detector", "severity", "confidence")


@query("SELECT id, title FROM findings WHERE run_id = (SELECT max(run_id) FROM findings)")
def findings_of_run(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings")
    return findings.select(f, run_id=f.agg(F.max("run_id")).first()[0]).select("id", "title")


@query("SELECT id, title, epoch_us(created_at) AS created_us FROM findings ORDER BY id DESC LIMIT 50 OFFSET 100")
def findings_page(spark: SparkSession, sf: str) -> DataFrame:
    return findings.page(table(spark, sf, "findings"), 50, 100).select("id", "title", F.unix_micros("created_at").alias("created_us"))


# --- identity, recurrence, comparison ---------------------------------------------------------------------------------

_RAW = "regexp_replace(regexp_replace(lower(trim(fingerprint)), '^[a-z][a-z0-9_-]*\\s*[:=]\\s*', ''), '^(.{16}).*$', '\\1')"


@query(f"SELECT id, nullif({_RAW}, '') AS fp FROM findings")
def fingerprint_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints in their normal form."""
    return table(spark, sf, "findings").select("id", fingerprints.fingerprint_key(F.col("fingerprint")).alias("fp"))


_CTX = "json_extract_string(context_json, '$.{}')"
_NORM = "lower(trim(regexp_replace(CASE WHEN coalesce({rule},'')<>'' THEN {rule} || ':' {path} || coalesce(title,'') WHEN coalesce({vuln},'')<>'' THEN {vuln} || ':' || coalesce({package},'') ELSE coalesce(title,'') END, '\\s+', ' ', 'g')))"
_FIELDS = {"rule": _CTX.format("rule"), "vuln": _CTX.format("vuln_id"), "package": _CTX.format("package")}
_EFFECTIVE = f"CASE WHEN {_CTX.format('pattern')} IN ('stale-inline-path','stale-reference') THEN coalesce(nullif({_CTX.format('referenced_path')},''), nullif({_CTX.format('target')},''), file_path, '') ELSE coalesce(file_path,'') END"


@query(
    "SELECT id, substr(sha256(concat_ws(':', detector, category, "
    + _EFFECTIVE + ", " + _NORM.format(path="|| coalesce(file_path,'') || ':'", **_FIELDS)
    + ")),1,16) AS strict_fp, substr(sha256(concat_ws(':', detector, category, " + _NORM.format(path="", **_FIELDS) + ")),1,16) AS fuzzy_fp FROM findings"
)
def fingerprint_computed(spark: SparkSession, sf: str) -> DataFrame:
    """Strict and fuzzy fingerprints computed from the finding itself."""
    f = table(spark, sf, "findings")
    detector, category, path, title, context = (F.col(c) for c in ("detector", "category", "file_path", "title", "context_json"))
    return f.select("id", fingerprints.strict_fingerprint(detector, category, path, title, context).alias("strict_fp"), fingerprints.fuzzy_fingerprint(detector, category, title, context).alias("fuzzy_fp"))


@query("SELECT id, run_id, fingerprint FROM findings QUALIFY fingerprint IS NULL OR row_number() OVER (PARTITION BY run_id, fingerprint ORDER BY id) = 1")
def dedup_in_run(spark: SparkSession, sf: str) -> DataFrame:
    """The first finding of every fingerprint of a run."""
    return findings.first_per_fingerprint(table(spark, sf, "findings")).select("id", "run_id", "fingerprint")


@query("SELECT id, fingerprint FROM findings f WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.fingerprint = f.fingerprint)")
def unsuppressed(spark: SparkSession, sf: str) -> DataFrame:
    return findings.without_suppressed(table(spark, sf, "findings"), table(spark, sf, "suppressions")).select("id", "fingerprint")


@query(f"SELECT DISTINCT fingerprint FROM findings WHERE fingerprint IS NOT NULL AND fingerprint <> '' AND created_at >= {_DAYS_90}")
def known_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints seen within 90 days."""
    f = table(spark, sf, "findings")
    return findings.known(f, "fingerprint", _latest(f, "created_at"), 90)


@query(
    f"WITH old AS (SELECT * FROM findings WHERE run_id < {_TARGET} AND created_at >= {_DAYS_90}), s AS (SELECT DISTINCT fingerprint FROM old WHERE fingerprint <> ''),"
    f" z AS (SELECT DISTINCT fuzzy_fingerprint FROM old WHERE fuzzy_fingerprint <> '') SELECT f.id, (s.fingerprint IS NOT NULL OR z.fuzzy_fingerprint IS NOT NULL) AS recurring,"
    f" (s.fingerprint IS NULL AND z.fuzzy_fingerprint IS NOT NULL) AS fuzzy_match FROM findings f LEFT JOIN s ON s.fingerprint = f.fingerprint"
    f" LEFT JOIN z ON z.fuzzy_fingerprint = f.fuzzy_fingerprint WHERE f.run_id = {_TARGET}"
)
def recurring_in_last_run(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the last run, marked where earlier runs had them, by fingerprint or across a rename."""
    f = table(spark, sf, "findings")
    last = f.agg(F.max("run_id")).first()[0]
    old, new = f.filter(F.col("run_id") < last), f.filter(F.col("run_id") == last)
    now = _latest(f, "created_at")
    marked = findings.mark_recurring(new, findings.known(old, "fingerprint", now, 90), findings.known(old, "fuzzy_fingerprint", now, 90))
    return marked.select("id", "recurring", "fuzzy_match")


@query(
    f"WITH b AS (SELECT fingerprint, max(id) AS i FROM findings WHERE run_id = {_BASE} AND fingerprint IS NOT NULL GROUP BY 1), t AS (SELECT fingerprint, max(id) AS i FROM findings"
    f" WHERE run_id = {_TARGET} AND fingerprint IS NOT NULL GROUP BY 1) SELECT CASE WHEN b.i IS NULL THEN 'new' WHEN t.i IS NULL THEN 'resolved' ELSE 'persistent' END AS change,"
    " coalesce(t.fingerprint, b.fingerprint) AS fingerprint, coalesce(t.i, b.i) AS id FROM b FULL OUTER JOIN t ON b.fingerprint = t.fingerprint"
)
def compare_first_and_last_run(spark: SparkSession, sf: str) -> DataFrame:
    """New, resolved and persistent findings between two runs."""
    f = table(spark, sf, "findings")
    low, high = f.agg(F.min("run_id"), F.max("run_id")).first()
    return findings.compare_runs(f.filter(F.col("run_id") == low), f.filter(F.col("run_id") == high))


@query(
    "SELECT fingerprint, epoch_us(min(started_at)) AS first_seen, epoch_us(max(started_at)) AS last_seen, count(*) AS occurrence_count FROM (SELECT DISTINCT fingerprint, run_id FROM findings"
    " WHERE fingerprint IS NOT NULL) f JOIN runs r ON r.id = f.run_id GROUP BY fingerprint"
)
def persistence(spark: SparkSession, sf: str) -> DataFrame:
    """First and last sight of every fingerprint and the number of its runs."""
    return _micros(findings.persistence(table(spark, sf, "findings"), table(spark, sf, "runs")), "first_seen", "last_seen")


@query(
    f"WITH old AS (SELECT fingerprint, min(started_at) a, max(started_at) z, count(*) n FROM (SELECT DISTINCT fingerprint, run_id FROM findings WHERE fingerprint IS NOT NULL AND run_id < {_TARGET}) f"
    f" JOIN runs r ON r.id = f.run_id GROUP BY 1), new AS (SELECT fingerprint, count(*) m FROM findings WHERE fingerprint IS NOT NULL AND run_id = {_TARGET} GROUP BY 1), t AS (SELECT max(started_at) x FROM runs)"
    " SELECT coalesce(old.fingerprint, new.fingerprint) AS fingerprint, epoch_us(coalesce(a, x)) AS first_seen, epoch_us(CASE WHEN m IS NOT NULL THEN x ELSE z END) AS last_seen, coalesce(n,0)+coalesce(m,0) AS occurrence_count"
    " FROM old FULL OUTER JOIN new ON old.fingerprint = new.fingerprint CROSS JOIN t"
)
def persistence_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored persistence after the last run is merged into it."""
    f, r = table(spark, sf, "findings"), table(spark, sf, "runs")
    last = f.agg(F.max("run_id")).first()[0]
    stored = findings.persistence(f.filter(F.col("run_id") < last), r)
    merged = findings.merge_persistence(stored, f.filter(F.col("run_id") == last), _latest(r, "started_at"))
    return _micros(merged, "first_seen", "last_seen")


@query(
    "SELECT CASE WHEN occurrence_count > 1 THEN 'recurring' ELSE 'new' END AS kind, count(*) AS n FROM (SELECT fingerprint, count(DISTINCT run_id) AS occurrence_count FROM findings"
    " WHERE fingerprint IS NOT NULL AND run_id IN (SELECT id FROM runs) GROUP BY 1) GROUP BY 1"
)
def new_and_recurring(spark: SparkSession, sf: str) -> DataFrame:
    seen = findings.persistence(table(spark, sf, "findings"), table(spark, sf, "runs"))
    return seen.groupBy(F.when(F.col("occurrence_count") > 1, "recurring").otherwise("new").alias("kind")).agg(F.count("*").alias("n"))


# --- clusters, annotations, retention ---------------------------------------------------------------------------------


@query(f"SELECT id, directory, CASE WHEN n >= 3 THEN n END AS cluster_size FROM (SELECT id, {_PARENT} AS directory, count(*) OVER (PARTITION BY run_id, {_PARENT}) AS n FROM findings)")
def clusters_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with the size of their directory's cluster in their run."""
    return findings.cluster_by_directory(table(spark, sf, "findings")).select("id", "directory", "cluster_size")


_TITLE = r"trim(regexp_replace(title, '\b(?:in|at|from)\s+`?[\w./\\-]+`?|(?::\s*\d+)|\s*\([^)]{1,60}\)\s*$', '', 'g'))"


@query(f"SELECT id, pattern, CASE WHEN n >= 3 THEN n END AS cluster_size FROM (SELECT id, {_TITLE} AS pattern, count(*) OVER (PARTITION BY run_id, detector, {_TITLE}) AS n FROM findings)")
def clusters_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with the size of the cluster of their detector and title without particulars."""
    return findings.cluster_by_pattern(table(spark, sf, "findings")).select("id", "pattern", "cluster_size")


@query("SELECT finding_id, count(*) AS notes, epoch_us(max(a.created_at)) AS last_note_at FROM annotations a JOIN findings f ON f.id = a.finding_id WHERE trim(content) <> '' GROUP BY finding_id")
def annotated_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _micros(findings.with_annotations(table(spark, sf, "findings"), table(spark, sf, "annotations")), "last_note_at")


_CUT = "((SELECT max(started_at) FROM runs) - INTERVAL 90 DAY)"


@query(
    f"WITH old AS (SELECT id FROM runs WHERE started_at < {_CUT}), g AS (SELECT id FROM findings WHERE run_id IN (SELECT id FROM old)) SELECT 'runs' AS name, count(*) AS kept FROM runs WHERE NOT coalesce(started_at < {_CUT}, false)"
    f" UNION ALL SELECT 'findings', count(*) FROM findings WHERE run_id IS NULL OR run_id NOT IN (SELECT id FROM old) UNION ALL SELECT 'annotations', count(*) FROM annotations WHERE finding_id NOT IN (SELECT id FROM g)"
    f" UNION ALL SELECT 'llm_log', count(*) FROM llm_log WHERE NOT coalesce(timestamp < {_CUT}, false)"
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are left of every table after pruning what is older than 90 days, cascades included."""
    names = ("runs", "findings", "annotations", "llm_log")
    tables = {n: table(spark, sf, n) for n in names}
    kept = findings.prune(tables, _latest(tables["runs"], "started_at") - F.make_interval(days=F.lit(90)))
    out = None
    for n in names:
        row = kept[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("name"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


# --- runs ---------------------------------------------------------------------------------------------------------------


@query("SELECT id, repo_path, epoch_us(started_at) AS started_us FROM runs ORDER BY started_at DESC, id DESC LIMIT 20")
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    return runs.history(table(spark, sf, "runs")).select("id", "repo_path", F.unix_micros("started_at").alias("started_us"))


@query("SELECT id, repo_path, epoch_us(completed_at) AS completed_us FROM runs WHERE completed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo_path ORDER BY completed_at DESC, id DESC) = 1")
def last_completed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.last_completed(table(spark, sf, "runs")).select("id", "repo_path", F.unix_micros("completed_at").alias("completed_us"))


@query(
    "SELECT r.id AS run_id, finding_count AS stored, coalesce(n, 0) AS actual FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM findings GROUP BY 1) f ON f.run_id = r.id"
    " WHERE finding_count IS NULL OR finding_count <> coalesce(n, 0)"
)
def wrong_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose stored number of findings is wrong."""
    return runs.count_check(table(spark, sf, "runs"), table(spark, sf, "findings"))


# --- model-call log -----------------------------------------------------------------------------------------------------

_ONCE = "(SELECT DISTINCT ON (id) * FROM llm_log)"


@query(
    "SELECT count(*) AS total_calls, count(*) FILTER (purpose='judge') AS judge_calls, count(*) FILTER (purpose='doc-code-comparison') AS doc_code_calls, count(*) FILTER (verdict='confirmed') AS confirmed,"
    " count(*) FILTER (verdict='likely_false_positive') AS likely_fp, count(*) FILTER (verdict='drift_detected') AS drift_detected, count(*) FILTER (verdict='accurate') AS accurate,"
    " count(*) FILTER (verdict='error') AS errors, count(*) FILTER (verdict='no_parse') AS no_parse, sum(tokens_generated)::BIGINT AS total_tokens, avg(tokens_generated) AS avg_tokens,"
    f" round(sum(generation_ms),3) AS total_generation_ms, round(avg(generation_ms),6) AS avg_generation_ms FROM {_ONCE}"
)
def log_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of all calls, each counted once."""
    return logs.stats(logs.delivered_once(table(spark, sf, "llm_log")))


@query(
    f"SELECT model, count(*) AS calls, sum(tokens_generated)::BIGINT AS total_tokens, round(sum(tokens_generated) / (sum(generation_ms) / 1000), 1) AS avg_tok_s FROM {_ONCE}"
    " WHERE tokens_generated IS NOT NULL AND generation_ms > 0 GROUP BY model"
)
def model_speed(spark: SparkSession, sf: str) -> DataFrame:
    return logs.model_speed(logs.delivered_once(table(spark, sf, "llm_log")))


@query("SELECT DISTINCT model FROM llm_log WHERE model IS NOT NULL")
def log_models(spark: SparkSession, sf: str) -> DataFrame:
    return logs.filter_values(table(spark, sf, "llm_log"), "model")


@query(f"SELECT id, model, verdict FROM {_ONCE} WHERE purpose = 'judge' AND verdict = 'confirmed' ORDER BY id DESC LIMIT 50 OFFSET 50")
def log_page(spark: SparkSession, sf: str) -> DataFrame:
    """A filtered page of the log."""
    return logs.entries(logs.delivered_once(table(spark, sf, "llm_log")), 50, 50, purpose="judge", verdict="confirmed").select("id", "model", "verdict")


_VERDICT = (
    "(SELECT finding_fingerprint fp, arg_max(verdict, (timestamp, id)) v, arg_max(struct_pack(s := adjusted_severity), (timestamp, id)).s s FROM llm_log WHERE purpose='judge'"
    " AND verdict IN ('confirmed','likely_false_positive') AND finding_fingerprint IS NOT NULL GROUP BY 1)"
)


@query(
    f"SELECT f.id, v AS judge_verdict, coalesce(nullif(s,''), severity) AS severity, CASE WHEN v='likely_false_positive' THEN least(confidence, 0.3::DOUBLE) ELSE confidence END AS confidence FROM findings f LEFT JOIN {_VERDICT} l ON l.fp = f.fingerprint"
)
def judged_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with their last judgement applied."""
    return logs.judged(table(spark, sf, "findings"), table(spark, sf, "llm_log"))


@query(f"SELECT count(*) AS total_judged, count(*) FILTER (v='confirmed') AS confirmed, count(*) FILTER (v='likely_false_positive') AS rejected, 0::BIGINT AS inconclusive FROM findings f JOIN {_VERDICT} l ON l.fp = f.fingerprint")
def judge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.judge_metrics(logs.judged(table(spark, sf, "findings"), table(spark, sf, "llm_log")))


# --- evaluation ---------------------------------------------------------------------------------------------------------

_TRUTH = (
    "(SELECT id AS entry, detector, regexp_replace(coalesce(file_path,''), '^.*/', '') AS file_path, lower(title) AS title FROM findings WHERE status = 'confirmed'"
    " UNION ALL SELECT -id, detector, 'no/such/path', title FROM findings WHERE status = 'false_positive')"
)
_HIT = f"(SELECT DISTINCT entry FROM {_TRUTH} e JOIN findings f ON f.detector = e.detector AND contains(coalesce(f.file_path,''), e.file_path) AND contains(lower(f.title), lower(e.title)))"


def _truth(f: DataFrame) -> DataFrame:
    """Entries made of the table itself: confirmed findings by file name and title, and as many that nothing matches."""
    name = F.regexp_replace(F.coalesce("file_path", F.lit("")), "^.*/", "")
    real = f.filter("status = 'confirmed'").select(F.col("id").alias("entry"), "detector", name.alias("file_path"), F.lower("title").alias("title"))
    none = f.filter("status = 'false_positive'").select((-F.col("id")).alias("entry"), "detector", F.lit("no/such/path").alias("file_path"), "title")
    return real.unionByName(none)


@query(
    f"WITH e AS (SELECT t.detector, count(*) AS expected, count(h.entry) AS tp FROM {_TRUTH} t LEFT JOIN {_HIT} h ON h.entry = t.entry GROUP BY 1), f AS (SELECT detector, count(*) AS n FROM findings GROUP BY 1)"
    " SELECT coalesce(f.detector, e.detector) AS detector, coalesce(n,0) AS findings, coalesce(expected,0) AS expected, coalesce(tp,0) AS true_positives, CASE WHEN coalesce(n,0)>0 THEN coalesce(tp,0)/n ELSE 0.0 END AS precision,"
    " CASE WHEN coalesce(expected,0)>0 THEN coalesce(tp,0)/expected ELSE 0.0 END AS recall FROM f FULL OUTER JOIN e ON f.detector = e.detector"
)
def evaluation_per_detector(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of every detector against substring ground truth."""
    f = table(spark, sf, "findings")
    return evaluation.per_detector(f, _truth(f))


@query(
    f"SELECT n AS total_findings, tp AS true_positives, x - tp AS missing, fps AS false_positives_found, tp/n AS precision, tp/x AS recall FROM (SELECT (SELECT count(*) FROM findings) n, (SELECT count(*) FROM {_TRUTH}) x, (SELECT count(*) FROM {_HIT}) tp, (SELECT count(DISTINCT e.entry) FROM (SELECT id AS entry, detector, regexp_replace(coalesce(file_path,''), '^.*/', '') AS file_path, title FROM findings WHERE status = 'false_positive') e"
    " JOIN findings f ON f.detector = e.detector AND contains(coalesce(f.file_path,''), e.file_path) AND contains(lower(f.title), lower(e.title))) fps)"
)
def evaluation_totals(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings")
    name = F.regexp_replace(F.coalesce("file_path", F.lit("")), "^.*/", "")
    wrong = f.filter("status = 'false_positive'").select(F.col("id").alias("entry"), "detector", name.alias("file_path"), "title")
    return evaluation.totals(f, _truth(f), wrong)


# --- chunks and vectors -------------------------------------------------------------------------------------------------


@query("SELECT repo_path, count(*) AS chunks, count(DISTINCT file_path) AS files FROM chunks GROUP BY repo_path")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.counts(table(spark, sf, "chunks"))


@query("SELECT id, repo_path, file_path, start_line FROM chunks QUALIFY row_number() OVER (PARTITION BY repo_path, file_path, start_line, embed_model ORDER BY updated_at DESC, id DESC) = 1")
def latest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.latest(table(spark, sf, "chunks")).select("id", "repo_path", "file_path", "start_line")


@query("SELECT id, substr(sha256(content),1,16) AS hash, substr(sha256(content),1,16) = content_hash AS fresh FROM chunks")
def chunk_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes of chunks and whether the stored one still holds."""
    h = chunks.content_hash(F.col("content"))
    return table(spark, sf, "chunks").select("id", h.alias("hash"), (h == F.col("content_hash")).alias("fresh"))


@query(
    "WITH c AS (SELECT repo_path, file_path, count(*) n FROM chunks GROUP BY 1, 2), s AS (SELECT DISTINCT f.repo_path, f.file_path FROM source_files f JOIN chunks c ON c.repo_path = f.repo_path AND c.file_path = f.file_path AND c.content_hash = f.content_hash)"
    " SELECT coalesce(f.repo_path, c.repo_path) AS repo_path, coalesce(f.file_path, c.file_path) AS file_path, CASE WHEN f.content_hash IS NULL THEN 'removed' WHEN n IS NULL THEN 'added' WHEN s.repo_path IS NOT NULL THEN 'current' ELSE 'changed' END AS state"
    " FROM source_files f FULL OUTER JOIN c ON c.repo_path = f.repo_path AND c.file_path = f.file_path LEFT JOIN s ON s.repo_path = f.repo_path AND s.file_path = f.file_path"
)
def index_state(spark: SparkSession, sf: str) -> DataFrame:
    """Files added, removed, changed or current against the chunk index."""
    return chunks.index_state(table(spark, sf, "source_files"), table(spark, sf, "chunks"))


_LINES = "string_split(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))"


@query(
    f"WITH f AS (SELECT repo_path, file_path, {_LINES} AS l FROM source_files WHERE content IS NOT NULL AND content <> ''), w AS (SELECT *, unnest(range(0, greatest(0, ceil((len(l)-50)/40.0))::BIGINT + 1)) AS n FROM f)"
    " SELECT repo_path, file_path, (n*40+1)::INT AS start_line, least(n*40+50, len(l))::INT AS end_line, length(array_to_string(l[n*40+1:n*40+50], chr(10))) AS n_chars FROM w WHERE trim(regexp_replace(array_to_string(l[n*40+1:n*40+50], chr(10)), '\\s+', ' ', 'g')) <> ''"
)
def chunked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files cut into windows of 50 lines that overlap by 10."""
    cut = chunks.chunk_lines(table(spark, sf, "source_files"))
    return cut.select("repo_path", "file_path", "start_line", "end_line", F.char_length("content").cast("long").alias("n_chars"))


@query(
    "SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id,"
    " round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 5"
)
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest vectors for every vector whose id is divisible by 20, among all, exactly."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return chunks.search(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"))


# --- detectors over source files ------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return repository.numbered_lines(table(spark, sf, "source_files"))


def _facts(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    """Facts of the Python files; written down where a plan reads them several times, so that files are parsed once."""
    rows = extract.facts(table(spark, sf, "source_files"))
    return rows if once else materialize(rows, "facts")


@query(
    f"SELECT repo_path, file_path, len({_LINES})::BIGINT AS lines, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' END AS language FROM source_files WHERE content IS NOT NULL"
)
def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Number of lines and language of every file."""
    rows = table(spark, sf, "source_files").filter("content is not null")
    return rows.select("repo_path", "file_path", F.size(code.lines(F.col("content"))).cast("long").alias("lines"), code.language(F.col("file_path")).alias("language"))


@query()
def detect_markers(spark: SparkSession, sf: str) -> DataFrame:
    """TODO, FIXME, HACK and XXX comments."""
    return detectors.markers(_lines(spark, sf))


@query()
def detect_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """Python functions that are too complex or too long."""
    return detectors.complex_functions(_facts(spark, sf, once=True))


@query()
def detect_dead_code(spark: SparkSession, sf: str) -> DataFrame:
    """Public Python symbols that nothing imports."""
    return detectors.dead_symbols(_facts(spark, sf))


@query()
def detect_dead_exports(spark: SparkSession, sf: str) -> DataFrame:
    """JavaScript and TypeScript exports that nothing imports."""
    return scripts.dead_exports(table(spark, sf, "source_files"))


@query(
    "SELECT repo_path, file_path, m.module AS module, count(*) AS names FROM (SELECT repo_path, file_path, unnest(regexp_extract_all(content, 'import\\s+(?:\\{[^}]*\\}|[\\w$]+)\\s+from\\s+[''\"]([^''\"]+)[''\"]', 1)) AS module FROM source_files"
    " WHERE regexp_matches(file_path, '\\.(js|ts)$')) m GROUP BY ALL"
)
def script_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that scripts import, with the number of names."""
    rows = scripts.imports(table(spark, sf, "source_files")).filter("name <> '' and name <> '*'")
    return rows.groupBy("repo_path", "file_path", "module").agg(F.count("*").alias("names"))


@query()
def detect_stale_links(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown links and paths in code spans that lead nowhere."""
    lines, files = _lines(spark, sf), table(spark, sf, "source_files")
    return detectors.union(detectors.stale_links(lines, files), detectors.stale_inline_paths(lines, files))


@query()
def detect_layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Imports against the order tests, app, lib and one prohibition."""
    return detectors.layer_violations(detectors.import_edges(_facts(spark, sf, once=True)), ["tests", "app", "packages", "lib"], ["shared"], [("app", "tests")])


@query()
def extract_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Python functions and methods with their measures."""
    return extract.functions(_facts(spark, sf, once=True))


@query()
def extract_classes(spark: SparkSession, sf: str) -> DataFrame:
    return extract.classes(_facts(spark, sf, once=True))


@query()
def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    return extract.imports(_facts(spark, sf, once=True))


@query()
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of Markdown files from heading to heading."""
    return detectors.sections(_lines(spark, sf).filter(F.endswith("file_path", F.lit(".md"))))


@query()
def test_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Tests with the functions they name."""
    return detectors.test_implementation_pairs(_facts(spark, sf))


@query("SELECT id, substr(sha256(prompt),1,16) AS prompt_hash, coalesce(r.response,'{}') AS response, r.response IS NOT NULL AS matched FROM (SELECT DISTINCT ON (id) * FROM llm_log) l LEFT JOIN (SELECT substr(sha256(prompt),1,16) AS h, min(response) AS response FROM llm_log WHERE response IS NOT NULL GROUP BY 1) r ON r.h = substr(sha256(prompt),1,16)")
def replayed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every prompt with the first recorded response to the same prompt, else a default."""
    log = table(spark, sf, "llm_log")
    hashed = log.filter("response is not null").groupBy(F.substring(F.sha2("prompt", 256), 1, 16).alias("prompt_hash")).agg(F.min("response").alias("response"))
    return detectors.replayed(logs.delivered_once(log).select("id", "prompt"), hashed)
