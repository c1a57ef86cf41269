"""A scan: detectors over the files of many repositories at once, then identity, history, storage."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.fingerprints import fuzzy_fingerprint, strict_fingerprint
from lodestrata.operators import detectors, extract, findings, scripts
from lodestrata.plans.store import Store
from lodestrata.sources import repository
from lodestrata.storage import materialize


def documented_dependencies(tables: dict[str, DataFrame]) -> DataFrame:
    """Packages that documents install, against what Python and JavaScript manifests declare and name."""
    lines, texts = tables["lines"], tables["texts"]
    declared = detectors.declared_dependencies(lines).select("repo_path", "package").unionByName(scripts.declared(texts).select("repo_path", "package"))
    name = F.regexp_extract("text", r"^\s*\"?name\"?\s*[=:]\s*[\"']([^\"']+)", 1)
    manifests = lines.filter(F.col("file_path").rlike(r"(?:^|/)(?:pyproject\.toml|package\.json)$"))
    return scripts.dependency_drift(lines, declared, manifests.select("repo_path", name.alias("name")).filter("name <> ''"))


Detector = Callable[[dict[str, DataFrame]], DataFrame]
#: Detectors by name, in the order in which equal findings win.
REGISTRY: dict[str, Detector] = {
    "cicd-drift": lambda r: detectors.stale_ci_paths(r["lines"], r["files"]),
    "complexity": lambda r: detectors.complex_functions(r["facts"]),
    "dead-code": lambda r: detectors.union(detectors.dead_symbols(r["facts"]), scripts.dead_exports(r["texts"])),
    "docs-drift": lambda r: detectors.union(detectors.stale_links(r["lines"], r["files"]), detectors.stale_inline_paths(r["lines"], r["files"]), documented_dependencies(r)),
    "git-hotspots": lambda r: detectors.hotspots(detectors.churn(r["commits"])),
    "stale-env": lambda r: detectors.env_drift(r["lines"]),
    "todo-scanner": lambda r: detectors.markers(r["lines"]),
    "unused-deps": lambda r: detectors.union(detectors.unused_dependencies(detectors.declared_dependencies(r["lines"]), extract.imports(r["facts"])), scripts.unused_packages(r["texts"])),
}


def register(name: str, detector: Detector) -> None:
    """Add a detector; a built-in one is not replaced."""
    REGISTRY.setdefault(name, detector)


def relations(files: DataFrame, commits: DataFrame | None = None, changed: DataFrame | None = None) -> dict[str, DataFrame]:
    """What detectors read, each written once: files, texts, lines, facts, commits.

    With ``changed`` (repo_path, file_path) lines and facts are those of changed files only, while paths are looked up among
    all files.
    """
    scope = files if changed is None else files.join(changed, ["repo_path", "file_path"], "left_semi")
    none = files.select("repo_path", "file_path", F.lit("").alias("author"), F.lit("").alias("subject")).limit(0)
    return {"files": files.select("repo_path", "file_path"), "texts": scope, "lines": materialize(repository.numbered_lines(scope), "lines"), "facts": materialize(extract.facts(scope), "facts"), "commits": none if commits is None else commits}


def detect(tables: dict[str, DataFrame], enabled: list[str] | None = None, disabled: list[str] = ()) -> tuple[DataFrame | None, dict[str, str]]:
    """(findings with det_rank, failures): each detector's result is written on its own, so that one failure costs only it."""
    out, failed = None, {}
    for rank, name in enumerate(REGISTRY):
        if name in disabled or (enabled and name not in enabled):
            continue
        try:
            found = materialize(REGISTRY[name](tables), name).withColumn("det_rank", F.lit(rank))
        except Exception as error:  # noqa: BLE001 - isolation of detectors
            logging.getLogger(__name__).warning("detector %s failed: %s", name, error)
            failed[name] = str(error)
            continue
        out = found if out is None else out.unionByName(found)
    return out, failed


def identified(found: DataFrame) -> DataFrame:
    """With both fingerprints; of each repository and fingerprint the first by detector, path and line."""
    cols = [F.col(c) for c in ("detector", "category", "file_path", "title", "context_json")]
    rows = found.withColumns({"fingerprint": strict_fingerprint(*cols), "fuzzy_fingerprint": fuzzy_fingerprint(cols[0], cols[1], cols[3], cols[4])})
    first = F.row_number().over(Window.partitionBy("repo_path", "fingerprint").orderBy("det_rank", "file_path", "line_start", "title"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n")


def scan(store: Store, files: DataFrame, run_id: int, commits: DataFrame | None = None, changed: DataFrame | None = None, enabled: list[str] | None = None, retention_days: int = 90) -> DataFrame:
    """Run detectors, drop suppressed findings, mark recurring ones, store findings and the run; the run's findings."""
    started = F.current_timestamp()
    found, _ = detect(relations(files, commits, changed), enabled)
    if found is None:
        return store.findings(run_id)
    history = store.table("findings")
    rows = findings.without_suppressed(identified(found), store.suppressed())
    marked = findings.mark_recurring(rows, findings.known(history, "fingerprint", started, retention_days), findings.known(history, "fuzzy_fingerprint", started, retention_days))
    base = history.agg(F.max("id")).first()[0] or 0
    # Ids follow the findings' order: a global sort, whose partitions are then numbered from their sizes.
    ordered = materialize(marked.orderBy("repo_path", "det_rank", "file_path", "line_start", "title").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = ordered.groupBy("_p").count()
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    out = ordered.join(F.broadcast(offsets), "_p").withColumns({"id": F.lit(base + 1) + F.col("_o") + F.col("_i"), "run_id": F.lit(run_id), "status": F.lit("new"), "created_at": started})
    store.append("findings", out)
    done = out.groupBy("repo_path").agg(F.count("*").alias("finding_count"))
    store.append("runs", done.select(F.lit(run_id).alias("id"), "repo_path", started.alias("started_at"), F.current_timestamp().alias("completed_at"), F.lit("full" if changed is None else "incremental").alias("scope"), "finding_count"))
    return store.findings(run_id)
