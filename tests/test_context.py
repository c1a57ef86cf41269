"""Context, persistence, risk and clusters of findings."""

from pyspark.sql import functions as F

from lodestrata.operators import chunks, context

FINDING = "id long, run_id long, fingerprint string, detector string, severity string, title string, repo_path string, file_path string, line_start int, context_json string"


def rows(spark, *some):
    return spark.createDataFrame([(i, 1, None, "d", "low", "t", "r", p, n, c) for i, p, n, c in some], FINDING)


def test_surrounding_lines(spark):
    files = spark.createDataFrame([("r", "a.py", "\r\n".join(f"l{i}" for i in range(1, 21))), ("r", "b.py", None), ("r", "e.py", "")], "repo_path string, file_path string, content string")
    found = rows(spark, (1, "a.py", 10, None), (2, "a.py", 2, None), (3, "a.py", 20, None), (4, "a.py", 21, None), (5, "b.py", 1, None), (6, None, 1, None), (7, "a.py", None, None))
    got = {r["id"]: (r["first_line"], r["excerpt"].split("\n")) for r in context.surrounding(found, files).collect()}
    assert got == {1: (5, [f"l{i}" for i in range(5, 16)]), 2: (1, [f"l{i}" for i in range(1, 8)]), 3: (15, [f"l{i}" for i in range(15, 21)])}
    assert context.surrounding(found.limit(0), files).count() == 0


def test_persistence_and_context(spark):
    stored = spark.createDataFrame([("f", 1, 2, 5)], "fingerprint string, first_seen long, last_seen long, occurrence_count long")
    found = rows(spark, (1, "a", 1, '{"rule": "E1"}'), (2, "a", 1, "no json"), (3, "a", 1, None))
    marked = found.withColumn("fingerprint", F.when(F.col("id") == 1, "f"))
    assert {r["id"]: r["occurrence_count"] for r in context.with_persistence(marked, stored).collect()} == {1: 5, 2: 1, 3: 1}
    assert {r["id"]: r["rule"] for r in context.decoded(found, ["rule"]).collect()} == {1: "E1", 2: None, 3: None}


def test_clusters_of_the_rest(spark):
    found = spark.createDataFrame([(i, 1, None, "d", "low", t, "r", p, 1, None) for i, (t, p) in enumerate([("same in a.py", "x/a"), ("same in b.py", "x/b"), ("same at c", "y/c"), ("one", "z/a"), ("two", "z/b"), ("three", "z/c"), ("four", "x/d"), ("five", None)])], FINDING)
    got = {r["id"]: (r["kind"], r["cluster_size"]) for r in context.combined_clusters(found).collect()}
    assert got == {0: ("pattern", 3), 1: ("pattern", 3), 2: ("pattern", 3), 3: ("directory", 3), 4: ("directory", 3), 5: ("directory", 3), 6: (None, None), 7: (None, None)}


def test_risk_and_hashes(spark):
    churn = spark.createDataFrame([("r", "a", 12, 1), ("r", "b", 4, 2), ("r", "c", 13, 0)], "repo_path string, file_path string, commits long, fix long")
    assert [r["file_path"] for r in context.risk(churn).orderBy("place").collect()] == ["b", "c", "a"]
    some = spark.createDataFrame([("r", "a", "2"), ("r", "a", "1"), ("r", "a", "2"), ("r", "a", None)], "repo_path string, file_path string, content_hash string")
    assert [r["hashes"] for r in chunks.hashes(some).collect()] == [["1", "2"]]


def test_recordings_of_any_id_are_replayed(spark, tmp_path):
    from lodestrata.plans import catalogue

    log = [(1, "p", "r1"), (2, "q", None), (3, "q", "r3"), (4, "none", None)]
    spark.createDataFrame(log, "id long, prompt string, response string").write.parquet(str(tmp_path / "llm_log.parquet"))
    got = {r["id"]: (r["response"], r["matched"]) for r in catalogue.QUERIES["replayed_prompts"](spark, str(tmp_path)).collect()}
    assert got == {1: ("r1", True), 2: ("r3", True), 3: ("r3", True), 4: ("{}", False)}
