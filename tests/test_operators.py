"""Operators over findings, logs, chunks and streams beyond what the catalogue's SQL covers."""

import numpy as np
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.functions import fingerprints
from lodestrata.operators import chunks, evaluation, findings
from lodestrata.streaming import findings as streaming

SCHEMA = "id long, run_id long, fingerprint string, fuzzy_fingerprint string, detector string, category string, severity string, confidence double, title string, file_path string, context_json string, status string, created_at timestamp"


def rows(spark):
    data = [
        (1, 1, "a", "z", "d", "c", "low", 0.5, "T in `x/y.py`:3", "p/a.py", None, "new", None), (2, 1, "a", "", "d", "c", "high", 0.9, "T in `q.py`", "p/b.py", None, "new", None),
        (3, 1, None, None, None, None, None, None, None, None, None, None, None), (4, 2, "b", "z", "d", "c", "critical", 0.1, "T", "p/c.py", '{"rule": "R"}', "new", None), (5, 2, None, "y", "d", "c", "odd", 0.2, "", "", "{bad", "new", None),
        (6, 1, "c", "x", "d", "c", "low", 0.5, "T from a.b (twice)", "p/d.py", None, "new", None),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_selection_and_identity(spark):
    f = rows(spark)
    assert {r["id"] for r in findings.select(f, min_severity="high").collect()} == {2, 4}
    assert {r["id"] for r in findings.first_per_fingerprint(f).collect()} == {1, 3, 4, 5, 6}
    assert [r["r"] for r in f.orderBy("id").select(findings.severity_rank(F.col("severity")).alias("r")).collect()] == [0, 2, None, 3, None, 0]
    detector, category, path, title, context = (F.col(c) for c in ("detector", "category", "file_path", "title", "context_json"))
    fps = {r["id"]: r["fp"] for r in f.select("id", fingerprints.strict_fingerprint(detector, category, path, title, context).alias("fp")).collect()}
    assert all(len(x) == 16 for x in fps.values()) and len(set(fps.values())) == 6


def test_clusters(spark):
    f = rows(spark)
    by_dir = {r["id"]: (r["directory"], r["cluster_size"]) for r in findings.cluster_by_directory(f).collect()}
    assert by_dir[1] == by_dir[6] == ("p", 3) and by_dir[3] == ("", None) and by_dir[4] == ("p", None)
    by_title = {r["id"]: (r["pattern"], r["cluster_size"]) for r in findings.cluster_by_pattern(f).collect()}
    assert by_title[1] == ("T", 3) == by_title[2] == by_title[6] and by_title[3] == (None, None)


def test_recurrence_and_merge(spark):
    f = rows(spark)
    marked = findings.mark_recurring(f, spark.createDataFrame([("b",)], "fingerprint string"), spark.createDataFrame([("z",)], "fuzzy_fingerprint string"))
    got = {r["id"]: (r["recurring"], r["fuzzy_match"]) for r in marked.collect()}
    assert got[1] == (True, True) and got[4] == (True, False) and got[3] == (False, False)
    stored = spark.createDataFrame([("a", 1), ("q", 2)], "fingerprint string, occurrence_count long").withColumns({"first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-02").cast("timestamp")})
    merged = {r["fingerprint"]: r["occurrence_count"] for r in findings.merge_persistence(stored, f, F.current_timestamp()).collect()}
    assert merged == {"a": 3, "q": 2, "b": 1, "c": 1}


def test_evaluation_counts_known_false_positives(spark):
    f = rows(spark)
    expected = spark.createDataFrame([(1, "d", "p/", "t from"), (2, "d", "", "missing"), (3, "never-ran", "", "")], "entry long, detector string, file_path string, title string")
    wrong = spark.createDataFrame([(1, "d", "p/a.py", "")], "entry long, detector string, file_path string, title string")
    row = evaluation.totals(f, expected, wrong).first()
    assert (row["true_positives"], row["missing"], row["false_positives_found"], row["recall"]) == (1, 1, 1, 0.5)


def test_chunking(spark):
    files = spark.createDataFrame([("r", "a", "\n".join(map(str, range(1, 91)))), ("r", "b", "x\r\ny\r\n"), ("r", "c", None), ("r", "d", " \n \n"), ("r", "e", "")], "repo_path string, file_path string, content string")
    got = sorted((r["file_path"], r["start_line"], r["end_line"]) for r in chunks.chunk_lines(files).collect())
    assert got == [("a", 1, 50), ("a", 41, 90), ("b", 1, 2)]


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(200)] + [(500, [0.0] * 8), (501, None), (502, [1.0, None]), (503, [1.0, 2.0]), (504, [2.0, 4.0]), (505, []), (None, [1.0, 2.0])]
    v = spark.createDataFrame(data, "id long, v array<float>").repartition(5)
    got = {}
    for r in chunks.search(v, v.filter("id % 20 = 0 or id = 503").withColumnRenamed("id", "query_id"), k=3, block_bytes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    full = {i: np.array(x) for i, x in data if i is not None and x and None not in x and len(x) == 8}
    for q in [i for i in full if i % 20 == 0]:
        cos = {i: round(float(x @ full[q] / max(1e-12, np.linalg.norm(x) * np.linalg.norm(full[q]))), 6) for i, x in full.items() if i != q}
        assert got[q] == sorted(cos, key=lambda i: (-cos[i], i))[:3]
    assert got[503] == [504]


def test_index_state(spark):
    schema = "repo_path string, file_path string, content_hash string"
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], schema)
    indexed = spark.createDataFrame([("r", "a", "1"), ("r", "a", "0"), ("r", "b", "9"), ("r", "d", "4")], schema)
    got = {r["file_path"]: r["state"] for r in chunks.index_state(files, indexed).collect()}
    assert got == {"a": "current", "b": "changed", "c": "added", "d": "removed"}


def test_streams(spark, tmp_path):
    data = rows(spark).withColumn("created_at", F.make_timestamp(F.lit(2024), F.lit(1), F.col("id").cast("int"), F.lit(0), F.lit(0), F.lit(0)))
    data.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.arriving(spark, str(tmp_path / "in"))
    quiet = streaming.unsuppressed(streaming.first_seen(stream), spark.createDataFrame([("b",)], "fingerprint string"))
    query = quiet.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["fingerprint"] for r in spark.sql("select fingerprint from fresh").collect()) == ["a", "c"]
    query = streaming.severity_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("select sum(n) s from counts").first()["s"] == 6

    store = [spark.createDataFrame([], "fingerprint string, occurrence_count long, first_seen timestamp, last_seen timestamp")]
    query = streaming.keep_persistence(stream, lambda: store[-1], lambda df: store.append(storage.materialize(df)), str(tmp_path / "ck3"))
    query.awaitTermination(60)
    assert {r["fingerprint"]: r["occurrence_count"] for r in store[-1].collect()} == {"a": 2, "b": 1, "c": 1}


def test_shared_objects_are_bounded(spark):
    shared = storage.Shared(spark, {"a": 1})
    assert spark.range(4).rdd.map(lambda _: shared.value["a"]).sum() == 4
    try:
        storage.Shared(spark, b"x" * 1000, most=10)
    except ValueError as error:
        assert "too many" in str(error)
    else:
        raise AssertionError
