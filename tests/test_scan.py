"""The store, whole scans, judging and benchmark comparison."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import benchmarks, judging
from lodestrata.plans import scan
from lodestrata.plans.store import Store

FILES = "repo_path string, file_path string, content string"


def corpus(spark):
    return spark.createDataFrame([("r", "src/a.py", "# TODO: one\n# FIXME: two\n"), ("r", "docs/x.md", "[a](gone.md)\n"), ("q", "src/a.py", "# TODO: one\n"), ("q", "b.py", None)], FILES)


def test_scan_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = scan.scan(store, corpus(spark), 1).collect()
    assert sorted(r["title"] for r in first) == ["FIXME: two", "Stale link: [a](gone.md)", "TODO: one", "TODO: one"]
    assert sorted(r["id"] for r in first) == [1, 2, 3, 4]
    store.suppress(store.findings(1).filter("title like 'Stale%'").select("id"), "known")
    store.set_status(store.findings(1).filter("title like 'FIXME%'").select("id"), "approved")
    second = scan.scan(store, corpus(spark), 2).collect()
    assert sorted(r["title"] for r in second) == ["FIXME: two", "TODO: one", "TODO: one"]
    assert {r["fingerprint"] for r in second} <= {r["fingerprint"] for r in first} and min(r["id"] for r in second) == 5
    assert {r["title"]: r["status"] for r in store.findings(1).collect()} == {"FIXME: two": "approved", "Stale link: [a](gone.md)": "suppressed", "TODO: one": "new"}
    assert store.table("runs").count() == 4
    assert [r["title"] for r in store.pending_issues(spark.createDataFrame([], "fingerprint string")).collect()] == ["FIXME: two"]
    changed = spark.createDataFrame([("q", "src/a.py")], "repo_path string, file_path string")
    assert [r["repo_path"] for r in scan.detect(scan.relations(corpus(spark), changed=changed))[0].collect()] == ["q"]


def test_manifests_meet_documents(spark):
    files = spark.createDataFrame([("r", "README.md", "```\npip install box other own-name\nnpm install pad\n```\n", ), ("r", "pyproject.toml", '[project]\nname = "own_name"\ndependencies = ["Box>=1"]\n'), ("r", "package.json", '{"name": "x", "dependencies": {"pad": "1"}}')], FILES)
    found, failed = scan.detect(scan.relations(files), enabled=["docs-drift"])
    assert not failed and [r["title"] for r in found.collect()] == ["Dependency drift: `other` in docs but not in project"]


def test_one_failing_detector_costs_only_itself(spark, monkeypatch):
    monkeypatch.setattr(scan, "REGISTRY", {**scan.REGISTRY, "broken": lambda r: r["lines"].select(F.raise_error(F.lit("no")).alias("x"))})
    found, failed = scan.detect(scan.relations(corpus(spark)), enabled=["broken", "todo-scanner"])
    assert list(failed) == ["broken"] and found.count() == 3


def test_store_views(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.table("findings").count() == 0
    store.append("annotations", spark.sql("select 1L id, 7L finding_id, 'a' content, timestamp'2024-01-01' created_at, false deleted union all select 2L, 7L, 'b', timestamp'2024-01-02', null"))
    store.append("annotations", spark.sql("select 1L id, 7L finding_id, true deleted"))
    assert [r["content"] for r in store.annotations(7).collect()] == ["b"]
    for day, text in ((1, "old"), (2, "new")):
        store.replace_chunks(spark.sql(f"select 'r' repo_path, 'a' file_path, {day} start_line, '{text}' content, timestamp'2024-01-0{day}' updated_at"))
        store.append("meta", spark.sql(f"select 'k' key, '{text}' value, timestamp'2024-01-0{day}' at"))
    assert [r["content"] for r in store.chunks().collect()] == ["new"] and [tuple(r) for r in store.meta().collect()] == [("k", "new")]


def test_judging(spark):
    found = spark.createDataFrame([(i, "low", 0.9) for i in range(1, 7)], "id long, severity string, confidence double")
    texts = {1: '```json\n{"is_real": false, "adjusted_severity": "high"}\n```', 2: 'So: {"is_real": true, "adjusted_severity": "odd", "summary": "x"} done', 3: "no object", 4: '{"summary": "only"}', 5: None}
    answers = spark.createDataFrame(list(texts.items()), "id long, response string")
    got = {r["id"]: (r["judge_verdict"], r["severity"], r["confidence"]) for r in judging.judge(found, answers).collect()}
    assert got == {1: ("likely_false_positive", "high", 0.3), 2: ("confirmed", "low", 0.9), 3: ("inconclusive", "low", 0.9), 4: ("confirmed", "low", 0.9), 5: (None, "low", 0.9), 6: (None, "low", 0.9)}


def test_asking_keeps_rows_of_failed_calls(spark):
    def client(prompts):
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, prompt string").coalesce(1)
    assert {tuple(r) for r in judging.ask(prompts, client, batch=1).collect()} == {(1, "A"), (2, None), (3, "C")}


def test_contradictions(spark):
    base = {"between": ["code", "docs: guide"], "severity": "high", "quote_a": "returns a list", "quote_b": "returns a map", "reason": "The code returns a list, while the guide promises a map."}
    rows = [base, {**base, "between": ["code", "moon"]}, {**base, "between": ["code"]}, {**base, "reason": "short"}, {**base, "reason": base["reason"] + " They are compatible."}, {**base, "reason": "It possibly returns something that is different here."}, {**base, "quote_a": "", "reason": "x" * 40}, {**base, "quote_b": None, "reason": "y" * 61}]
    answers = spark.createDataFrame([(1, json.dumps({"contradictions": rows})), (2, "nothing"), (3, None)], "id long, response string")
    assert sorted(r["reason"][0] for r in judging.contradictions(answers, ["code", "docs", "tests"]).collect()) == ["T", "y"]


def test_synthesis(spark):
    rows = spark.createDataFrame([(i, "d", f"title {i}") for i in range(30)] + [(99, "e", "alone")], "id long, dir string, title string")
    prompt = judging.synthesis_prompts(rows, ["dir"]).collect()
    assert [(r["dir"], r["size"]) for r in prompt] == [("d", 30)] and "title 19" in prompt[0]["prompt"] and "title 20" not in prompt[0]["prompt"]
    got = judging.synthesis(spark.createDataFrame([("d", '{"root_cause": "one rename"}'), ("e", "?")], "dir string, response string"), ["dir"])
    assert {(r["dir"], r["root_cause"], r["confidence"]) for r in got.collect()} == {("d", "one rename", 0.7), ("e", "No common cause was found.", 0.7)}


def test_benchmarks(spark):
    results = spark.createDataFrame([("a", "m1", 3), ("a", "m2", 4), ("b", "m1", 1)], "detector string, model string, findings long")
    assert {tuple(r) for r in benchmarks.by_model(results, ["m1", "m2"]).collect()} == {("a", 3, 4), ("b", 1, None)}
    ratings = spark.createDataFrame([("a", "small", "good"), ("a", "large", "excellent")], "detector string, model_class string, rating string")
    matrix = benchmarks.quality_matrix(results.select("detector").distinct(), ratings, ["small", "large"])
    assert {tuple(r) for r in matrix.collect()} == {("a", "good", "excellent"), ("b", "untested", "untested")}
    assert [tuple(r) for r in benchmarks.recommended(ratings).collect()] == [("a", "large", "excellent")]
    classed = benchmarks.model_class(spark.createDataFrame([("big-9b-q4", 2, 10.0), ("big-4b", 6, 20.0), ("odd", 1, 1.0)], "model string, calls long, avg_tok_s double"), {"big": "small", "big-9b": "large"})
    assert {tuple(r) for r in benchmarks.class_speed(classed).collect()} == {("large", 2, 10.0), ("small", 6, 20.0)}
    kinds = benchmarks.split_by_kind(spark.createDataFrame([("a", 4, 2, 2), ("b", 0, 1, 0)], "detector string, findings long, expected long, true_positives long"), ["b"])
    assert {(r["uses_model"], r["precision"], r["recall"]) for r in kinds.collect()} == {(False, 0.5, 1.0), (True, 0.0, 0.0)}


@pytest.mark.parametrize("text", ["", "x"])
def test_prompts_name_missing_evidence(spark, text):
    row = spark.createDataFrame([("t", "d", "low", None, "text", [])], "a string, b string, c string, p string, e string, v array<string>")
    prompt = row.select(judging.judge_prompt(*(F.col(c) for c in ("a", "b", "c", "p", "e", "v")))).first()[0]
    assert "(no evidence)" in prompt and "File: (none)" in prompt
