"""Detectors and sources on small repositories."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import detectors, extract
from lodestrata.sources import repository

FILES = "repo_path string, file_path string, content string, line int, kind string"


def make(spark, files):
    return spark.createDataFrame([(r, p, c, 0, "clash") for r, p, c in files], FILES)


def lines_of(spark, files):
    return repository.numbered_lines(make(spark, files))


def titles(found):
    return sorted(r["title"] for r in found.collect())


def test_markers(spark):
    code = "\n".join([
        "x = 1  # TODO: first thing", "# should find TODOs far away from here: TODO no", "print('# TODO in a string')", "// FIXME(bob) handle it HACK second", "/* XXX */", "# todo-list is a word", "# TODO", "y = 2 -- hack lower",
    ])
    md = "# TODO heading\n<!-- TODO: hidden note -->\n* XXX item\n"
    found = detectors.markers(lines_of(spark, [("r", "a.py", code), ("r", "b.md", md), ("r", "c.py", None), ("r", "d.py", "")]))
    got = {(r["file_path"], r["line_start"], r["title"], r["severity"]) for r in found.collect()}
    assert got == {
        ("a.py", 1, "TODO: first thing", "low"), ("a.py", 4, "FIXME: bob) handle it", "medium"), ("a.py", 5, "XXX: */", "high"), ("a.py", 7, "TODO: (no description)", "low"), ("a.py", 8, "HACK: lower", "high"), ("b.md", 2, "TODO: hidden note", "low"),
    }


def test_stale_links_and_paths(spark):
    doc = "[a](../src/a.py) [b](src/gone.py#x) [c](https://x.y) [d](#here) [e](../../out.md)\n```\n[f](nope.md)\n```\nsee `src/a.py`, `a.py`, `store/gone.py`, `pkg/a.py`, `next/dynamic`, e.g. `src/example.py`, ~~`src/old.py`~~\n"
    files = [("r", "docs/x.md", doc), ("r", "src/pkg/a.py", "1"), ("r", "src/a.py", "1"), ("other", "src/gone.py", "1")]
    lines, rows = lines_of(spark, files), make(spark, files)
    assert titles(detectors.stale_links(lines, rows)) == ["Stale link: [b](src/gone.py#x)", "Stale link: [e](../../out.md)"]
    clean = lines_of(spark, [("r", "docs/x.md", "see `src/a.py`, `store/gone.py`, `pkg/a.py`, `next/dynamic`\n")])
    assert titles(detectors.stale_inline_paths(clean, rows)) == ["Stale path reference: store/gone.py"]


def test_ci_paths(spark):
    flow = "steps:\n  - uses: ./act/here\n  - uses: ./act/gone\n  - uses: a/b@v1\n    working-directory: src\n    path: 'lost'\n    file: ${{ x }}\n    path: a/*.txt\n"
    docker = "FROM x\nCOPY a.txt /x\nADD --chown=1:1 gone.txt /y\nCOPY --from=b z /z\nCOPY . .\nCOPY $V /v\nCOPY *.c /c\nADD https://x /x\n"
    files = [("r", ".github/workflows/a.yml", flow), ("r", "act/here/x", ""), ("r", "src/b", "1"), ("r", "img/Dockerfile", docker), ("r", "img/a.txt", "1")]
    assert titles(detectors.stale_ci_paths(lines_of(spark, files), make(spark, files))) == ["Stale COPY/ADD source reference: gone.txt", "Stale local action reference: ./act/gone", "Stale path reference: lost"]


def test_env_drift(spark):
    files = [
        ("r", ".env.example", "# note\nUSED=1\nUNUSED\nPATH=x\nbad line\n"), ("r", "env.sample", "LATER=1\n"), ("r", "a.py", "os.environ['USED']; os.getenv( \"EXTRA\")\nos.environ.get('HOME')"),
        ("r", "b.ts", "process.env.JS_ONE + process.env['JS_TWO']"), ("q", "a.py", "os.getenv('ALONE')"),
    ]
    found = detectors.env_drift(lines_of(spark, files))
    assert titles(found) == ["Documented env var never used: UNUSED", "Undocumented env var: EXTRA", "Undocumented env var: JS_ONE", "Undocumented env var: JS_TWO"]
    assert {r["file_path"] for r in found.collect()} == {".env.example"}


def test_unused_dependencies(spark):
    toml = '[project]\nname = "x"\ndependencies = [\n  "requests>=2", "PyYAML",\n  "left-pad[x]~=1",\n]\n[project.optional-dependencies]\ndev = ["pytest-cov", "attrs"]\n[tool.poetry.dependencies]\npython = "3"\nclick = "^8"\n'
    files = [("r", "pyproject.toml", toml), ("r", "requirements.txt", "# c\n-r x\nnumpy==1\nrequests\n"), ("r", "a.py", "import requests.sessions\nfrom yaml import x\nfrom . import click\n")]
    facts = extract.facts(make(spark, files))
    declared = detectors.declared_dependencies(lines_of(spark, files))
    assert titles(detectors.unused_dependencies(declared, extract.imports(facts))) == ["Unused dependency: attrs", "Unused dependency: click", "Unused dependency: left-pad", "Unused dependency: numpy"]


def test_complexity_and_facts(spark):
    branchy = "def f(a):\n" + "".join(f"    if a == {i} and a:\n        pass\n" for i in range(6)) + "    return a\n"
    long = "class C:\n    def g(self):\n" + "        x = 1\n" * 101
    files = [("r", "src/a.py", branchy), ("r", "src/b.py", long), ("r", "tests/test_a.py", branchy), ("r", "broken.py", "def ("), ("r", "n.py", None)]
    found = {(r["file_path"], r["severity"], r["confidence"]) for r in detectors.complex_functions(extract.facts(make(spark, files))).collect()}
    assert found == {("src/a.py", "low", 0.95), ("src/b.py", "medium", 0.95), ("tests/test_a.py", "low", 0.6)}


def test_dead_symbols(spark):
    files = [
        ("r", "src/pkg/a.py", "def used(): pass\ndef dead(): pass\ndef _own(): pass\nLIMIT = 1\nOTHER = 2\ndef inner(): return OTHER\nclass Gone: pass\ndef main(): pass\n"), ("r", "src/pkg/b.py", "from pkg.a import used, LIMIT as L, inner\n"),
        ("r", "src/whole.py", "def quiet(): pass\n"), ("r", "c.py", "import whole\n"), ("r", "d.py", "__all__ = ['listed']\ndef listed(): pass\ndef unlisted(): pass\n"), ("q", "x.py", "from pkg.a import dead\n"),
    ]
    assert titles(detectors.dead_symbols(extract.facts(make(spark, files)))) == ["Unused class: Gone", "Unused constant: LIMIT", "Unused function: dead", "Unused function: listed"]


def test_layers(spark):
    files = [("r", "src/app/store/db.py", "from app.web import view\nfrom ..util import x\nimport app.shared.log\n"), ("r", "src/app/web/view.py", "from app.store import db\nfrom app import secret\n")]
    edges = detectors.import_edges(extract.facts(make(spark, files)))
    assert ("app.store.db", "app.util") in {(r["source"], r["target"]) for r in edges.collect()}
    found = detectors.layer_violations(edges, ["app.web", "app.store"], ["app.shared"], [("app.web", "app.store")])
    assert titles(found) == ["Forbidden import: app.web.view -> app.store", "Layer violation: app.store.db -> app.web"]
    assert detectors.layer_violations(edges, []).count() == 0


def test_hotspots(spark):
    log = [("r", f"@commit@ann\tfix: crash {i}") for i in range(20)]
    rows, n = [], 0
    for r, head in log:
        for text in (head, "src/hot.py", *(f"src/cold{n % 9}.py",), ""):
            rows.append((r, n, text))
            n += 1
    commits = repository.git_log(spark.createDataFrame(rows, "repo_path string, n long, text string"))
    assert commits.count() == 40 and {r["author"] for r in commits.collect()} == {"ann"}
    found = detectors.hotspots(detectors.churn(commits)).collect()
    assert [(r["file_path"], r["severity"]) for r in found] == [("src/hot.py", "medium")]
    assert found[0]["confidence"] == pytest.approx(0.8)


def test_tool_reports(spark):
    one = lambda x: spark.createDataFrame([("r", json.dumps(x)), ("r", "not json"), ("r", None)], "repo_path string, report string")
    ruff = repository.ruff(one([{"code": "F401", "message": "m", "filename": "a.py", "location": {"row": 3}}]))
    assert [tuple(r) for r in ruff.collect()] == [("r", "F401", "m", "a.py", 3, 3, "high")]
    eslint = repository.eslint(one([{"filePath": "a.js", "messages": [{"ruleId": None, "message": "m", "line": 1, "severity": 2}, {"ruleId": "no-eval", "message": "n", "line": 2, "endLine": 4, "severity": 1}]}]))
    assert {(r["code"], r["line_end"], r["severity"]) for r in eslint.collect()} == {("unknown", 1, "medium"), ("no-eval", 4, "high")}
    biome = repository.biome(one({"diagnostics": [{"category": "lint/style/x", "severity": "error", "message": [{"content": "a"}, {"content": "b"}], "location": {"path": {"file": "a.ts"}}}]}))
    assert [(r["message"], r["severity"]) for r in biome.collect()] == [("ab", "medium")]
    assert repository.golangci(one({"Issues": None})).count() == 0
    go = repository.golangci(one({"Issues": [{"Text": "t", "FromLinter": "gosec", "Severity": "", "Pos": {"Filename": "a.go", "Line": 2}}]}))
    assert [(r["code"], r["severity"]) for r in go.collect()] == [("gosec", "high")]
    span = {"is_primary": True, "file_name": "a.rs", "line_start": 1, "line_end": 2}
    message = json.dumps({"reason": "compiler-message", "message": {"level": "warning", "message": "m", "code": {"code": "clippy::suspicious_else"}, "spans": [{**span, "is_primary": False, "line_start": 9}, span]}})
    clippy = repository.clippy(spark.createDataFrame([("r", message), ("r", message), ("r", "{}")], "repo_path string, line string"))
    assert [(r["line_start"], r["severity"]) for r in clippy.collect()] == [(1, "high")]
    audit = repository.pip_audit(one({"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "V-1", "description": "d", "fix_versions": ["2", "3"]}]}]}))
    assert titles(detectors.audited(audit)) == ["V-1: a==1"]
    assert titles(detectors.linted(ruff, "lint-runner")) == ["F401: m"]


def test_files_are_read_without_skipped_folders(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\n", "node_modules/b.js": b"1", "empty.txt": b"", "bad.txt": b"a\xffb", "big.bin": b"x" * 500_001}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["file_path"]: r["content"] for r in repository.files(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a.py": "x = 1\n", "bad.txt": "a�b"}


def test_sections_and_pairs(spark):
    files = [
        ("r", "a.md", "intro\n# One\nsee `src/a.py`\n\n## Two ##\n(lib/none.py)\n"), ("r", "src/a.py", "def load_box(): pass\ndef load(): pass\n"), ("r", "tests/test_a.py", "def test_load_box_twice(): pass\ndef test_other(): pass\n"),
    ]
    cut = detectors.sections(lines_of(spark, files).filter("file_path = 'a.md'"))
    assert {(r["title"], r["level"], r["line_start"], r["line_end"]) for r in cut.collect()} == {("One", 1, 2, 4), ("Two", 2, 5, 6)}
    assert [(r["title"], r["code_path"]) for r in detectors.section_code_pairs(cut, make(spark, files)).collect()] == [("One", "src/a.py")]
    assert [(r["test_name"], r["name"]) for r in detectors.test_implementation_pairs(extract.facts(make(spark, files))).collect()] == [("test_load_box_twice", "load_box")]


def test_everything_on_empty_tables(spark):
    rows = spark.createDataFrame([], FILES)
    lines, facts = repository.numbered_lines(rows), extract.facts(rows)
    for found in (detectors.markers(lines), detectors.stale_links(lines, rows), detectors.stale_inline_paths(lines, rows), detectors.stale_ci_paths(lines, rows), detectors.env_drift(lines), detectors.complex_functions(facts), detectors.dead_symbols(facts)):
        assert found.columns == detectors.FINDING and found.count() == 0


def test_replay(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    recorded = spark.createDataFrame([("a", "yes")], "p string, response string").select(F.substring(F.sha2("p", 256), 1, 16).alias("prompt_hash"), "response")
    assert {(r["id"], r["response"], r["matched"]) for r in detectors.replayed(prompts, recorded).collect()} == {(1, "yes", True), (2, "{}", False)}


def test_intent_artifacts(spark):
    long = 'def load_box():\n    """Loads the box from the far side of it."""\n    a = 1\n    b = 2\n    return a\n'
    files = [("r", "src/a.py", long + "def bare():\n    a = 1\n    b = 2\n    c = 3\n    return a\n"), ("r", "tests/test_a.py", "def test_load_box(): pass\ndef test_load_box_twice(): pass\n"), ("r", "d.md", "# Boxes\nuse `load_box()` first\n")]
    facts = extract.facts(make(spark, files))
    found = detectors.intent_artifacts(facts, detectors.sections(lines_of(spark, files).filter("file_path = 'd.md'"))).collect()
    assert [(r["name"], r["tests"], r["sections"], r["artifacts"]) for r in found] == [("load_box", ["test_load_box", "test_load_box_twice"], ["Boxes"], 4)]
    assert [r["name"] for r in detectors.documented(facts).collect()] == ["load_box"]
