"""JavaScript modules, package manifests and install instructions."""

from lodestrata.operators import scripts
from lodestrata.sources import repository

FILES = "repo_path string, file_path string, content string, name string, line int"


def make(spark, files):
    return spark.createDataFrame([("r", p, c, "clash", 0) for p, c in files.items()], FILES)


A = "export function used() {}\nexport const dead = 1;\nexport default class Shown {}\nfunction inner() {}\nexport { inner as outer, gone$ };\nexport type Kind = string;\nexport let local = 1; local++;\nexport const handler = 1;\n"
B = "import Shown, { used as u,\n  type Kind } from './a';\nimport * as whole from '../lib/whole';\nexport * from './star.js';\nconst x = require('left-pad/sub');\nimport('@scope/pkg/deep');\nimport 'side';\n"


def test_exports_and_imports(spark):
    files = {"src/a.ts": A, "src/b.ts": B, "lib/whole.ts": "export const quiet = 1;\n", "src/star.ts": "export const shine = 1;\n", "src/index.ts": "export const api = 1;\n", "package.json": '{"main": "./src/index.ts"}', "c.py": "export = 1", "d.js": None}
    table = make(spark, files)
    got = {(r["name"], r["line"]) for r in scripts.exports(table).filter("file_path = 'src/a.ts'").collect()}
    assert got == {("used", 1), ("dead", 2), ("Shown", 3), ("outer", None), ("gone$", None), ("Kind", 6), ("local", 7), ("handler", 8)}
    mods = {(r["module"], r["name"]) for r in scripts.imports(table).filter("file_path = 'src/b.ts'").collect()}
    assert mods == {("./a", "Shown"), ("./a", "used"), ("./a", "Kind"), ("../lib/whole", "*"), ("./star.js", "*"), ("left-pad/sub", ""), ("@scope/pkg/deep", ""), ("side", "")}
    assert sorted(r["title"] for r in scripts.dead_exports(table).collect()) == ["Unused export: dead", "Unused export: gone$", "Unused export: outer"]


def test_unused_packages(spark):
    manifest = '{"dependencies": {"left-pad": "1", "@scope/pkg": "1", "lonely": "2"}, "devDependencies": {"jest": "1", "eslint-plugin-x": "1", "side": "1"}}'
    found = scripts.unused_packages(make(spark, {"package.json": manifest, "sub/package.json": "{broken", "src/b.ts": B}))
    assert [r["title"] for r in found.collect()] == ["Unused dependency: lonely"]


def test_dependency_drift(spark):
    doc = "pip install outside\n```sh\npip install -e . Known_Pkg 'other[x]>=2' # note extra\nnpm install drifted own-name\n```\n"
    lines = repository.numbered_lines(make(spark, {"README.md": doc, "notes.md": doc}))
    actual = spark.createDataFrame([("r", "known.pkg")], "repo_path string, package string")
    own = spark.createDataFrame([("r", "own_name")], "repo_path string, name string")
    assert sorted(r["title"] for r in scripts.dependency_drift(lines, actual, own).collect()) == ["Dependency drift: `drifted` in docs but not in project", "Dependency drift: `other` in docs but not in project"]
    assert scripts.dependency_drift(lines, actual.limit(0), own).count() == 0


def test_empty(spark):
    rows = spark.createDataFrame([], FILES)
    assert scripts.dead_exports(rows).count() == 0 and scripts.unused_packages(rows).count() == 0
