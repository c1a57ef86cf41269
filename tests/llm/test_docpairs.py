import ast

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, lexing, splitting

SCHEMA = "file_id long, file_path string, language string, content string, name string, kind string, line int, depth int"

PY = '''"""Module text."""
import x

S = """
def fake():
    \\"\\"\\"Looks like one.\\"\\"\\"
    return 1
"""


@wrap(
    1,
)
async def outer(a: int, b="):"):
    r"""Keeps the lease in step.

    Args:
        a: the first one
    """
    def inner():
        \'\'\'Raises when the pool is cold.\'\'\'
        return {"a": [1, 2]}
    return inner


class Box:
    """A box."""

    def get_box(self):
        """Gets the box."""
        return 1

    def put(self):
        """:param box: """
        return 2

    def only(self):
        """Documentation alone is no body."""


# Comment above, not a docstring
def plain():
    return 1


def open_ended(
'''

JS = """/** File text. */
import a from 'b';

const text = `
/** Template text. */
function fake() { return `${"nested {"}`; }
`;

/**
 * Sorts by the late key.
 * @param {string} a
 */
export default async function sortBy(a, {b = ")"} = {}) {
  const r = /[{"'`]/g; // not a string
  return a / b;
}

/** Doubles every one of them twice. */
export const twice = async (x) => x.map(y => y * 2);

/** Not directly above. */

const apart = () => { return 1; };

class Box extends Base {
  /** Reads from the far side. */
  static async read(key) { if (key) { return 1; } return 2; }
  /** @returns {object} */
  plain() { return 1; }
  /** Too late for the abstract one. */
  handler = () => 1;
}
"""

GO = """// Package text.
package a

// Open opens the late
// door for everyone.
//go:noinline
func Open(a string) error {
	s := `raw { "string`
	return nil
}

//go:noinline
func Bare() { return }

// Close closes.
func (b *Box) Close() error { return nil }

// Tears down whatever remains.
func (b *Box) Tear() error { return nil }
"""


def test_functions_of_all_languages(spark):
    rows = [(1, "a.py", None, PY, *"xx", 1, 1), (2, "b.ts", "javascript", JS, *"xx", 1, 1), (3, "c.go", None, GO, *"xx", 1, 1)]
    rows += [(4, "d.py", None, None, *"xx", 1, 1), (5, "e.py", None, "", *"xx", 1, 1), (6, "f.rs", None, "fn a() {}", *"xx", 1, 1), (None, "g.py", None, PY, *"xx", 1, 1), (7, None, None, PY, *"xx", 1, 1)]
    rows += [(8, "h.py", None, "﻿" + PY.replace("\n", "\r\n"), *"xx", 1, 1)]
    pairs = docpairs.docstring_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r["file_id"], r["name"], r["line_start"]) for r in pairs}
    py = {("outer", 14), ("inner", 20)}
    want = {(i, *x) for i in (1, 8) for x in py} | {(2, "sortBy", 13), (2, "twice", 19), (2, "read", 27), (3, "Open", 7), (3, "Tear", 19)}
    assert got == want
    code = next(r["code"] for r in pairs if (r["file_id"], r["name"]) == (1, "outer"))
    assert code.startswith("@wrap(") and code.rstrip().endswith("return inner")


def test_empty(spark):
    assert docpairs.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_file(spark):
    text = "".join(f'def f{i}():\n    """Raises when the pool {i} is cold."""\n    return {i}\n\n\n' for i in range(3000))
    assert docpairs.found(spark.createDataFrame([(1, "a.py", None, text, "", "", 0, 0)], SCHEMA)).count() == 3000


@pytest.mark.parametrize(
    ("name", "doc", "expected"),
    [
        ("load_box", "Loads the box.", False), ("load_box", "Loading boxes", False), ("load_box", "Loads the box lazily.", True), ("load_box", "TODO: document this.", False),
        ("load_box", "-----", False), ("load_box", "Parameters\n----------\nbox : str\n", False), ("load_box", "Parameters\n----------\nbox : str\n    The late one.\n", True),
        ("load_box", ":param box:\n:returns: int of it", True), ("loadBox", "/** @param {string} box */", False), ("loadBox", "/** @param {string} box the wide one */", True), ("x", "", False),
        ("trim_all", "Trimmed", False), ("f", "Fast.", True),
    ],
)
def test_trivial_documentation(name, doc, expected):
    assert docpairs.described(name, doc) is expected


def test_python_structure_agrees_with_the_parser():
    found = [(t[1], t[2]) for t in lexing.structure(PY.rsplit("def open_ended", 1)[0], "python") if t[0] == "f"]
    tree = ast.parse(PY.rsplit("def open_ended", 1)[0])
    assert sorted(found) == sorted((n.name, n.lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef))


ITEMS = "item long, path string, declared string, content string, n int, part int"


def filler(n):
    return "".join(f"    value_{i} = {i}\n" for i in range(n))


def test_units_start_with_their_comments(spark):
    py = "x = 1\n" + filler(400) + "# note\n@deco(\n  1)\ndef a():\n    pass\n\n'''\ndef no():\n'''\nclass B:\n    def m(self): pass\n"
    js = "x();\n" + "// pad\n" * 1200 + "\n/**\n   text\n */\nexport const f = (a,\n b) => {\n}\n`\nfunction no() {}\n`\nif (a) {\nfunction nested() {}\n}\nclass C {}\n"
    go = "package a\n" + "// pad\n" * 1200 + "\n// T text\ntype T struct {\n}\n\nvar a = `\nfunc no() {}\n`\nfunc F() {}\n"
    md = "# One\n" + "text\n" * 1500 + "```sh\n# no\n```\n## Two\n"
    rows = [(1, "a.py", None, py, 0, 0), (2, "b.js", None, js, 0, 0), (3, "c.go", None, go, 0, 0), (4, "d.md", None, md, 0, 0), (5, "e.txt", None, "a\n" * 4000, 0, 0), (6, "f.py", None, "def a(): pass\n", 0, 0), (7, "g.py", None, None, 0, 0), (None, "h.py", None, py, 0, 0)]
    items = spark.createDataFrame(rows, ITEMS)
    want = {(1, 401), (1, 410), (2, 1202), (2, 1213), (3, 1202), (3, 1209), (4, 1504), (5, -1)}
    lines = py.split("\n")
    assert lines[401] == "# note" and lines[410] == "class B:"
    got = {tuple(r) for r in splitting.cut_lines(items).collect()}
    assert {x for x in got if x[0] in (1, 4, 5)} == {x for x in want if x[0] in (1, 4, 5)}
    for item, text, starts in ((2, js, ("/**", "class C")), (3, go, ("// T", "func F"))):
        own = sorted(line for i, line in got if i == item)
        assert [text.split("\n")[n][: len(s)] for n, s in zip(own, starts, strict=True)] == list(starts)
    assert got == {tuple(r) for r in splitting.cut_lines(items, size=3000).collect()}


def test_pieces_round_trip(spark):
    texts = {1: "".join(f"def f{i}():\n    return '{'x' * (i % 70)}'\n\n" for i in range(600)), 2: "y" * 20000, 3: "short\n" * 2 + "z" * 9000 + "\nend", 4: "\n" * 7000}
    items = spark.createDataFrame([(i, "a.py", None, t, 0, 0) for i, t in texts.items()], ITEMS)
    rows = splitting.split(items).collect()
    for i, text in texts.items():
        cut = sorted((r["begin"], r["end"], r["first_line"], r["last_line"]) for r in rows if r["item"] == i)
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        assert all(0 < e - b <= 6000 for b, e, _, _ in cut)
        assert all(b2 <= e1 < e2 for (_, e1, _, _), (b2, e2, _, _) in zip(cut, cut[1:]))
        assert all(text.count("\n", 0, b) == f for b, _, f, _ in cut)
    one = [r for r in rows if r["item"] == 1]
    assert all(texts[1][r["begin"] :].startswith("def") or r["begin"] == 0 or r["first_line"] > 0 for r in one)


def test_split_empty(spark):
    assert splitting.split(spark.createDataFrame([], ITEMS)).count() == 0
    assert splitting.cut_lines(spark.createDataFrame([], ITEMS)).count() == 0


def test_arrow_functions_of_any_signature(spark):
    long = "export const f = (\n" + "".join(f"  parameter{i}: string, // of (many\n" for i in range(300)) + ") => {\n}\n"
    ts = "x();\n" + long + "const g = (a: string): { a: string } => {\n}\nconst h = async (a: A): Promise<{ b: B; c: C }> => {\n}\nconst no = (a + b) * 2;\nconst nor = (a)(b => c);\n"
    rows = [(1, "a.ts", None, ts, 0, 0), (2, "b.ts", None, ts, 0, 0)]
    assert len(long) > 8000
    at = [n for n, line in enumerate(ts.split("\n")) if line.startswith(("export const f", "const g", "const h"))]
    got = sorted(tuple(r) for r in splitting.cut_lines(spark.createDataFrame(rows, ITEMS)).collect())
    assert got == [(i, n) for i in (1, 2) for n in at]


def giant(n):
    """A Python text with long strings that hold definitions, so that ranges begin within them."""
    out = []
    for i in range(n):
        out.append(f"# above {i}\n@mark({i})\ndef f{i}(a, b):\n    text = \"\"\"\n" + f"def no{i}(): pass\n" * (i % 40) + '    """\n    return (a,\n            b)\n\n\n')
        if i % 9 == 0:
            out.append(f"class C{i}:\n" + "    x = 1\n" * 30 + "\n")
    return "".join(out)


def test_giant_items_are_stitched_in_blocks(spark, monkeypatch, tmp_path):
    text = giant(400)
    items = spark.createDataFrame([(1, "a.py", None, text, 0, 0), (2, "b.py", None, "y = 1\n" * 3000, 0, 0), (3, "c.js", None, "z" * 50000, 0, 0)], ITEMS)
    want = {tuple(r) for r in splitting.cut_lines(items, size=1 << 22).collect()}
    assert len(want) > 400 and (2, -1) in want and (3, -1) in want
    monkeypatch.setattr(splitting, "BLOCK", 3)
    assert {tuple(r) for r in splitting.cut_lines(items, size=5000).collect()} == want
    rows = sorted(tuple(r) for r in splitting.split(items, size=5000).collect())
    assert len({r[:2] for r in rows}) == len(rows)
    for item, content in ((1, text), (2, "y = 1\n" * 3000), (3, "z" * 50000)):
        own = [r for r in rows if r[0] == item]
        assert [r[1] for r in own] == list(range(len(own)))
        assert own[0][2] == 0 and own[-1][3] == len(content) and all(0 < e - b <= 6000 for _, _, b, e, _, _ in own)
        assert all(p[2] < q[2] <= p[3] < q[3] for p, q in zip(own, own[1:]))
        for _, _, b, e, first, last in own:
            assert content[:b].count("\n") == first and content[: max(b, e - 1)].count("\n") == last
    (tmp_path / "a.py").write_text(text)
    files = spark.createDataFrame([(1, f"file://{tmp_path}/a.py", "a.py", None, len(text))], "item long, uri string, path string, declared string, bytes long")
    cut = splitting.file_slices(files, 6000, 5000)
    assert {tuple(r) for r in splitting.cut_lines_of(cut).collect()} == {r for r in want if r[0] == 1}
    assert sorted(tuple(r) for r in splitting.split_of(cut).collect()) == [r for r in rows if r[0] == 1]
    assert cut.select(F.spark_partition_id()).distinct().count() > 1


def test_files_that_are_no_ascii_are_read_by_ranges(spark, tmp_path):
    text = "# é\n\n" + "".join(f"## Überschrift {i} ßß\n\nTëxt — {i}\n\n" for i in range(900))
    (tmp_path / "a.md").write_bytes(text.encode() + b"\xff\xfe end\n")
    size = (tmp_path / "a.md").stat().st_size
    files = spark.createDataFrame([(1, f"file://{tmp_path}/a.md", "a.md", None, size)], "item long, uri string, path string, declared string, bytes long")
    got = {r["line"] for r in splitting.cut_lines_of(splitting.file_slices(files, 6000, 4001)).collect()}
    assert got == {2 + 4 * i for i in range(900)}
