"""Leakage, packing, responses, subjects and hand-written files."""

import json
import re

import numpy as np
import pytest

from lodestrata.llm import handwritten, leakage, packing, responses, subjects

DOCS = "doc_id long, text string, part string, tokens string, item_id string, subject string"


def doc(i, text):
    return (i, text, "clash", "clash", "clash", "clash")


# --- leakage ---


def brute(documents, items, n=13):
    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    owners = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, *_ in documents:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in owners.get(tuple(w[k : k + n]), ())}
    return {x for x in out if x[0] is not None}


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["ab", "Été", "x1", "straße", "the", "the", "fault", "q"]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(5, 60))))) for i in range(30)] + [(99, None), (98, ""), (97, items_text := "one two " * 10)]
    docs = []
    for d in range(200):
        text = " ".join(rng.choice(vocabulary, int(rng.integers(0, 50))))
        if d % 3 == 0:
            source = items[int(rng.integers(0, 30))][1].split()
            a = int(rng.integers(0, max(1, len(source) - 12)))
            text += "\n" + ", ".join(source[a : a + int(rng.integers(10, 20))]).upper() + " end"
        docs.append(doc(d, text))
    docs += [doc(500, None), doc(501, ""), doc(None, items_text), doc(502, "pad " * 100000 + items_text), doc(503, "one_two " * 30), doc(503, "one_two " * 30)]
    got = [tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert set(got) == brute(docs, items) and (503, 97) in set(got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(spark.createDataFrame(docs, DOCS), none).count() == 0
    assert leakage.leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_a_full_filter_and_shift_table_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHIFTS", 64)
    monkeypatch.setattr(leakage, "FILTER_BITS", 256)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(60)]
    docs = [doc(i, "lead " * (i % 7) + " ".join(items[i % 60][1].split()[i % 20 : i % 20 + 14])) for i in range(120)] + [doc(500, "other words " * 50)]
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i % 60) for i in range(120)} == brute(docs, items)


def test_tables_do_not_grow_with_the_items(spark):
    few, many = (spark.range(n).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 40), k -> concat('w', cast(hash(id, k) as string)))) as text") for n in (50, 20000))
    sizes = []
    for items in (few, many):
        made = leakage.tables(items, leakage.patterns(items, 13), 13)
        sizes.append((len(made.shifts), len(made.bits) * 64))
    assert sizes[0][0] == sizes[1][0] == leakage.SHIFTS and sizes[1][1] <= leakage.FILTER_BITS


# --- packing ---


def test_packing_covers_every_token_once(spark):
    rng = np.random.default_rng(1)
    rows = [doc(i, " ".join("word" for _ in range(int(n)))) for i, n in enumerate(rng.choice([3, 40, 90, 300, 700, 1500, 5000], 300))]
    rows += [doc(900, None), doc(901, ""), doc(None, "a"), doc(902, "a b"), doc(902, "a b")]
    table = spark.createDataFrame(rows, DOCS)
    sizes = packing.token_counts(table).toPandas().groupby("doc_id").tokens.sum()
    got = packing.pack(table, shard_tokens=100_000).toPandas()
    assert got.groupby("doc_id").tokens.sum().to_dict() == {k: v for k, v in sizes.items() if v}
    fill = got.groupby("container_id").tokens.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.9
    split = got[got.doc_id != 902].groupby("doc_id").part.nunique()
    assert all(sizes[d] > 2048 for d in split[split > 1].index)
    assert not got.duplicated(["container_id", "window", "place"]).any()
    assert (got.groupby(["container_id", "window"]).tokens.sum() <= got.groupby(["container_id", "window"]).window_size.first()).all()
    assert got.groupby("container_id").step_group.nunique().max() == 1
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_every_tier_shapes_the_packing():
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(20, 400, 4000), rng.integers(520, 900, 500), rng.integers(1100, 2049, 300)])
    results = {}
    for tiers in ([2048, 1024, 512], [2048, 1024], [2048, 512], [2048]):
        where, kinds = packing.windows(sizes, tiers)
        used = np.bincount(where, weights=sizes)
        assert (used <= kinds).all() and len(used) == len(kinds) and (where >= 0).all()
        boxes = packing.containers(kinds, used, 2048)
        assert np.bincount(boxes, weights=kinds).max() <= 2048
        results[tuple(tiers)] = (sorted(kinds.tolist()), where.tolist(), len(set(boxes.tolist())))
    assert all(r[2] <= 1.02 * results[(2048,)][2] for r in results.values())
    assert len({str(r[0]) for r in results.values()}) == 4  # no tier can be left out without another result
    kinds = results[2048, 1024, 512][0]
    assert {512, 1024, 2048} == set(kinds)


def test_short_items_only_fill_gaps_of_long_windows():
    where, kinds = packing.windows(np.array([1500, 548, 300, 600, 424, 180]), [2048, 1024, 512])
    assert kinds[where].tolist() == [2048, 2048, 2048, 1024, 1024, 2048]  # 300 and 180 alone would leave a window of 512 too empty
    where, kinds = packing.windows(np.array([1500, 548, 300, 600, 424, 210]), [2048, 1024, 512])
    assert kinds[where].tolist() == [2048, 2048, 512, 1024, 1024, 512]


def test_step_groups_have_one_layout_and_even_cost():
    rng = np.random.default_rng(3)
    cost, layout = rng.integers(100, 4000, 400).astype(float), rng.choice([512, 1024, 2048], 400)
    groups = packing.balanced(cost, layout, 8)
    for kind in (512, 1024, 2048):
        sums = [cost[groups == g].sum() for g in set(groups[layout == kind].tolist())]
        members = [int((groups == g).sum()) for g in set(groups[layout == kind].tolist())]
        assert max(members) <= 8 and max(members) - min(members) <= 1
        assert max(sums) / (sum(sums) / len(sums)) < 1.2
    assert all(len(set(layout[groups == g].tolist())) == 1 for g in set(groups.tolist()))


# --- responses ---

ASK = "Decide whether the scanner is right and answer with one JSON object holding is_real and reasoning.\n\nItem: helper is too long\nDetails: the helper has ninety lines of the same code\n"
ASK_DE = "Entscheide, ob der Scanner mit diesem Eintrag recht hat, und antworte mit einem JSON-Objekt.\n\nItem: helper is too long for the rest of it\n"
GOOD = '{"is_real": true, "reasoning": "The helper is not as long as the report says."}'


@pytest.mark.parametrize(
    ("prompt", "response", "defect"),
    [
        (ASK, GOOD, None), (ASK, f"Here is my judgment:\n```json\n{GOOD}\n```", None), (ASK, None, "empty"), (ASK, " \n", "empty"), (ASK, "```json\n```", "empty"), (ASK, "N/A", "empty"),
        (ASK, '{"is_real": null, "reasoning": ""}', "empty"), (ASK, GOOD[:-12], "truncated"), (ASK, GOOD[:-12] + '"}', "truncated"), (ASK, f"```json\n{GOOD}", "truncated"),
        (ASK, "The helper is fine. It only loo", "truncated"), (ASK, "The helper is fine. It only looks…", "truncated"), (ASK, "I'm sorry, but I can't help with that.", "refusal"),
        (ASK, '{"is_real": null, "reasoning": "I cannot assist with this request."}', "refusal"), (ASK, "I cannot reproduce the drift, so it looks spurious.", None),
        (ASK, "The request is refused by the archive, which is the intended outcome.", None), (ASK, ASK, "copied_prompt"), (ASK, "> " + ASK.replace("\n", "\n> "), "copied_prompt"),
        (ASK, ASK.split("\n\n", 1)[1].upper(), "copied_prompt"), (ASK, json.dumps({"summary": ASK.split("\n\n", 1)[1]}), "copied_prompt"), (ASK, ASK.split("\n\n", 1)[1] + "\n" + GOOD + " It is what the code says and nothing else in here.", None),
        (ASK, "Der Befund betrifft nur den Testcode und ist daher gering.", "other_language"), (ASK_DE, "Der Befund betrifft nur den Testcode und ist daher gering.", None),
        (ASK_DE, "The finding is only about the code of a test.", "other_language"), (ASK, "O achado só aparece nos testes e por isso não pesa.", "other_language"), (None, GOOD, None), (ASK, "No.", None),
        (ASK, "Эта находка относится только к тестовому коду и поэтому не важна.", "other_language"), (ASK, "这个问题只出现在测试代码中,因此并不重要。", "other_language"), (ASK, "この指摘はテストコードだけに関するものなので重要ではありません。", "other_language"),
        (ASK, "Bu bulgu sadece test kodu için geçerli ve bu yüzden çok önemli değil.", "other_language"), (ASK, "The label 'тест' is right as it is, and the scanner is wrong.", None),
    ],
)
def test_defects(prompt, response, defect):
    rule, how, _ = responses.judged(prompt, response)
    got = rule if rule in ("empty", "copied_prompt", "refusal") else "truncated" if how == "broken" else rule
    assert got == defect


def test_log_defects(spark):
    schema = "id long, model string, tokens_generated long, prompt string, response string, rule string, core string"
    rows = [(1, "m", 9, ASK, GOOD, "x", "y"), (1, "m", 9, ASK, GOOD, "x", "y"), (2, None, None, None, None, "x", "y"), (2, None, None, None, None, "x", "y"), (None, "m", 1, ASK, None, "x", "y"), (3, "m", 5, ASK, "word " * 100000 + "end", "x", "y")]
    rows += [(4, "m", 5, ASK, "- the first point (of two)\n- the second point (", "x", "y"), (5, "m", 5, ASK, "- the first point (of two)\n- the second point (of them) holds.", "x", "y")]
    got = {tuple(r) for r in responses.defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, "empty"), (3, "truncated"), (4, "truncated")}
    assert responses.defects(spark.createDataFrame([], schema)).count() == 0


def test_shortened_versions_across_ranges(spark):
    texts = [f"t{i:04d} and more" for i in range(300)] + [f"t{i:04d}" for i in range(0, 300, 7)]
    table = spark.createDataFrame([(t,) for t in texts], "core string")
    got = {r["core"] for r in responses._shortened(table, table).collect()}
    assert got == {f"t{i:04d}" for i in range(0, 300, 7)}


def test_length_limits(spark):
    rows = [("m", t) for t in range(20, 120)] * 2 + [("m", 512)] * 60 + [("m", 900)]
    got = [tuple(r)[:2] for r in responses._spikes(spark.createDataFrame(rows, "model string, tokens long")).collect()]
    assert got == [("m", 512)]


# --- subjects ---

TOPICS = {"storage": ["the table", "a backup copy", "the migration"], "testing": ["the fixture", "a mock object", "the assertion"]}
SAYS = {"storage": ["locks every row", "leaves orphaned rows behind"], "testing": ["fails one time in twenty", "covers only the happy path"]}


def about(topic, n, rng):
    return " ".join(f"Note that {rng.choice(TOPICS[topic])} {rng.choice(SAYS[topic])}." for _ in range(n))


def test_subjects(spark):
    rng = np.random.default_rng(0)
    examples = spark.createDataFrame([(t, about(t, 4, rng), 7) for t in TOPICS for _ in range(20)] + [(None, "x", 7), ("storage", None, 7)], "subject string, text string, doc_id long")
    filler = "Thanks to everyone who sent remarks. No decisions were taken."
    rows, want = [], set()
    for i in range(60):
        kind = i % 4
        text = about("storage", 3, rng) if kind == 0 else about("storage", 3, rng) + "\n\n- " + about("testing", 4, rng).replace(". ", ".\n- ") if kind == 1 else filler if kind == 2 else about("testing", 4, rng) + " This has nothing to do with the table raised last week."
        rows.append(doc(i, text))
        want |= {(i, s) for s in ({0: ["storage"], 1: ["storage", "testing"], 2: [], 3: ["testing"]}[kind])}
    rows += [doc(100, None), doc(101, ""), doc(None, rows[0][1]), doc(102, "# Heading\n\n" + about("testing", 20000, rng))]
    got = {tuple(r) for r in subjects.subjects_of(spark.createDataFrame(rows, DOCS), examples).collect()}
    assert got == want | {(102, "testing")}
    assert subjects.subjects_of(spark.createDataFrame([], DOCS), examples).count() == 0
    assert subjects.subjects_of(spark.createDataFrame(rows, DOCS), examples.limit(0)).count() == 0


# --- hand-written files ---

FILES = "repo_path string, file_path string, content string, said string, place string, digits string"


def test_not_handwritten(spark):
    code = "import os\n\n\ndef load(path):\n    # reads it\n    with open(path) as f:\n        return f.read()\n\n\nclass Box:\n    def get(self, key):\n        if key is None:\n            raise ValueError('late')\n        return self.data[key]\n"
    rng = np.random.default_rng(3)
    packed = ["!function(e,t){" + "".join(f"if(!{chr(97 + int(a))})throw Error({int(b)});" for a, b in rng.integers(1, 25, (400, 2))) + "}" for _ in range(12)]
    rows = [("r", f"src/a{i}.py", code + f"\n\ndef f{i}(a, b):\n    return a + {i} * b\n" * (1 + i % 5)) for i in range(60)]
    cases = [("r", f"web/x{i}.min.js", p) for i, p in enumerate(packed[:8])] + [("r", f"src/y{i}.js", p) for i, p in enumerate(packed[8:])]
    cases += [("r", "node_modules/a/b.js", code), ("r", "src/api_pb2.py", code), ("r", "src/g.py", "# Code generated by x-gen. DO NOT EDIT.\n" + code), ("r", "src/v.go", "// Copied from box 1.2.3, see upstream for changes.\npackage a\n")]
    cases += [("r", "src/data.py", "TABLE = [\n" + "    [1.25, -3.5, 7.125],\n" * 200 + "]\n")]
    rows += [("r", "src/vendor_portal/a.py", code), ("r", "src/h.py", "# Replaces the client that used to be generated by x; maintained by hand since.\n" + code), ("r", "src/s.py", code + "BANNER = 'Code generated by x. DO NOT EDIT.'\n"), ("r", "docs/a.md", "# Generated by hand\n\ntext"), ("r", None, code), (None, "src/z.py", None), ("r", "e.py", "")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + cases], FILES)
    got = {(r["repo_path"], r["file_path"]) for r in handwritten.not_handwritten(table).collect()}
    assert got == {r[:2] for r in cases}
    assert handwritten.not_handwritten(spark.createDataFrame([], FILES)).count() == 0


def test_notices_speak_of_their_own_file():
    for head in ("# Do not change the order of these imports", "// This module writes generated from templates", "# imported from the settings module at start", "# Checks code generated by others."):
        assert handwritten.notice(head) is None, head
    for head in ("# DO NOT EDIT.", "// Do not edit this file", "# Do not edit by hand", "/* generated by x-gen 1.2 */", "# Do not modify: changes are lost"):
        assert handwritten.notice(head) == "written", head
    for head in ("# Imported unchanged from box", "// imported from https://example.org/box", "# imported from box 1.2"):
        assert handwritten.notice(head) == "copied", head


def test_looks_are_learnt_from_notices(spark):
    rng = np.random.default_rng(5)
    body = lambda: "".join(f"def f{int(i)}(path, key):\n    # reads {int(i)} again\n    return path.open(key) if key else None\n\n\n" for i in rng.integers(0, 99, 4 + int(rng.integers(0, 9))))
    flat = lambda: "".join(f"reg({chr(97 + int(i))}, {chr(97 + int(j))})\n" for i, j in rng.integers(0, 26, (90 + int(rng.integers(0, 99)), 2)))
    hand = [("r", f"src/h{i}.py", body()) for i in range(60)]
    told = [("r", f"src/t{i}.py", "# Code generated by x-gen. DO NOT EDIT.\n" + flat()) for i in range(12)]
    told += [("r", f"src/u{i}.py", "# Code generated by x-gen. DO NOT EDIT.\n" + body()) for i in range(3)]  # look like the others
    untold = [("r", f"src/w{i}.py", flat()) for i in range(4)]
    files = spark.createDataFrame([(*r, "x", "y", "z") for r in hand + told + untold], FILES)
    got = {r["file_path"]: r["reason"] for r in handwritten.not_handwritten(files).collect()}
    assert got == {r[1]: "written" for r in told} | {r[1]: "looks" for r in untold}


def test_files_of_one_literal():
    words = ["heap", "inbox", "fragment", "frame", "compiler", "pointer"]
    table = "WEIGHTS = {\n" + "".join(f'    "{words[i % 6]}_{i}": {7919 * (i + 60)},\n' for i in range(60)) + "}\n"
    measured = dict(zip(handwritten.FEATURES, handwritten.features(table)))
    assert measured["literal"] < 0.9 and handwritten.unquoted(table) < 0.05
    held = "import os\n\n\ndef load(path):\n    return os.path.join(path, TEXT)\n\n\nTEXT = '" + "fragment, driver, concern, port, " * 14 + "'\n"  # code around a long text
    assert handwritten.features(held)[handwritten.FEATURES.index("literal")] >= 0.9 and handwritten.unquoted(held) > 0.05
    assert handwritten.unquoted("def load(path):\n    return 'a long text ' + path\n") > 0.3 and handwritten.unquoted(" ") == 1
