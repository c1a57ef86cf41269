import random

import pytest

from lodestrata.llm import incremental, neardup, wordsets

SCHEMA = "id long, run_id long, fp string, title string, description string, rep string, words string, key string"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def word_sets(rows):
    import re

    return {r[0]: frozenset(re.findall("[a-z0-9]+", f"{r[3] or ''} {r[4] or ''}".lower())) for r in rows}


def corpus(n=160, seed=3):
    """Groups of edited copies around a threshold, with repeated rows and a hot group of copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[4].split()
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.sample(vocabulary, 30)
        rows.append((i + 1, rng.randrange(8), f"f{rng.randrange(120):x}", "Title", " ".join(words), "clash", "clash", "clash"))
    rows += [(1000 + i, 3, None, "Hot", "the very same text in a third of all rows", "x", "y", "z") for i in range(n // 2)]
    return rows


def test_all_pairs_match_brute_force(spark):
    rows = corpus()
    sets = word_sets(rows)
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(sets[a], sets[b]) >= 0.7}
    near = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", ["title", "description"], tenths=7)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)
    classes = {r["id"]: r["rep"] for r in near.per_record().collect()}
    assert set(classes) == set(ids) and len({classes[1000 + i] for i in range(80)}) == 1


def test_nulls_and_blank_texts(spark):
    rows = [(1, 1, None, None, None, *"xyz"), (2, 1, None, None, None, *"xyz"), (3, 1, None, "--", "!", *"xyz"), (4, 1, None, "", "a b", *"xyz"), (5, 1, None, "A", "b", *"xyz"), (None, 1, None, "A", "b", *"xyz"), (6, 1, None, "word " * 200000, None, *"xyz"), (7, 1, None, "word", "", *"xyz")]
    near = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", ["title", "description"], tenths=7)
    assert {tuple(r) for r in near.pairs().collect()} == {(1, 2), (4, 5), (6, 7)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    near = neardup.near_duplicates(empty, "id", ["title", "description"])
    assert near.pairs().count() == 0 and near.per_record().count() == 0
    assert incremental.covered(empty, spark.createDataFrame([], "fp string"), ["title", "description"], "run_id").count() == 0


def sequential(rows, suppressed):
    sets, fps, taken, out = word_sets(rows), set(), [], set()
    for r in sorted(rows, key=lambda r: (-(2**62) if r[1] is None else r[1], r[0])):
        w = sets[r[0]]
        same = any(jaccard(w, sets[t]) >= 0.7 if w or sets[t] else True for t in taken)
        if (r[2] is not None and (r[2] in suppressed or r[2] in fps)) or same:
            out.add(r[0])
        else:
            taken.append(r[0])
            fps.add(r[2])
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_acceptance_matches_one_by_one(spark, batches):
    rows = corpus(120, seed=9)
    rows = [(i, None if i % 17 == 0 else b, *rest) for i, b, *rest in rows]
    suppressed = {"f1", "f2", "f3"}
    got = incremental.covered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(f,) for f in suppressed] + [(None,)], "fp string"), ["title", "description"], "run_id", batches=batches, bands=24)
    ids = [r[0] for r in got.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == sequential(rows, suppressed)


def arrive(spark, history, rows, n, parts):
    part = spark.createDataFrame([r for r in rows if r[0] % parts == n], SCHEMA)
    keyed = wordsets.keyed(part, ["title", "description"], "id", (part["id"] + n * 10000).alias("pos"), "fp")
    return {r[0] for r in incremental.accept_batch(history, keyed, spark.createDataFrame([], "fp string")).collect()}


def test_runs_are_merged_and_outlive_the_application(spark, tmp_path):
    rows = corpus(60, seed=5)
    history = incremental.History(spark, str(tmp_path / "h"), fan=2)
    out, levels = set(), []
    for n in range(4):
        out |= arrive(spark, history, rows, n, 4)
        levels.append([level for _, level in history.runs])
        history = incremental.History.load(spark, history.home)  # as a later application does
    assert levels == [[0], [1], [1, 0], [2]]
    assert len(list((tmp_path / "h" / "runs").iterdir())) == 1  # what was merged is gone
    order = sorted(rows, key=lambda r: (r[0] % 4, r[0]))
    assert out == sequential([(r[0], i, *r[2:]) for i, r in enumerate(order)], set())


def test_only_touched_ranges_are_read(spark, tmp_path):
    history = incremental.History(spark, str(tmp_path / "h"), ranges=1024)
    arrive(spark, history, corpus(60, seed=5), 0, 1)
    plan = history.neighbours([3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan or "PartitionFilters: [range" in plan
    total, few = history.neighbours(list(range(1024))), history.neighbours([3, 7])
    assert few.count() == total.filter("range in (3, 7)").count() < total.count()
    assert total.groupBy("range").count().count() > 500


def test_rounds_and_one_by_one_agree(spark):
    rows = corpus(120, seed=12)
    none = spark.createDataFrame([], "fp string")
    for few in (0, 10):
        got = incremental.covered(spark.createDataFrame(rows, SCHEMA), none, ["title", "description"], "run_id", batches=1, few=few)
        assert {r[0] for r in got.collect()} == sequential(rows, set())


def test_huge_ids_keep_their_order(spark):
    rows = [(2**62, -(2**61), "a", "one two three", "x", *"xyz"), (-(2**62), 2**61, "a", "four five six", "y", *"xyz"), (5, 2**61, "b", "seven eight", "z", *"xyz")]
    got = incremental.covered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "fp string"), ["title", "description"], "run_id", batches=1)
    assert [r[0] for r in got.collect()] == [-(2**62)]


def test_thresholds_rise_with_similarity():
    assert wordsets.bit_threshold(0.5, 0.01) < wordsets.bit_threshold(0.9, 0.01)
    loose, strict = wordsets.parity_thresholds(5, 0.001, 128), wordsets.parity_thresholds(9, 0.001, 128)
    assert all(a >= b for a, b in zip(loose, strict)) and loose[70] > strict[70]
    assert all(a <= b for a, b in zip(wordsets.parity_thresholds(7, 0.001, 64), wordsets.parity_thresholds(7, 0.001, 128)))


def test_parities_never_exceed_the_words_that_differ():
    import pyarrow as pa

    rng = random.Random(2)
    signer = wordsets.Signer({}, bands=2, rows=2)
    for _ in range(50):
        a = rng.sample(range(500), 40)
        b = a[:34] + rng.sample(range(500, 900), 6)
        signs = signer.sign(pa.array([" ".join(map(str, sorted(x))) for x in (a, b)]))[1]
        assert sum(int(x).bit_count() for x in (signs[0, 1:] ^ signs[1, 1:]).view("uint64")) <= 12


def test_phrases_weigh_less_than_free_words(spark):
    rng = random.Random(6)
    texts = [" ".join(sorted({*["when", "the", "arrives"], *(f"w{rng.randrange(60)}" for _ in range(8))})) for _ in range(600)]
    weights = wordsets.word_weights(spark.createDataFrame([(t,) for t in texts], "words string"))
    assert weights["arrives"] == wordsets.LEAST_WEIGHT and min(w for k, w in weights.items() if k[0] == "w" and k[1].isdigit()) > 1
    assert wordsets.word_weights(spark.createDataFrame([], "words string")) == {}


def rare_edits(n=60, seed=4):
    """Pairs of Jaccard similarity 0.75 that differ in rare words only, so that their weighted similarity is about 0.55."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        shared = rng.sample([f"w{k}" for k in range(200)], 12)
        rows += [(2 * i + k, k, None, " ".join(shared), f"only{i}x{k} just{i}y{k}", *"xyz") for k in (0, 1)]
    return rows


def test_rare_edits_are_covered(spark):
    rows = rare_edits()
    got = incremental.covered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "fp string"), ["title", "description"], "run_id")
    assert {r[0] for r in got.collect()} == sequential(rows, set()) == {r[0] for r in rows if r[1] == 1}


def test_rare_edits_are_linked(spark):
    near = neardup.near_duplicates(spark.createDataFrame(rare_edits(), SCHEMA), "id", ["title", "description"], tenths=7)
    assert {tuple(r) for r in near.pairs().collect()} == {(2 * i, 2 * i + 1) for i in range(60)}


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    # Written tables: their compressed files are far below the threshold at which Spark broadcasts.
    rows = corpus(60, seed=8)
    keyed = wordsets.keyed(spark.createDataFrame(rows, SCHEMA), ["title", "description"], "id")
    classes = wordsets.classes(keyed)
    pairs = classes.select(classes["rep"].alias("a"), classes["rep"].alias("b"))
    plan = wordsets.verified(pairs, classes, classes, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = incremental.covered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("f1",)], "fp string"), ["title", "description"], "run_id")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in got.collect()} == sequential(rows, {"f1"})


@pytest.mark.parametrize("hot", [4096, 3])
def test_tasks_meet_the_pairs_that_a_join_meets(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr(wordsets, "HOT", hot)  # with 3, keys of more than three rows are left to a join
    keyed = wordsets.keyed(spark.createDataFrame(corpus(60, seed=8), SCHEMA), ["title", "description"], "id")
    signed = wordsets.signed(wordsets.classes(keyed), wordsets.Signer({}, 8, 2)).withColumn("old", F.col("rep") % 3 == 0).localCheckpoint()
    x, y = signed.alias("x"), signed.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & ~F.col("x.old") & (F.col("y.old") | (F.col("x.rep") < F.col("y.rep")))
    want = x.join(y, same & wordsets.agreeing("x", "y", 7, 0.0001)).select("x.rep", "y.rep", "y.old").distinct()
    got = [tuple(r) for r in wordsets.met(signed, 7, 0.0001).distinct().collect()]
    assert got and sorted(got) == sorted(tuple(r) for r in want.collect())


def test_words_are_ascii_letters_and_digits(spark):
    rows = [(1, "B-a_b A9", None), (2, "\u212aelvin", "\u00e9t\u00e9 x"), (3, None, None), (4, "!\u00e9", ""), (5, "!", "")]
    got = {r["id"]: (r["words"], bytes(r["ck"])) for r in wordsets.keyed(spark.createDataFrame(rows, "id long, t string, d string"), ["t", "d"], "id").collect()}
    assert [got[i][0] for i in range(1, 6)] == ["a a9 b", "kelvin t x", "", "", ""]
    assert len({k for _, k in got.values()}) == 5 and all(len(k) == 16 for _, k in got.values())
