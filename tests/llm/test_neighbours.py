import numpy as np

from lodestrata.llm import neighbours

SCHEMA = "id long, repo string, path string, model string, v array<float>, file string, rep long"


def brute(rows, k=5, least=0.9):
    usable = [r for r in rows if r[0] is not None and r[4] and all(x is not None for x in r[4]) and np.linalg.norm(r[4]) > 0]
    out = {}
    for r in usable:
        found = []
        for s in usable:
            if s[3] == r[3] and len(s[4]) == len(r[4]) and (s[1], s[2]) != (r[1], r[2]):
                a, b = np.array(r[4], np.float64), np.array(s[4], np.float64)
                c = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
                if c >= least:
                    found.append((-c, s[0]))
        out[r[0]] = [i for _, i in sorted(found)[:k]]
    return out


def sample(seed=1):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for c in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 7))):
            n += 1
            v = (centre + rng.normal(size=16) * rng.uniform(0.02, 0.3)) * rng.uniform(0.2, 5)
            rows.append((n, f"r{c % 3}", f"p{n // 3}", f"m{c % 2}", [float(np.float32(x)) for x in v], "clash", 0))
    hot = [float(np.float32(x)) for x in rng.normal(size=16)]
    for i in range(120):  # a third of all rows are one vector, some of them in one file
        rows.append((1000 + i, "hot", f"p{i // 20}", "m0", [x * (1 + i % 3) for x in hot], "clash", 0))
    rows += [(2001, "r", "p", "m0", None, "c", 0), (2002, "r", "p", "m0", [0.0] * 16, "c", 0), (2003, "r", "p", "m0", [1.0, 2.0], "c", 0), (2004, "r", "q", "m0", [2.0, 4.0], "c", 0), (2005, None, None, "m0", [1.0, None], "c", 0), (2006, None, None, None, [1.0, 1.0], "c", 0), (2007, "r", "z", "m0", [], "c", 0)]
    return rows


def test_matches_brute_force(spark):
    rows = sample()
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), "id", "model", ["repo", "path"], "v", list_size=16)
    mine = {}
    for r in got.orderBy("id", "rank").collect():
        mine.setdefault(r["id"], []).append(r["neighbour"])
    want = {k: v for k, v in brute(rows).items() if v}
    total = sum(map(len, want.values()))
    same = sum(len(set(v) & set(mine.get(k, []))) for k, v in want.items())
    assert same >= 0.97 * total
    assert mine[1000] == want[1000] and mine[1119] == want[1119] and mine[2003] == [2004]
    assert not {2001, 2002, 2005, 2007} & set(mine)


def test_empty(spark):
    got = neighbours.nearest(spark.createDataFrame([], SCHEMA), "id", "model", ["repo", "path"], "v")
    assert got.count() == 0


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = neighbours.Lists(x, 128)
    ids, sims = lists.search(x[:500], beam=16)
    exact = np.argmax(x[:500] @ lists.centres.T, axis=1)
    assert (ids[:, 0] == exact).mean() >= 0.9
    assert all(len(set(r)) == len(r) for r in ids.tolist())


def test_nearest_of_many_lists_are_found():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = neighbours.Lists(x, 4096)
    ids, sims = lists.search(x[:300], beam=20)
    cos = x[:300] @ lists.centres.T
    best = np.argsort(-cos, axis=1, kind="stable")[:, :20]
    assert np.allclose(sims, np.take_along_axis(cos, best, 1), atol=1e-5)
    assert (np.sort(ids, axis=1) == np.sort(best, axis=1)).mean() >= 0.999  # the greedy search found 0.39 of them


def test_the_graph_is_searched_beyond_what_is_scanned(monkeypatch):
    monkeypatch.setattr(neighbours, "SCANNED", 8)
    test_graph_search_finds_the_nearest_lists()
