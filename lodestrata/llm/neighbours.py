"""Most similar vectors of every vector: balanced posting lists found through a graph of their centroids.

* Centroids come from a bounded sample, split in halves at the median until each part has about ``list_size`` vectors of
  the whole; so a region that holds a third of all vectors gets a third of the lists.
* The lists of a vector are those of the nearest centroids among all of them, which every worker keeps in memory; beyond
  SCANNED centroids, a graph of near ones is searched greedily with a beam instead.
* Lists are selected by their distance ratio: a vector looks into those whose centroid is at most ``1 + slack`` times as
  far as the nearest, and the first ``replicas`` of these also hold it, so boundary vectors are in several lists.
* Within a list similarities are one matrix product. A pair found from either side counts for both.

Equal directions are one class and take part once; their members are put back at the end. All vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import Shared, materialize

#: Centroids up to which a vector is compared with all of them. A greedy search of their graph finds the nearest of 16,384
#: for a fifth of the vectors only, and costs about as much; the sample of ``nearest`` bounds the centroids to as many.
SCANNED = 1 << 16


class Lists:
    """Centroids of the posting lists of one group of vectors, and the graph to find the nearest of them."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        parts = [sample]
        while len(parts) < lists:
            parts = [half for part in parts for half in self._halves(part, rng)]
            if max(map(len, parts)) < 4:
                break
        centres = np.stack([p.mean(axis=0) for p in parts if len(p)])
        self.centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        k = len(self.centres)
        if k <= SCANNED:
            return
        degree = min(degree, k)
        near = np.empty((k, degree), np.int32)
        for i in range(0, k, 1024):
            near[i : i + 1024] = np.argpartition(-(self.centres[i : i + 1024] @ self.centres.T), degree - 1, axis=1)[:, :degree]
        far = rng.integers(0, k, (k, 2), dtype=np.int32)  # long links keep the graph connected
        self.graph = np.concatenate([near, far], axis=1)
        self.entries = np.linspace(0, k - 1, min(k, 24)).astype(np.int32)

    @staticmethod
    def _halves(part: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        """Two halves of equal size, cut at the median along the line between two means."""
        if len(part) < 2:
            return [part]
        means = part[rng.choice(len(part), 2, replace=False)].copy()
        for _ in range(6):
            side = part @ (means[0] - means[1]) > 0
            if side.all() or not side.any():
                break
            means = np.stack([part[side].mean(axis=0), part[~side].mean(axis=0)])
        order = np.argsort(part @ (means[0] - means[1]), kind="stable")
        return [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]

    def search(self, queries: np.ndarray, beam: int, steps: int = 12, expand: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities) of each query's best ``beam`` centroids found, best first."""
        if len(self.centres) <= SCANNED:
            parts = [self._scan(queries[i : i + 256], beam) for i in range(0, max(1, len(queries)), 256)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        n = len(queries)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        sims = queries @ self.centres[self.entries].T
        done = np.zeros(ids.shape, bool)
        row = np.arange(n)[:, None]
        for _ in range(steps):
            waiting = np.where(done, -np.inf, sims)
            pick = np.argsort(-waiting, axis=1)[:, :expand]
            if not np.isfinite(waiting[row, pick]).any():
                break
            done[row, pick] = True
            new = self.graph[ids[row, pick]].reshape(n, -1)
            found = np.einsum("nkd,nd->nk", self.centres[new], queries, optimize=False)
            ids = np.concatenate([ids, new], axis=1)
            sims = np.concatenate([sims, found], axis=1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
            order = np.lexsort((~done, ids), axis=1)  # equal ids side by side, one that is done first
            ids, sims, done = ids[row, order], sims[row, order], done[row, order]
            sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
            best = np.argsort(-sims, axis=1)[:, :beam]
            ids, sims, done = ids[row, best], sims[row, best], done[row, best]
            done |= ~np.isfinite(sims)
        order = np.argsort(-sims, axis=1)
        return ids[row, order], sims[row, order]

    def _scan(self, queries: np.ndarray, best: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing all centroids; the best are in the blocks with the best maxima, so only these are sorted."""
        sims = queries @ self.centres.T
        n, k = sims.shape
        best, row = min(best, k), np.arange(n)[:, None]
        ids = np.broadcast_to(np.arange(k), (n, k))
        if k > best * block:
            sims = np.pad(sims, ((0, 0), (0, -k % block)), constant_values=-np.inf) if k % block else sims
            blocks = sims.reshape(n, -1, block)
            top = np.argpartition(-blocks.max(axis=2), best - 1, axis=1)[:, :best]
            sims = blocks[row, top].reshape(n, -1)
            ids = (top[:, :, None] * block + np.arange(block)).reshape(n, -1)
        take = np.argpartition(-sims, best - 1, axis=1)[:, :best]
        take = take[row, np.argsort(-sims[row, take], axis=1, kind="stable")]
        return ids[row, take].astype(np.int32), sims[row, take]


def unit_vectors(rows: DataFrame, id_col: str, group: str, file_cols: list[str], vector: str) -> DataFrame:
    """(grp, id, file, same, v): unit float32 vectors as bytes; ``same`` is equal for equal directions (5 decimals).

    Rows whose id, vector or a component is null, and zero or non-finite vectors, are left out. A null group is a group.
    """

    def convert(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch["v"]
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            same, out = np.zeros(len(sizes), np.int64), np.empty(len(sizes), object)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if not d:
                    continue
                m = flat[starts[at][:, None] + np.arange(d)]
                norm = np.linalg.norm(m, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                at, m = at[good], m[good] / norm[good, None]
                rounded = (np.round(m * 1e5)).astype(np.int32)
                for i, x, r in zip(at, m.astype(np.float32), rounded):
                    out[i] = x.tobytes()
                    same[i] = xxhash.xxh3_64_intdigest(r.tobytes()) - 2**63
            keep = pa.array(np.array([o is not None for o in out], bool))
            cols = [batch["grp"], batch["id"], batch["file"], pa.array(same), pa.array(list(out), pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["grp", "id", "file", "same", "v"])

    usable = rows.filter(rows[id_col].isNotNull() & rows[vector].isNotNull() & F.forall(rows[vector], lambda x: x.isNotNull()))
    grp = F.concat_ws("\n", F.coalesce(rows[group], F.lit("\n")), F.size(rows[vector]).cast("string"))
    cols = usable.select(grp.alias("grp"), rows[id_col].alias("id"), F.xxhash64(*(rows[c] for c in file_cols)).alias("file"), rows[vector].cast("array<float>").alias("v"))
    return cols.mapInArrow(convert, "grp string, id long, file long, same long, v binary")


def fit(vectors: DataFrame, list_size: int, sample: int) -> dict[str, Lists]:
    """Posting lists for every group, from about ``sample`` vectors of each, taken by a hash of their id."""
    sizes = {r["grp"]: r["count"] for r in vectors.groupBy("grp").count().collect()}
    part = F.create_map(*(x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, sample / n))))) if sizes else F.lit(None)
    if not sizes:
        return {}
    taken = vectors.filter((F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6) < F.element_at(part, F.col("grp")))
    table = taken.select("grp", "id", "v").toArrow().sort_by("id")
    out = {}
    for g, n in sizes.items():
        own = table.filter(pc.equal(table["grp"], g))["v"].to_pylist()
        if own:
            out[g] = Lists(np.frombuffer(b"".join(own), np.float32).reshape(len(own), -1), max(1, n // list_size))
    return out


def _placed(vectors: DataFrame, lists: dict[str, Lists], probes: int, replicas: int, slack: float) -> DataFrame:
    """(grp, list, id, file, held, v): a row for every list that a vector looks into; ``held`` where it is also held."""
    shared = Shared(vectors.sparkSession, lists)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                names = np.array(batch["grp"].to_pylist(), object)
                for g in sorted(set(names)):
                    own = shared.value[g]
                    part = batch.filter(pa.array(names == g))
                    q = np.frombuffer(b"".join(part["v"].to_pylist()), np.float32).reshape(part.num_rows, -1)
                    ids, sims = own.search(q, beam=max(16, 2 * probes))
                    ids, sims = ids[:, :probes], sims[:, :probes]
                    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
                    use = (far <= (1 + slack) * far[:, :1]) & np.isfinite(sims)
                    r, c = np.nonzero(use)
                    take = pa.array(r)
                    cols = [part["grp"].take(take), pa.array(ids[r, c]), part["id"].take(take), part["file"].take(take), pa.array(c < replicas), part["v"].take(take)]
                    yield pa.RecordBatch.from_arrays(cols, ["grp", "list", "id", "file", "held", "v"])

    return vectors.select("grp", "id", "file", "v").mapInArrow(place, "grp string, list int, id long, file long, held boolean, v binary")


def _best(q: np.ndarray, m: np.ndarray, s: np.ndarray, file: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of those hits that can be among the best k of some row of q's class, whatever its own file is."""
    order = np.lexsort((ids[m], -np.round(s, 6), q))
    keep, last, seen = [], -1, {}
    for i in order:
        if q[i] != last:
            last, seen = q[i], {}
        f = file[m[i]]
        if (f in seen or len(seen) <= k) and seen.get(f, 0) < k:
            seen[f] = seen.get(f, 0) + 1
            keep.append(i)
    return np.array(keep, np.int64)


def _hits(placed: DataFrame, least: float, k: int) -> DataFrame:
    """(a, b, cos), in both directions: class pairs of at least that similarity within the lists."""

    def one(table: pa.Table) -> pa.Table:
        ids, file, held = np.asarray(table["id"]), np.asarray(table["file"]), np.asarray(table["held"])
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(len(ids), -1)
        members, none = np.flatnonzero(held), np.array([], np.int64)
        out = [(none, none, none.astype(np.float32))]  # nothing is held where all only look in
        for i in range(0, len(ids), 1024):
            for j in range(0, len(members), 4096):
                block = members[j : j + 4096]
                s = v[i : i + 1024] @ v[block].T
                q, m = np.nonzero(s >= least - 1e-6)
                s, q, m = s[q, m], q + i, block[m]
                other = ids[q] != ids[m]
                s, q, m = s[other], q[other], m[other]
                if len(q) > k and np.bincount(q).max() > k:
                    keep = _best(q, m, s, file, ids, k)
                    s, q, m = s[keep], q[keep], m[keep]
                out.append((ids[q], ids[m], s))
        a, b, s = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": np.concatenate([a, b]), "b": np.concatenate([b, a]), "cos": np.concatenate([s, s]).astype(np.float64)})

    return placed.groupBy("grp", "list").applyInArrow(one, "a long, b long, cos double")


def _limited(hits: DataFrame, by: str, k: int) -> DataFrame:
    """Of each ``by``: at most k rows of a file and the k + 1 files with the best rows; enough to leave any file out."""
    in_file = Window.partitionBy(by, "file").orderBy(F.desc("cos"), "id")
    rows = hits.withColumn("n", F.row_number().over(in_file)).filter(F.col("n") <= k)
    first = F.first(F.struct(-F.col("cos"), F.col("id"))).over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("lead", first)
    files = Window.partitionBy(by).orderBy("lead")
    return rows.withColumn("d", F.dense_rank().over(files)).filter(F.col("d") <= k + 1).drop("n", "d", "lead")


def nearest(
    rows: DataFrame, id_col: str, group: str, file_cols: list[str], vector: str, k: int = 5, least: float = 0.9,
    list_size: int = 256, sample: int = 32768, probes: int = 10, replicas: int = 5, slack: float = 0.2,
) -> DataFrame:
    """(id, neighbour, cos, rank): for every row its at most k most similar rows of other files within its group.

    Files are told apart by ``file_cols``; vectors of different length are never compared; ties go to the smaller id.
    Similarities are compared to six decimals. Null and zero vectors have no neighbours and are none. Ids must be unique.
    ``sample`` bounds the vectors that centroids are fitted on; all vectors are indexed and searched.
    """
    vectors = materialize(unit_vectors(rows, id_col, group, file_cols, vector), "vectors")
    classes = vectors.groupBy("grp", "same").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v"), F.min("file").alias("lo"), F.max("file").alias("hi"))
    classes = materialize(classes, "directions")
    members = vectors.select("grp", "same", "id", "file").join(classes.select("grp", "same", "rep"), ["grp", "same"]).select("rep", "id", "file")
    single = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.col("rep"))  # a class of several files is never left out as a whole
    points = classes.select("grp", F.col("rep").alias("id"), single.alias("file"), "v")
    lists = fit(points, list_size, sample)
    hits = _hits(_placed(points, lists, probes, replicas, slack), least, k)
    hits = materialize(hits.groupBy("a", "b").agg(F.round(F.max("cos"), 6).alias("cos")), "hits")

    entries = _limited(members.withColumn("cos", F.lit(1.0)), "rep", k).select(F.col("rep").alias("b"), "id", "file")
    several = entries.groupBy("b").count().filter("count > 1").select(F.col("b").alias("a"), "b", F.lit(1.0).alias("cos"))
    found = hits.unionByName(several).join(entries, "b").select("a", "cos", "id", "file")
    found = _limited(found, "a", k).select(F.col("a").alias("rep"), "cos", F.col("id").alias("neighbour"), F.col("file").alias("other"))
    met = members.join(found, "rep").filter("file <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "neighbour"))
    return met.select("id", "neighbour", "cos", rank.alias("rank")).filter(F.col("rank") <= k)
