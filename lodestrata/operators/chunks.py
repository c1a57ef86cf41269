"""Operators over chunks: chunking, index state, vector search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import Shared


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_lines(files: DataFrame, size: int = 50, overlap: int = 10) -> DataFrame:
    """(repo_path, file_path, start_line, end_line, content): overlapping windows of lines; blank ones are left out.

    A window starts every ``size - overlap`` lines; none starts after one that reaches the end.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"\n\z", ""), "\n")
    rows = files.filter("content is not null and content <> ''").select("repo_path", "file_path", lines.alias("_l"))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("_l") - size) / F.lit(step))).cast("int")
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("_n") * step + 1
    text = F.array_join(F.slice("_l", start, F.lit(size)), "\n")
    rows = rows.select("repo_path", "file_path", start.alias("start_line"), F.least(start + size - 1, F.size("_l")).alias("end_line"), text.alias("content"))
    return rows.filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def index_state(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_path, file_path, state) of every file on either side: added, removed, changed or current, by content hash.

    ``chunks`` has content_hash of whole files; a file is current if its hash is among those indexed for it.
    """
    f = files.select("repo_path", "file_path", F.col("content_hash").alias("_now"))
    c = chunks.select("repo_path", "file_path", F.col("content_hash").alias("_was"))
    was = c.groupBy("repo_path", "file_path").agg(F.count("*").alias("_n"))
    same = f.join(c, (f["repo_path"] == c["repo_path"]) & (f["file_path"] == c["file_path"]) & (f["_now"] == c["_was"]), "left_semi").select("repo_path", "file_path", F.lit(True).alias("_same"))
    rows = f.join(was, ["repo_path", "file_path"], "full_outer").join(same.distinct(), ["repo_path", "file_path"], "left")
    state = F.when(F.col("_now").isNull(), "removed").when(F.col("_n").isNull(), "added").when(F.col("_same"), "current").otherwise("changed")
    return rows.select("repo_path", "file_path", state.alias("state"))


def counts(chunks: DataFrame) -> DataFrame:
    """(repo_path, chunks, files) of every repository."""
    return chunks.groupBy("repo_path").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"))


def hashes(chunks: DataFrame) -> DataFrame:
    """(repo_path, file_path, hashes): the sorted set of content hashes of every indexed file."""
    distinct = chunks.select("repo_path", "file_path", "content_hash").distinct()
    return distinct.groupBy("repo_path", "file_path").agg(F.sort_array(F.collect_list("content_hash")).alias("hashes"))


def latest(chunks: DataFrame) -> DataFrame:
    """Of chunks indexed again at the same place and for the same model the newest."""
    newest = F.row_number().over(Window.partitionBy("repo_path", "file_path", "start_line", "embed_model").orderBy(F.desc("updated_at"), F.desc("id")))
    return chunks.withColumn("_n", newest).filter("_n = 1").drop("_n")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is zero, null if one is null or the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    zero = (norm(a) == 0) | (norm(b) == 0)
    return F.when(F.size(a) == F.size(b), F.when(zero, 0.0).otherwise(dot / (norm(a) * norm(b))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of all vectors for a stated set of queries, exactly.

    ``vectors`` (id, v) are scanned once for every block of at most ``block_bytes`` of ``queries`` (query_id, v), which is
    sent to all executors; every batch keeps its own k nearest before anything is shuffled. A query is not its own
    neighbour; vectors of another length, null ones and nulls within are left out; zero vectors have similarity 0.
    Similarities are rounded to six decimals; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    blocks: list[dict[int, tuple[list[int], list[list[float]]]]] = [{}]
    used = 0
    for q, v in queries.select("query_id", "v").filter("query_id is not null and v is not null").toLocalIterator():
        if not v or any(x is None for x in v):
            continue
        if used + 8 * len(v) > block_bytes and used:
            blocks.append({})
            used = 0
        ids, rows = blocks[-1].setdefault(len(v), ([], []))
        ids.append(q)
        rows.append(v)
        used += 8 * len(v)
    parts = [_searched(vectors, Shared(spark, {d: (np.array(i), _unit(np.array(r, np.float64))) for d, (i, r) in b.items()}), k) for b in blocks]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _searched(vectors: DataFrame, shared: Shared, k: int) -> DataFrame:
    """The best k of every batch for every query of a block."""

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = np.diff(np.asarray(batch["v"].offsets))
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts, all_ids = np.concatenate([[0], np.cumsum(sizes)]), np.asarray(batch["id"])
            for d, (queries, units) in shared.value.items():
                at = np.flatnonzero(sizes == d)
                if not len(at):
                    continue
                m, ids = _unit(flat[starts[at][:, None] + np.arange(d)]), all_ids[at]
                for i in range(0, len(queries), 512):
                    s = np.round(units[i : i + 512] @ m.T, 6)
                    s[queries[i : i + 512][:, None] == ids[None, :]] = -np.inf
                    top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    values = s[np.arange(len(s))[:, None], top]
                    good = np.isfinite(values)
                    cols = [np.broadcast_to(queries[i : i + 512][:, None], top.shape)[good], ids[top][good], values[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "id", "similarity"])

    usable = vectors.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    return usable.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).mapInArrow(best, "query_id long, id long, similarity double")
