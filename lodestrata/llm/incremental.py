"""Deduplicating new batches against everything accepted before, by multi-key sorted-neighbourhood runs.

The history of accepted records is kept in a folder as sorted runs: parquet tables of (key, rep, signature) rows, one
subfolder per key range, sorted by key. A key is a sort value of weighted minhashes under one of several sort orders, so
that similar records are neighbours under some of them. The rows of a batch are merged with the runs: only the key ranges
that the batch falls into are read, rows outside of the batch's windows (the runs of equal sort value) are passed over while
they are read, and what is left is compared with the batch alone. Records of the history are never compared with each other
again, nor shuffled. Accepted records form a new run; as soon as ``fan`` runs of a level exist, they are merged into one of
the next, so a record is rewritten once a level. Beside the runs the history has the accepted fingerprints and word sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import wordsets
from lodestrata.storage import Shared, delete_path, discard, joined, list_names, materialize, temporary_path, write_text

#: Open records and links up to which the rest of a batch is decided one by one in a single task.
FEW = 200_000
#: Most bits of the filter of a batch's keys (a broadcast of 32 MB).
FILTER_BITS = 1 << 28


@dataclass
class History:
    """Accepted records in the folder ``home``; a temporary one in the shared folder if none is given.

    ``runs``: (name, level) of the tables under home/runs. ``accepted``: names of tables (fp, ck, rep, words), one row a
    record, under home/accepted; they are written once and only read by narrow columns, except for verifications.
    """

    spark: SparkSession
    home: str | None = None
    signer: wordsets.Signer | None = None  # made from the first batch's words
    tenths: int = 7
    miss: float = 0.0001
    bands: int = 32
    rows: int = 4
    ranges: int = 16  # a power of two; more of them let small batches read less
    fan: int = 3
    runs: list[tuple[str, int]] = field(default_factory=list)
    accepted: list[str] = field(default_factory=list)
    written: int = 0

    def __post_init__(self) -> None:
        self.home = self.home or temporary_path(self.spark, "history")

    # The history must survive the application, so its tables are plain folders and its state is a small JSON text.

    def save(self) -> None:
        """Write what a later application needs to go on with ``load``; the newest state counts."""
        state = {k: getattr(self, k) for k in ("tenths", "miss", "bands", "rows", "ranges", "fan", "runs", "accepted", "written")}
        state["weights"], state["seed"] = (self.signer.weights, self.signer.seed) if self.signer else (None, None)
        write_text(self.spark, f"{self.home}/state/{self.written:09d}.json", json.dumps(state))

    @classmethod
    def load(cls, spark: SparkSession, home: str) -> History:
        states = spark.read.text(f"{home}/state", wholetext=True).select("value", F.input_file_name().alias("file"))
        state = json.loads(states.orderBy(F.desc("file")).first()["value"])
        weights, seed = state.pop("weights"), state.pop("seed")
        state["runs"] = [tuple(r) for r in state["runs"]]
        own = cls(spark, home, **state)
        own.signer = None if weights is None else wordsets.Signer(weights, own.bands, own.rows, seed)
        return own

    def known(self) -> DataFrame:
        """(fp, ck, rep, words) of all accepted records."""
        paths = [f"{self.home}/accepted/{n}" for n in self.accepted]
        return self.spark.read.schema("fp string, ck binary, rep long, words string").parquet(*paths)

    def neighbours(self, ranges: list[int]) -> DataFrame:
        """The rows of all runs in these key ranges; the filter is one of partitions, so other ranges are not read."""
        paths = [f"{self.home}/runs/{name}" for name, _ in self.runs]
        schema = f"key long, rep long, {', '.join(f'{s} long' for s in wordsets.SIGNATURE)}, range int"
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])
        return rows.filter(F.col("range").isin(ranges))

    def add(self, accepted: DataFrame) -> None:
        """Keep accepted records (fp, ck, rep, words), with a sorted run of their classes."""
        name = self._name()
        path = f"{self.home}/accepted/{name}"
        accepted.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
        self.accepted.append(name)
        words = self.spark.read.schema(accepted.schema).parquet(path)
        rows = wordsets.signed(words, self.signer).withColumn("range", _range(F.col("key"), self.ranges))
        run = self._name()
        _write_ranges(rows.repartition("range").sortWithinPartitions("range", "key"), f"{self.home}/runs/{run}")
        self.runs.append((run, 0))
        level = 0
        while len(same := [r for r in self.runs if r[1] == level]) >= self.fan:
            self._merge([r[0] for r in same], level + 1)
            level += 1

    def _merge(self, names: list[str], level: int, at_once: int = 64) -> None:
        """Runs as one of the next level: each range is read from all of them and sorted by one task, without a shuffle."""
        name, paths = self._name(), [f"{self.home}/runs/{n}" for n in names]
        schema = f"key long, rep long, {', '.join(f'{s} long' for s in wordsets.SIGNATURE)}"
        have = {p: set(list_names(self.spark, p)) for p in paths}
        for first in range(0, self.ranges, at_once):
            parts = []
            for r in range(first, min(first + at_once, self.ranges)):
                folders = [f"{p}/range={r}" for p in paths if f"range={r}" in have[p]]
                if folders:
                    own = self.spark.read.schema(schema).parquet(*folders).coalesce(1).sortWithinPartitions("key")
                    parts.append(own.withColumn("range", F.lit(r)))
            if parts:
                _write_ranges(reduce(DataFrame.unionByName, parts), f"{self.home}/runs/{name}")
        self.runs = [r for r in self.runs if r[0] not in names] + [(name, level)]
        self.save()  # before what the old state names goes
        for p in paths:
            delete_path(self.spark, p)

    def _name(self) -> str:
        self.written += 1
        return f"{self.written:09d}"


def _write_ranges(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("range").option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def _range(key: Column, ranges: int) -> Column:
    """Ranges of equal width of a key, which is spread evenly over 63 bits."""
    return F.shiftright(key, 63 - (ranges.bit_length() - 1)).cast("int")


class _Filter:
    """Bits at two places for every key of a set; a key without both is not in it."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        own = keys.astype(np.uint64)
        return (own % np.uint64(size)).astype(np.int64), (own // np.uint64(size) % np.uint64(size - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, len(self.bits) * 64)
        bit = lambda p: self.bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)
        return (bit(a) & bit(b)).astype(bool)


def _key_filter(own: DataFrame, keys: int) -> _Filter:
    """The filter of the batch's keys: 8 to 16 bits a key, FILTER_BITS at most; only its words come to the driver.

    Each task marks its keys in bits of its own and hands on chunks of these, which are united chunk by chunk.
    """
    size = min(FILTER_BITS, max(1 << 16, 1 << (8 * max(1, keys) - 1).bit_length()))
    chunk = min(size, 1 << 22) // 64  # in words

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in it:
            for places in _Filter.places(np.asarray(batch["key"]), size):
                bits[places] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        pieces = [packed[i : i + chunk * 8] for i in range(0, size // 8, chunk * 8)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "bits"])

    def united(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint64) for b in table["bits"].to_pylist()])
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    table = own.select("key").mapInArrow(marked, "piece int, bits binary").groupBy("piece").applyInArrow(united, "piece int, bits binary").toArrow()
    bits = np.zeros(size // 64, np.uint64)
    for piece, own_bits in zip(table["piece"].to_pylist(), table["bits"].to_pylist()):
        bits[piece * chunk : (piece + 1) * chunk] = np.frombuffer(own_bits, np.uint64)
    return _Filter(bits)


def _windows(history: History, own: DataFrame) -> DataFrame:
    """The rows of the runs whose sort value the batch's signed rows ``own`` have, too (and a few others)."""
    touched = own.groupBy(_range(F.col("key"), history.ranges).alias("range")).count().collect()  # at most ``ranges`` rows
    shared = Shared(history.spark, _key_filter(own, sum(r["count"] for r in touched)))

    def passing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(shared.value.holds(np.asarray(batch["key"]))))

    rows = history.neighbours([r["range"] for r in touched]).drop("range")
    return rows.mapInArrow(passing, rows.schema)


def _links(history: History, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, b) of similar classes of the batch, in both directions; (rep,) classes similar to an accepted one), both written."""
    own = wordsets.signed(classes, history.signer)
    rows = own.withColumn("old", F.lit(False))
    if history.runs:
        own = materialize(own, "own", dictionary=False)
        rows = own.withColumn("old", F.lit(False)).unionByName(_windows(history, own).withColumn("old", F.lit(True)))
    met = wordsets.met(rows, history.tenths, history.miss).distinct()
    inner = wordsets.verified(met.filter("not old").select("a", "b"), classes, classes, history.tenths).select("a", "b")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")
    inner = materialize(inner.select(both).select("l.a", "l.b"), "links", dictionary=False)
    if not history.runs:
        return inner, inner.select(F.col("a").alias("rep")).limit(0)
    discard(own)
    outer = wordsets.verified(met.filter("old").select("a", "b"), classes, history.known().select("rep", "words"), history.tenths)
    outer = materialize(outer.select(F.col("a").alias("rep")).distinct(), "covered", dictionary=False)
    discard(met)
    return inner, outer


def _one_by_one(units: DataFrame, links: DataFrame) -> DataFrame:
    """The accepted ones of a few ``units`` (fp, ck, rep, pos), decided in order in one task."""

    def decide(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pairs["a"], pairs["b"]):
            near.setdefault(a, []).append(b)
        covered: set[int] = set()  # classes
        seen: set[str] = set()
        rows, keep = rows.sort_values("pos", ignore_index=True), []
        for fp, rep in zip(rows["fp"], rows["rep"]):
            keep.append(rep not in covered and (fp is None or fp not in seen))
            if keep[-1]:
                covered.add(rep)
                covered.update(near.get(rep, ()))
                if fp is not None:
                    seen.add(fp)
        return rows[keep]

    alone = F.lit(0).alias("g")
    return units.groupBy(alone).cogroup(links.groupBy(alone)).applyInPandas(lambda u, p: decide(u.astype({"fp": object}).where(u.notna(), None), p), units.schema)


def accept_batch(history: History, rows: DataFrame, suppressed: DataFrame, keep: bool = True, few: int = FEW) -> DataFrame:
    """(id,) of a batch's ``rows`` that are covered, in order of ``pos``; the others are added to the ``history``.

    ``rows`` has id, pos (of any ordered type; unique, later than all of the history), fp (null where unknown), and ck and
    words of ``wordsets.keyed``; as it is read several times it should be a written table. ``suppressed`` has fp. A record is
    covered if its fp is suppressed or accepted, or if its word set is that of an accepted record or similar to it. Only
    records that neither decides by equality are signed and merged. Acceptance within the batch is decided in rounds: of the
    open records, those that come first in their fingerprint, in their class and among the linked classes are accepted
    and cover the rest of those groups; once at most ``few`` open records and links are left, they are decided one by one in
    a single task, with the same result. Without ``keep`` the history is not extended, for a last batch.
    """
    units = rows.groupBy("fp", "ck").agg(F.min("pos").alias("pos"))
    blocked = suppressed.select("fp")
    if history.accepted:
        blocked = blocked.unionByName(history.known().select("fp"))
    units = joined(units, blocked, "fp", "left_anti")
    if history.accepted:
        units = joined(units, history.known().select("ck"), "ck", "left_anti")
    units = materialize(units, "units", dictionary=False)
    fresh = joined(rows, units.select("ck"), "ck", "left_semi") if history.accepted else rows
    classes = wordsets.classes(fresh)
    if history.signer is None:
        history.signer = wordsets.Signer(wordsets.word_weights(classes), bands=history.bands, rows=history.rows)
    units = joined(units, classes.select("ck", "rep"), "ck")
    links, covered = _links(history, classes)
    opened = materialize(joined(units, covered, "rep", "left_anti").select("fp", "ck", "rep", "pos"), "open", dictionary=False)

    taken: list[DataFrame] = []
    while (left := opened.count()) and (left > few or links.count() > few):
        by_rep = opened.groupBy("rep").agg(F.min("pos").alias("first"))
        linked = joined(links, by_rep.select(F.col("rep").alias("b"), F.col("first").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        by_rep = joined(by_rep, linked.withColumnRenamed("a", "rep"), "rep", "left")
        by_fp = opened.filter("fp is not null").groupBy("fp").agg(F.min("pos").alias("same"))
        state = joined(joined(opened, by_rep, "rep"), by_fp, "fp", "left")
        wins = state.filter("pos = first and (near is null or pos < near) and (same is null or pos = same)")
        wins = materialize(wins.select("fp", "ck", "rep", "pos"), "wins", dictionary=False)
        taken.append(wins)
        gone = wins.select("rep").union(joined(links, wins.select(F.col("rep").alias("a")), "a").select("b")).distinct()
        rest = joined(joined(opened, gone, "rep", "left_anti"), wins.filter("fp is not null").select("fp").distinct(), "fp", "left_anti")
        opened = materialize(rest, "open", dictionary=False)
        reps = opened.select("rep").distinct()
        links = joined(joined(links, reps.withColumnRenamed("rep", "a"), "a", "left_semi"), reps.withColumnRenamed("rep", "b"), "b", "left_semi")
        links = materialize(links, "links", dictionary=False)
    if left:
        taken.append(materialize(_one_by_one(opened, links), "wins", dictionary=False))

    if not taken:
        return rows.select("id")
    wins = reduce(DataFrame.unionByName, taken)
    if keep:
        history.add(joined(wins.select("fp", "ck", "rep"), classes.select("rep", "words"), "rep").select("fp", "ck", "rep", "words"))
        history.save()
    discard(units, opened, links, covered)  # and the classes, which units are joined with
    return joined(rows, wins.select("pos"), "pos", "left_anti").select("id")


def covered(
    records: DataFrame, suppressed: DataFrame, texts: list[str], batch_col: str, batches: int = 3,
    tenths: int = 7, bands: int = 32, rows: int = 4, miss: float = 0.0001, fan: int = 2, few: int = FEW,
) -> DataFrame:
    """Replay ``records`` (id, ``batch_col``, fp, texts) in order of batch and id as ``batches`` arrivals; covered ids.

    Arrivals are ranges of ``batch_col`` with about as many records each; the result does not depend on their number, beyond
    the few links that keys miss. Null texts count as empty; records without words are only similar to records of the same text;
    a null batch comes first; a null id is left out; ids must be unique. A record of weighted similarity s to another shares a
    sort value with it with probability 1 - (1 - s ** rows) ** bands: more ``rows`` mean smaller windows, as tables of many
    millions of like records need, and then more ``bands``. The weighted similarity of records that differ in freely chosen
    words is below their Jaccard similarity. Word weights come from the first arrival's classes.
    """
    records = records.filter("id is not null").withColumn("_b", F.coalesce(F.col(batch_col).cast("long"), F.lit(-1 << 62)))
    at = [(i + 1) / batches for i in range(batches - 1)] or [1.0]
    cuts, low_b, high_b, low, high = records.agg(F.percentile_approx("_b", at, 10000), F.min("_b"), F.max("_b"), F.min("id"), F.max("id")).first()
    edges = [None, *(sorted(set(cuts)) if batches > 1 and cuts else []), None]
    pos = _position(low_b or 0, high_b or 0, low or 0, high or 0)
    arrivals = materialize(wordsets.keyed(records, texts, "id", F.col("_b").alias("batch"), pos.alias("pos"), "fp"), "arrivals", dictionary=False)
    out, history = [], History(records.sparkSession, None, None, tenths, miss, bands, rows, fan=fan)
    for after, upto in zip(edges, edges[1:]):
        part = arrivals
        part = part if after is None else part.filter(F.col("batch") > after)
        part = part if upto is None else part.filter(F.col("batch") <= upto)
        out.append(accept_batch(history, part, suppressed, keep=upto is not None, few=few))
    return reduce(DataFrame.unionByName, out)


def _position(low_b: int, high_b: int, low: int, high: int) -> Column:
    """A value that orders by batch (column _b), then id: a long where both spans fit into one, else padded digits."""
    width = (high - low).bit_length()
    if width + (high_b - low_b).bit_length() <= 62:
        return F.shiftleft(F.col("_b") - low_b, width) + (F.col("id") - low)
    part = lambda c, least: F.lpad((F.col(c).cast("decimal(38,0)") - F.lit(str(least)).cast("decimal(38,0)")).cast("string"), 20, "0")
    return F.concat(part("_b", low_b), part("id", low))
