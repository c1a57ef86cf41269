"""Evaluation texts leaking into a corpus, by Wu-Manber search over words.

Patterns are all runs of ``length`` words of the evaluation items. A window of that length slides over a document; the
block of its last two words indexes the shift table, which says how far the window may move because no pattern has that
block nearer to its end. Only where the shift is zero, and a hash of the window is in the filter of the patterns' hashes,
does the window leave the document; the hash buckets of the patterns are a join on that hash, and the words of window and
pattern are then compared directly. The windows of all documents of a batch move together, each at its own pace, as arrays.

Shift table and filter are built by the executors and have a greatest size, whatever the items are; the patterns themselves
are a table that Spark joins as it sees fit. So neither driver nor executors hold more when there are more items; the search
only moves in smaller steps and lets more windows through to the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import Shared, materialize

_WORD = re.compile(r"[^\W_]+")
#: Entries of the shift table, one byte each. Blocks share an entry where their hashes do; the smaller shift holds.
SHIFTS = 1 << 20
#: Most bits of the filter of patterns (a broadcast of 32 MB), and bits for each pattern below that.
FILTER_BITS, BITS_EACH = 1 << 28, 16


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


class _Words:
    """The words of a batch of texts of at least ``length`` words, as 64-bit hashes in one array."""

    def __init__(self, texts: list[str], length: int):
        self.lists = [words(t) for t in texts]
        self.long = np.array([i for i, x in enumerate(self.lists) if len(x) >= length], np.int64)
        self.sizes = np.array([len(self.lists[i]) for i in self.long], np.int64)
        known: dict[str, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for i in self.long for w in self.lists[i]), np.int64, int(self.sizes.sum()))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
        self.codes = hashes[flat] if len(known) else np.array([], np.uint64)
        self.stops = np.cumsum(self.sizes)
        self.starts = self.stops - self.sizes


def _block(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entry of the shift table for the blocks whose last words are ``at``."""
    mixed = (codes[at - 1] * np.uint64(0x9E3779B97F4A7C15) + codes[at]) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(44)).astype(np.int64) % SHIFTS


def _window_keys(codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the windows whose last words are ``at``."""
    key = np.zeros(len(at), np.uint64)
    for j in range(length):
        key = (key ^ codes[at - (length - 1 - j)]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    return key


def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for every key."""
    return (keys % np.uint64(size)).astype(np.int64), ((keys >> np.uint64(17)) % np.uint64(size - 1)).astype(np.int64)


def patterns(items: DataFrame, length: int) -> DataFrame:
    """(key, item_id, window): every run of ``length`` words of the items."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for n in range(0, whole.num_rows, 500):
                batch = whole.slice(n, 500)
                own = _Words(batch["text"].to_pylist(), length)
                ids, rows = batch["item_id"].to_pylist(), []
                for k, i in enumerate(own.long):
                    at = np.arange(own.starts[k] + length - 1, own.stops[k])
                    keys = _window_keys(own.codes, at, length).view(np.int64)
                    rows += [(int(key), ids[i], " ".join(own.lists[i][j : j + length])) for j, key in enumerate(keys)]
                cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "item_id", "window"])

    rows = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(cut, "key long, item_id long, window string").distinct()


class Tables:
    """Shift table and filter of the patterns."""

    def __init__(self, length: int, shifts: np.ndarray, bits: np.ndarray):
        self.length, self.shifts, self.bits = length, shifts, bits

    def passing(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text, key, window) of every window at which a pattern may be."""
        n, own = self.length, _Words(texts, self.length)
        at, doc, stops = own.starts + n - 1, np.arange(len(own.long)), own.stops
        none = np.array([], np.int64)
        hit_doc, hit_at, hit_key = [none], [none], [none.astype(np.uint64)]
        while len(at):
            shift = self.shifts[_block(own.codes, at)].astype(np.int64)
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                keys = _window_keys(own.codes, at[zero], n)
                a, b = _places(keys, len(self.bits) * 64)
                bit = lambda p: self.bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)
                near = (bit(a) & bit(b)).astype(bool)
                hit_doc.append(doc[zero[near]])
                hit_at.append(at[zero[near]])
                hit_key.append(keys[near])
                shift[zero] = 1
            at = at + shift
            go = at < stops
            at, doc, stops = at[go], doc[go], stops[go]
        docs, ends = np.concatenate(hit_doc), np.concatenate(hit_at)
        spans = [" ".join(own.lists[own.long[d]][e - own.starts[d] - n + 1 : e - own.starts[d] + 1]) for d, e in zip(docs, ends)]
        return own.long[docs], np.concatenate(hit_key).view(np.int64), spans


def tables(items: DataFrame, known: DataFrame, length: int) -> Tables:
    """Built from the items and their ``patterns``. The driver gets SHIFTS and FILTER_BITS / 64 rows at most."""

    def shifted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(SHIFTS, length - 1, np.uint8)
        for whole in it:
            for n in range(0, whole.num_rows, 500):
                own = _Words(whole.slice(n, 500)["text"].to_pylist(), length)
                for start, stop in zip(own.starts, own.stops):
                    at = np.arange(start + 1, stop)
                    # A block is nearest to a pattern's end in the pattern that ends with it, or else in the item's first one.
                    np.minimum.at(least, _block(own.codes, at), np.maximum(0, start + length - 1 - at).astype(np.uint8))
        slot = np.flatnonzero(least < length - 1)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(least[slot].astype(np.int32))], ["slot", "shift"])

    if not 2 <= length <= 255:
        raise ValueError("passages have 2 to 255 words")
    rows = items.filter("item_id is not null and text is not null").select("text")
    found = rows.mapInArrow(shifted, "slot long, shift int").groupBy("slot").agg(F.min("shift").alias("shift")).toArrow()
    shifts = np.full(SHIFTS, length - 1, np.uint8)
    shifts[np.asarray(found["slot"])] = np.asarray(found["shift"])

    size = min(FILTER_BITS, max(1 << 12, 1 << (BITS_EACH * max(1, known.count()) - 1).bit_length()))

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            places = np.concatenate(_places(np.asarray(batch["key"]).view(np.uint64), size))
            word, at = np.unique(places >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (places & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

    found = known.select("key").mapInArrow(marked, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[np.asarray(found["word"])] = np.asarray(found["mask"]).view(np.uint64)
    return Tables(length, shifts, bits)


def leaks(documents: DataFrame, items: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, item_id), distinct: documents (doc_id, text) that hold ``length`` consecutive words of an item (item_id, text).

    Null texts and ids, texts without words and items shorter than ``length`` give no rows; other columns are ignored.
    There is no bound on the number of items.
    """
    items = items.select("item_id", "text")
    known = materialize(patterns(items, length), "patterns", dictionary=False)
    shared = Shared(documents.sparkSession, tables(items, known, length))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for n in range(0, whole.num_rows, 500):
                batch = whole.slice(n, 500)
                text, key, window = shared.value.passing(batch["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(text)), pa.array(key), pa.array(window, pa.string())], ["doc_id", "key", "window"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    met = rows.mapInArrow(search, "doc_id long, key long, window string").alias("d").join(known.alias("p"), "key")
    return met.filter("d.window = p.window").select("doc_id", "item_id").distinct()
